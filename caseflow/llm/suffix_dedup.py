"""Removal of repeated long strings by a depth-limited radix sort of all suffixes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.running import shuffle_partitions
from caseflow.llm.ragged import BYTE_VALUES, MULTIPLIER, RollingHash, flat_texts, mix64, row_chunks
from caseflow.session import materialize

#: Depth of the sort: repeated strings of this many bytes are removed.
THRESHOLD = 100
#: Bytes of the first digit.
DIGIT = 32
#: Neighbouring suffixes that share the digit of the second pass.
SHARING = 8
#: Bytes of text that a worker hashes together, and suffix rows that it sorts before it sends them.
CHUNK_BYTES, ROWS_TOGETHER = 2 << 20, 2_000_000
#: A null id counts as the largest; the mark of its rows is not negative, that of rows with this very id is.
NO_ID = (1 << 63) - 1
#: Row kinds: alone of its first digit in its task; only says that a digit has several rows in a task;
#: one of these rows; a copy of an earlier row of its task.
ALONE, MARKER, SEVERAL, COPY = range(4)
_OTHER_VALUES = mix64(BYTE_VALUES + np.uint64(MULTIPLIER))

ROWS = "k bigint, c bigint, uid bigint, mark bigint, info bigint"


def _info(check: np.ndarray, start: np.ndarray, lead: np.ndarray, more: np.ndarray, kind: int) -> np.ndarray:
    """16 bits of the text's checksum, 31 of the first start, 7 of the digit's place, 7 of further starts, 2 of kind."""
    return check << 47 | start << 16 | lead << 9 | more << 2 | kind


def _least_ahead(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbouring values."""
    span = 1
    while 2 * span <= n:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:len(values) - (n - span)], values[n - span:]) if n > span else values


def suffix_runs(flat: np.ndarray, offsets: np.ndarray, depth: int, digit: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring suffixes that sort by the same first digit.

    A suffix counts if ``depth`` bytes of its text are left.  Its first digit is
    the ``digit``-gram with the least hash among those that these bytes hold
    (the leftmost of equal ones), a choice that equal strings make alike, and
    neighbours mostly share.  Returns for each run: text, first and last start,
    place and hash of the digit, hash of all bytes that the run's strings cover.
    """
    n, none = len(flat), np.empty(0, np.int64)
    if n < depth:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    rolling = RollingHash(BYTE_VALUES[flat])
    grams = mix64((rolling.prefix[digit:] - rolling.prefix[:-digit]) * rolling.down[:n - digit + 1])
    at = np.arange(n - digit + 1, dtype=np.uint64)
    least = _least_ahead(grams >> np.uint64(32) << np.uint64(32) | at, depth - digit + 1)
    sizes = np.diff(offsets)
    inside = np.repeat(offsets[1:], sizes)[:n - depth + 1] - np.arange(n - depth + 1) >= depth
    starts = np.flatnonzero(inside)
    place = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(starts) else none
    first, last, place = starts[new], starts[np.append(new[1:], len(starts)) - 1] if len(new) else none, place[new]
    shape = (place - first) << 8 | (last - first)
    whole = mix64(rolling.of(first, last + depth) ^ mix64(shape.astype(np.uint64)))
    return np.searchsorted(offsets, first, "right") - 1, first, last, place, grams[place], whole


def _send(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], ["k", "c", "uid", "mark", "info"])


def _sift(k: np.ndarray, c: np.ndarray, uid: np.ndarray, mark: np.ndarray, info: np.ndarray,
          alone: bool) -> pa.RecordBatch:
    """A task's own rows before the shuffle: of rows equal in (k, c) only the earliest is sent for comparison.

    With ``alone``, rows of a k that has several c are keyed by both, and one
    marker for each such k tells the other tasks; else all rows stand under k.
    No key gets more than one row of a kind from a task.
    """
    order = np.lexsort((info, mark, uid, c, k))
    k, c, uid, mark, info = k[order], c[order], uid[order], mark[order], info[order]
    new_k = np.concatenate([[True], k[1:] != k[:-1]])
    first = new_k | np.concatenate([[True], c[1:] != c[:-1]])
    same = first | np.concatenate([[True], (uid[1:] != uid[:-1]) | (mark[1:] != mark[:-1])
                                   | (info[1:] != info[:-1])])  # repeated rows of the table
    copy = ~first & same
    heads = np.flatnonzero(new_k)
    several = np.repeat(np.add.reduceat(first, heads, dtype=np.int64) > 1, np.diff(np.append(heads, len(k))))
    if not alone:
        several[:] = False
    key = np.where(copy, mix64(uid.view(np.uint64) + mark.view(np.uint64) + info.view(np.uint64)),
                   np.where(several, mix64(k ^ mix64(c)), k))
    kind = np.where(copy, COPY, np.where(several, SEVERAL, ALONE))
    sent = first | copy
    marked = k[new_k & several]
    zero = np.zeros(len(marked), np.int64)
    return _send(np.append(key[sent], marked), np.append(c[sent], zero.view(np.uint64)), np.append(uid[sent], zero),
                 np.append(mark[sent], zero), np.append(info[sent] | kind[sent], zero | MARKER))


def _sent_rows(parts: Iterator[tuple[np.ndarray, ...]], alone: bool) -> Iterator[pa.RecordBatch]:
    """Gather (k, c, uid, mark, info) rows of a task and sift them some million at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    for part in parts:
        held.append(part)
        if sum(len(x[0]) for x in held) >= ROWS_TOGETHER:
            yield _sift(*map(np.concatenate, zip(*held)), alone)
            held = []
    if sum(len(x[0]) for x in held):
        yield _sift(*map(np.concatenate, zip(*held)), alone)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (k, c, uid, mark, info): (uid, mark, info, again) of runs seen earlier (again) and of the
    earliest of runs whose digit others share."""
    carried = None
    for batch in _then_end(batches):
        if batch is not None:
            new = [batch.column(x).to_numpy() for x in ("k", "c", "uid", "mark", "info")]
            rows = [np.concatenate(z) for z in zip(carried, new)] if carried else new
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last key may go on
            carried, rows = [x[cut:] for x in rows], [x[:cut] for x in rows]
        else:
            rows = carried
        if not rows or not len(rows[0]):
            continue
        k, c, uid, mark, info = rows
        kind = info & 3
        new_k = np.concatenate([[True], k[1:] != k[:-1]])
        first = new_k | np.concatenate([[True], (c[1:] != c[:-1]) | (kind[:-1] == MARKER)])
        again = ~first & np.concatenate([[False], (uid[1:] != uid[:-1]) | (mark[1:] != mark[:-1])
                                           | (info[1:] >> 2 != info[:-1] >> 2)])
        heads = np.flatnonzero(new_k)
        shared = np.repeat(np.add.reduceat(first, heads, dtype=np.int64) > 1, np.diff(np.append(heads, len(k))))
        again |= kind == COPY
        need = ~again & first & (shared | (kind == SEVERAL))
        out = np.flatnonzero((again | need) & (kind != MARKER))
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(uid[out]), pa.array(mark[out]), pa.array(info[out] & ~3),
                                              pa.array(again[out])], ["uid", "mark", "info", "again"])


def _then_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _meet(rows: DataFrame) -> DataFrame:
    """One radix pass: rows of a digit meet in a sorted partition, where the runs are compared."""
    return (rows.repartition(shuffle_partitions(rows.sparkSession), "k").sortWithinPartitions("k", "c", "uid", "mark", "info")
            .mapInArrow(_compare, "uid bigint, mark bigint, info bigint, again boolean"))


def _check(text: bytes) -> int:
    return zlib.crc32(text) & 0xFFFF


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT, with_text: bool = False) -> DataFrame:
    """Remove every byte that a ``threshold``-byte string covers which also starts earlier
    (at a smaller doc_id, or earlier in the same document).

    Returns doc_id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    stretches), ``kept_sha256`` (of what is left); with ``with_text`` also
    ``kept`` (binary, since a stretch can begin inside a character) and ``spans`` (start, length).

    All suffixes are sorted through their first ``threshold`` bytes, most
    significant digit first, and whatever a pass leaves alone is done:

    1. First digit: the ``digit``-gram of the string that has the least hash.
       Neighbouring suffixes choose the same one, so a run of about 35 is one
       row; a task sends rows that it already has equals of only once.
       Within a digit, of equal whole runs all but the earliest are repeats; if
       a digit holds different runs, the earliest of each go on.
    2. Second digit: these runs are cut into stretches of ``SHARING`` suffixes at
       most, whose digit is all that their strings have in common (93 of 100
       bytes).  Stretches are compared in the same way.
    3. Third digit: the whole strings of the stretches that are left.  All but
       the earliest of a group are repeats.

    Groups at the last pass are exactly the repeated strings.  Equality is that
    of 128 hash bits (the digit's 64 and the run's 64, or two hashes of the
    string).  A string that fills a third of the corpus costs one row a task in
    every pass; a digit with many surroundings (a common line) is keyed by its
    surroundings in the tasks that see several of them.  Each pass is written
    once; the texts are shuffled in the later passes to meet their runs.

    Null text is empty; texts under ``threshold`` bytes are whole.  A null id
    counts as the largest.  Rows that repeat an id and a text are one document
    and get one result each; rows of one id with different texts are told apart
    by 80 bits of two checksums (79 without an id).  Extra columns are ignored; an empty table gives
    an empty result.  Memory follows the longest text.
    """
    if not digit <= threshold <= digit + 126:
        raise ValueError("the first digit must be a part of the string, and 126 bytes shorter at most")
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    doc_id, mark = F.col("doc_id").cast("bigint"), F.xxhash64(body)
    mark = F.when(doc_id.isNull(), mark.bitwiseAND(F.lit(NO_ID))) \
        .when(doc_id == NO_ID, mark.bitwiseOR(F.lit(-NO_ID - 1))).otherwise(mark)
    texts = docs.select(F.coalesce(doc_id, F.lit(NO_ID)).alias("uid"), body.alias("body"), mark.alias("mark"),
                        F.crc32(body).bitwiseAND(F.lit(65535)).alias("chk"))

    def first_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                flat, offsets = flat_texts(batch.column("body"))
                ids, marks = batch.column("uid").to_numpy(), batch.column("mark").to_numpy()
                for a, b in row_chunks(offsets, CHUNK_BYTES):
                    ends = offsets[a:b + 1] - offsets[a]
                    part = flat[offsets[a]:offsets[b]]
                    text, first, last, place, gram, whole = suffix_runs(part, ends, threshold, digit)
                    check = np.array([_check(flat[x:y]) for x, y in zip(offsets[a:b], offsets[a + 1:b + 1])], np.int64)
                    yield gram, whole, ids[a:b][text], marks[a:b][text], _info(
                        check[text], first - ends[text], place - first, last - first, 0)
        yield from _sent_rows(parts(), True)

    def next_digits(sharing: int):
        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                flat, offsets = flat_texts(batch.column("body"))
                ids, marks, check = (batch.column(x).to_numpy() for x in ("uid", "mark", "chk"))
                runs = batch.column("runs")
                of_row, info = runs.value_parent_indices().to_numpy(), runs.flatten().to_numpy()
                for a, b in row_chunks(offsets, CHUNK_BYTES):
                    own = slice(*np.searchsorted(of_row, [a, b]))
                    row, first = of_row[own], info[own] >> 16 & 0x7FFFFFFF
                    lead, more = info[own] >> 9 & 127, info[own] >> 2 & 127
                    # a run's starts lie lead - more to lead before its first digit; stretches end at multiples of sharing
                    cells = lead // sharing - (lead - more) // sharing + 1
                    nth = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
                    row, first, lead, more = (np.repeat(x, cells) for x in (row, first, lead, more))
                    cell = lead // sharing - nth
                    far, near = np.minimum(lead, (cell + 1) * sharing - 1), np.maximum(lead - more, cell * sharing)
                    place = first + lead + offsets[row] - offsets[a]
                    text = flat[offsets[a]:offsets[b]]
                    rolling = RollingHash(BYTE_VALUES[text])
                    common = rolling.of(place - cell * sharing, place - (cell + 1) * sharing + 1 + threshold)
                    whole = RollingHash(_OTHER_VALUES[text]).of(place - far, place - near + threshold)
                    yield (mix64(common ^ mix64(cell.astype(np.uint64))),
                           mix64(whole ^ mix64((far << 8 | near).astype(np.uint64))), ids[row], marks[row],
                           _info(check[row], place - far + offsets[a] - offsets[row], far, far - near, 0))

        def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _sent_rows(parts(batches), True)
        return digits

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            runs = batch.column("runs")
            keys = zip(*(batch.column(c).to_pylist() for c in ("uid", "mark")))
            for k, ((uid, mark), text) in enumerate(zip(keys, batch.column("body"))):
                text = np.frombuffer(text.as_buffer(), np.uint8)
                info = runs[k].values.to_numpy() if runs[k].is_valid else np.empty(0, np.int64)
                start = info >> 16 & 0x7FFFFFFF
                step = np.zeros(len(text) + 1, np.int64)
                np.add.at(step, start, 1)
                np.add.at(step, start + (info >> 2 & 127) + threshold, -1)
                gone = np.cumsum(step[:-1]) > 0
                edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
                begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                left = text[~gone].tobytes()
                out.append({"doc_id": None if uid == NO_ID and mark >= 0 else uid, "n_bytes": len(text), "n_removed": int(gone.sum()), "n_spans": len(begin),
                            "kept_sha256": hashlib.sha256(left).hexdigest()}
                           | ({"kept": left, "spans": [{"start": x, "length": y - x} for x, y in zip(begin, end)]}
                              if with_text else {}))
            yield pa.RecordBatch.from_pylist(out, schema)

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
              ("kept_sha256", pa.string())]
    spark_schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if with_text:
        fields += [("kept", pa.binary()),
                   ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))]
        spark_schema += ", kept binary, spans array<struct<start:bigint, length:bigint>>"
    schema = pa.schema(fields)

    def by_text(found: DataFrame) -> DataFrame:
        """What was found in each document; a set, as tasks that hold the same row find the same, so as long as its text at most."""
        return found.groupBy("uid", "mark", F.shiftright("info", 47).alias("chk")).agg(F.collect_set("info").alias("runs"))

    passed = materialize(_meet(texts.select("uid", "mark", "body").mapInArrow(first_digits, ROWS)))
    again = passed.filter("again")
    for sharing in (SHARING, 1):
        apart = by_text(passed.filter("not again"))
        rows = texts.join(apart, ["uid", "mark", "chk"]).select("uid", "mark", "body", "chk", "runs")
        passed = materialize(_meet(rows.mapInArrow(next_digits(sharing), ROWS)))
        again = again.union(passed.filter("again"))
    return (texts.join(by_text(again), ["uid", "mark", "chk"], "left").select("uid", "mark", "body", "runs")
            .mapInArrow(cut, spark_schema))
