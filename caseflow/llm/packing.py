"""Best-fit packing of token sequences by hierarchical merging of underfull bins."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.ragged import flat_texts, row_chunks
from caseflow.llm.token_count import byte_letters, tokenizer_path
from caseflow.session import materialize

TOKENIZER = "word_bpe_49k.json"
CAPACITY, END_ID = 4096, 1
#: A bin with no more free room than this share is emitted at once.
NEARLY = 1 / 128
#: Tasks whose bins meet in one task of the next round.
FAN_IN = 16
#: Underfull bins that a task hands on to the next round, the emptiest ones.  Bins merge only if one of them is at
#: most half full; a task has one such bin at most, so each round brings FAN_IN of them together, and over the 16
#: rounds that 2**64 tasks would take they could fill this many others.  A bin beyond it would never be chosen.
HANDED_ON = 16 * FAN_IN
#: Pieces that a task packs together in the first round, on average.
PIECES_TOGETHER = 100_000
#: Words of up to so many bytes whose ids a worker keeps, and how many of them.
REMEMBERED, REMEMBERED_BYTES = 1_000_000, 64
#: Texts are encoded together until they have this many bytes.
CHUNK_BYTES = 2 << 20
#: ASCII signs, letters (ASCII and Latin-1), ASCII signs: the tokenizer takes the three parts one by one
#: (but for a leading apostrophe, which it may join to a letter).
_PARTS = re.compile(rb"([!-&(-/:-@\[-`{-~]*)((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")

PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                   ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BIN_SCHEMA = ("sequence_id bigint, part int, fill int, done boolean, pieces array<struct<doc_id:bigint, piece:int, "
              "start:bigint, length:bigint, ids_crc32:bigint, offset:bigint>>")

_loaded: dict[str, "WordIds"] = {}


class WordIds(dict):
    """Ids of words as little-endian unsigned 32-bit bytes, each word encoded when it first comes.

    The tokenizer drops white space and never joins what stands on both sides of
    it, so the ids of a text are those of its words one after another.  A word of
    plain letters is one lower-cased pre-token and goes to the tokenizer's model
    at once; signs around it are pre-tokens of their own; any other word takes
    the tokenizer's whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.long: list[bytes] = []

    def __missing__(self, word: bytes) -> bytes:
        parts = None if b"<|" in word else _PARTS.fullmatch(word)  # special strings begin with it
        if parts is None:
            ids = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        elif parts[1] or parts[3]:
            ids = b"".join(self[part] for part in parts.groups() if part)
        elif (lower := word.decode().lower().encode()) != word:
            ids = self[lower]
        else:
            tokens = self.model.tokenize(word.decode("latin-1").translate(self.letters))
            ids = np.array([t.id for t in tokens], "<u4").tobytes()
        if len(word) > REMEMBERED_BYTES:
            self.long.append(word)
        self[word] = ids
        return ids

    def of(self, texts: list[bytes]) -> list[bytes]:
        out = [b"".join(map(self.__getitem__, t.split())) for t in texts]
        for word in self.long:
            self.pop(word, None)
        self.long.clear()
        if len(self) > REMEMBERED:
            self.clear()
        return out


def word_ids(path: str) -> WordIds:
    """The encoder of a tokenizer file, read once in each worker."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin.

    Each item, from the largest down, goes to the bin whose free room is the
    smallest that still takes it.  Bins stand in stacks by their room, and a bit
    set of the rooms in use finds the next one at once.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use = 0
    for item in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[item]
        fitting = in_use >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                in_use ^= 1 << room
            bins[chosen].append(item)
        else:
            room, chosen = capacity, len(bins)
            bins.append([item])
        by_room[room - size].append(chosen)
        in_use |= 1 << (room - size)
    return bins


def _pack(items: list[list[tuple]], capacity: int) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """Pack items, each a list of pieces; (nearly full bins, underfull bins)."""
    sizes = [sum(p[3] for p in item) for item in items]
    full, rest = [], []
    for chosen in best_fit(sizes, capacity):
        fill = sum(sizes[k] for k in chosen)
        (full if fill >= capacity * (1 - NEARLY) else rest).append([p for k in chosen for p in items[k]])
    return full, rest


def _bins(done: list[list[tuple]], rest: list[list[tuple]], round_no: int, last_round: bool) -> pa.RecordBatch:
    """Rows for the bins of a task; only the emptiest ``HANDED_ON`` of the underfull ones stay open."""
    rest = sorted(rest, key=lambda b: sum(p[3] for p in b))
    open_bins = [] if last_round else rest[:HANDED_ON]
    bins = done + rest[len(open_bins):] + open_bins
    part = TaskContext.get().partitionId()
    rows = []
    for k, pieces in enumerate(bins):
        offset, placed = 0, []
        for p in pieces:
            placed.append(dict(zip(PIECE.names, (*p[:5], offset))))
            offset += p[3]
        rows.append((round_no << 56 | part << 32 | k, part, offset, k < len(bins) - len(open_bins), placed))
    columns = list(zip(*rows)) or [()] * 5
    types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(PIECE)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                      ["sequence_id", "part", "fill", "done", "pieces"])


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens; one row for each piece.

    Returns doc_id, ``piece``, ``start``, ``length``, ``ids_crc32`` (of the piece's
    ids as little-endian unsigned 32-bit numbers), ``sequence_id`` and ``offset``.
    A document is its tokenizer ids and the end id; only longer ones are cut,
    into full pieces and a rest.

    The documents are encoded where they lie (no text is shuffled), and their
    pieces (id, length, checksum) are dealt over tasks by a hash of their place, so
    that each task of the first round gets a fair sample of all lengths however
    the input is ordered.  There they are packed best-fit.  Nearly full bins are
    emitted; the emptiest underfull ones (``HANDED_ON`` a task) go on as items
    to the next round, in which ``FAN_IN`` tasks' bins meet, until one task is
    left.  Underfull bins that are not handed on could not have been filled up
    (see ``HANDED_ON``).  A task of a later round thus
    reads FAN_IN * HANDED_ON bins at most, and a bin holds ``capacity`` pieces
    at most, whatever the size of the corpus.  Each round is written once, so
    the ids of its bins stay what they are if an executor is lost.

    Null text is empty: its document is the end id alone.  Rows that repeat an
    id are packed one by one; extra columns are ignored; an empty table gives an
    empty result.  Equal lengths are packed in any order.  Memory follows the longest text.
    """
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer if "/" in tokenizer else tokenizer_path(tokenizer))
        end, place = np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            flat, offsets = flat_texts(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for a, b in row_chunks(offsets, CHUNK_BYTES):
                texts = [flat[offsets[k]:offsets[k + 1]].tobytes() for k in range(a, b)]
                rows = []
                for doc_id, ids in zip(doc_ids[a:b], encode.of(texts)):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        rows.append((place + len(rows), doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                place += len(rows)
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, [pa.int64(), *(f.type for f in PIECE)])],
                    ["place", *PIECE.names[:5]])

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [[piece] for batch in batches
                 for piece in zip(*(batch.column(c).to_pylist() for c in PIECE.names[:5]))]
        yield _bins(*_pack(items, capacity), 0, False)

    def next_round(round_no: int, last: bool):
        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = [[tuple(p.values()) for p in pieces]
                     for batch in batches for pieces in batch.column("pieces").to_pylist()]
            yield _bins(*_pack(items, capacity), round_no, last)
        return merged

    pieces = materialize(docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(
        encoded, "place bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"))
    dealt = pieces.repartition(max(1, -(-pieces.count() // PIECES_TOGETHER)), "place")
    bins = materialize(dealt.mapInArrow(first_round, BIN_SCHEMA))
    rounds, parts = [bins], (bins.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // FAN_IN)
        group = F.floor(F.col("part") / FAN_IN)
        met = bins.filter("not done").withColumn("part", group.cast("int")).repartition(parts, "part")
        bins = materialize(met.mapInArrow(next_round(len(rounds), parts == 1), BIN_SCHEMA))
        rounds.append(bins)
        if parts == 1:
            break
    done = rounds[0].filter("done")
    for r in rounds[1:]:
        done = done.unionByName(r.filter("done"))
    return (done.select("sequence_id", F.explode("pieces").alias("p"))
            .select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset"))
