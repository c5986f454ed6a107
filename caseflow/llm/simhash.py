"""SimHash near-duplicates: deletion-variant signatures over two segments, equality join, verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.running import shuffle_partitions
from caseflow.llm.components import components
from caseflow.llm.ragged import flat_texts
from caseflow.session import materialize

SHINGLE, DISTANCE = 3, 3
#: Seed of the shingle hash.
SEED = 42
#: Shingles whose bits a worker unpacks together.
SHINGLES_TOGETHER = 255 * 256
#: Up to this size the pairs of a group are compared at once; above, its members are visited one after another.
SMALL_GROUP = 16
#: Above this size a group is cut by signatures of its other bits.
LARGE_GROUP = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set if over half of the shingles' hashes set it; 0 without words.

    A-Z is lower-cased; shingles are space-joined words, repeats included; a text of fewer words is one shingle.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])[:max(1, len(words) - shingle + 1)].tolist()
    last = ends[min(shingle, len(words)) - 1:].tolist()
    digest, n = xxhash.xxh64_digest, len(first)
    count = np.zeros(64, np.int64)
    for k in range(0, n, SHINGLES_TOGETHER):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in
                           zip(first[k:k + SHINGLES_TOGETHER], last[k:k + SHINGLES_TOGETHER])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        bits = np.pad(bits, ((0, -len(bits) % 255), (0, 0))).view(np.uint64)  # eight one-byte counters to a number
        sums = bits.reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64).view(np.uint8)
        count += sums.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, digest) of every whole text; fp holds the 64 bits as a signed long."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = flat_texts(batch.column("text"))
            fps = np.fromiter((fingerprint(flat[a:b].tobytes(), shingle) for a, b in zip(offsets[:-1], offsets[1:])),
                              np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64)), batch.column("digest")],
                                             ["doc_id", "fp", "digest"])

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", _digest().alias("digest"))
            .mapInArrow(hashed, "doc_id bigint, fp bigint, digest string"))


def _digest() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)


def signatures(fps: DataFrame) -> DataFrame:
    """(signature, fp): each of the two 32-bit segments as it is and with each one bit deleted.

    Of two fingerprints at most 3 bits apart, one of the two segments differs in
    one bit at most, so they share the signature of that segment as it is, or
    the one without that bit.
    """
    return (fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("k"))
            .withColumn("segment", F.expr("k div 33"))
            .withColumn("deleted", F.expr("cast(k % 33 as bigint)"))
            .withColumn("bits", F.expr("(shiftrightunsigned(fp, cast(32 * segment as int))) & 4294967295L"))
            .withColumn("bits", F.expr("bits & ~(if(deleted = 32, 0L, shiftleft(1L, cast(deleted as int))))"))
            .select(F.expr("shiftleft(segment, 38) | shiftleft(deleted, 32) | bits").alias("signature"), "fp"))


def _near(x: np.ndarray, y: np.ndarray, distance: int, differ: np.ndarray | np.uint64) -> np.ndarray:
    """At most ``distance`` bits apart, and different in the deleted bit (if one is deleted)."""
    other = x ^ y
    return (np.bitwise_count(other) <= distance) & ((differ == 0) | (other & differ != 0))


def _visit(fps: np.ndarray, distance: int, differ: np.uint64) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever is linked in a group: each member is compared with those not reached yet."""
    out, left = [], fps
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            node = reached.pop()
            near = _near(left, node, distance, differ)
            if near.any():
                out.append((left[near], np.full(near.sum(), node)))
                reached += list(left[near])
                left = left[~near]
    return out


def _link_large(fps: np.ndarray, low: int, width: int, distance: int, differ: np.uint64) -> list:
    """The same for a group that agrees on all but ``width`` bits from ``low`` (and one deleted bit):
    it is cut again by the halves of these bits, each as it is and with one bit deleted."""
    if len(fps) <= LARGE_GROUP or width <= 8:
        return _visit(fps, distance, differ)
    out, half = [], width // 2
    for a, rest in ((low, low + half), (low + half, low)):
        mask = np.uint64(((1 << half) - 1) << a)
        for gone in [0, *(1 << (a + k) for k in range(half))]:
            key = fps & mask & ~np.uint64(gone)
            order = np.argsort(key)
            for part in np.split(fps[order], np.flatnonzero(np.diff(key[order])) + 1):
                if len(part) > 1:
                    out += _link_large(part, rest, half, distance, differ)
    return out


def link_groups(signature: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between fingerprints of equal signature (sorted by it), enough to connect all that are linked.

    Under a signature with a deleted bit only pairs that differ in that bit
    count; the others meet under the segment as it is.
    """
    edges = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1], [True]]))
    sizes = np.diff(edges)
    deleted, segment = signature >> 32 & 63, signature >> 38
    differ = np.where(deleted < 32, np.uint64(1) << (32 * segment + deleted % 32).astype(np.uint64), np.uint64(0))
    out = []
    size = np.repeat(sizes, sizes)
    at = np.flatnonzero((size > 1) & (size <= SMALL_GROUP))
    for step in range(1, SMALL_GROUP):
        at = at[at + step < len(fps)]
        at = at[signature[at] == signature[at + step]]
        near = at[_near(fps[at], fps[at + step], distance, differ[at])]
        out.append((fps[near], fps[near + step]))
    for g in np.flatnonzero(sizes > SMALL_GROUP):
        a, b = edges[g], edges[g + 1]
        out += _link_large(fps[a:b], 0 if segment[a] else 32, 32, distance, differ[a])
    x, y = (np.concatenate(z) for z in zip(*out))
    return np.maximum(x, y), np.minimum(x, y)


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between different fingerprints (column fp, each once) that connect all within ``distance`` bits."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one deleted bit find distances of up to 3 bits")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = (np.empty(0, np.int64), np.empty(0, np.uint64))
        for batch in _with_end(batches):
            if batch is None:
                ready, carried = carried, None
            else:
                new = (batch.column("signature").to_numpy(), batch.column("fp").to_numpy().view(np.uint64))
                both = [np.concatenate(z) for z in zip(carried, new)]
                cut = np.searchsorted(both[0], both[0][-1]) if len(both[0]) else 0  # the last group may go on
                ready, carried = (both[0][:cut], both[1][:cut]), (both[0][cut:], both[1][cut:])
            if len(ready[0]) > 1:
                a, b = link_groups(*ready, distance)
                if len(a):
                    pairs = np.unique(np.stack([a, b]), axis=1).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    found = (signatures(fps).repartition(shuffle_partitions(fps.sparkSession), "signature")
             .sortWithinPartitions("signature", "fp").mapInArrow(linked, "a bigint, b bigint"))
    return found.distinct()


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, ``fingerprint`` (16 hex digits) and ``component_id``, the least doc_id that links of
    fingerprints at most ``distance`` bits apart reach.

    Documents with equal fingerprints are one node, so copies cost nothing
    further.  Each different fingerprint is filed under the 66 signatures of its
    two segments; equal signatures meet in one sorted partition, where every
    candidate is verified on all 64 bits.  Only links that are needed to connect
    a group are passed on, never all its pairs; a very large group is cut again
    by signatures of its other bits.  Nothing is capped.

    Null, empty and blank texts have fingerprint zero and are linked like any
    other.  Rows that repeat an id are nodes by their text.  A null id is never
    the least; a component without any other has a null component_id.  Extra
    columns are ignored; an empty table gives an empty result.
    """
    known, rooted = _rooted(docs, shingle, distance)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return (known.join(of_fp, "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def _rooted(docs: DataFrame, shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (fp, least, first, root) of each different one: its least id, its first row
    by (id, digest) with null ids last, and a fingerprint that names its component."""
    known = materialize(fingerprints(docs, shingle))
    nodes = materialize(known.groupBy("fp").agg(
        F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("first")))
    root = components(links(nodes.select("fp"), distance))
    rooted = materialize(nodes.join(root, nodes.fp == root.node, "left")
                         .select("fp", "least", "first", F.coalesce("root", "fp").alias("root")))
    return known, rooted


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: the one of the least id.

    Null ids come last; of rows of that id the one of the least text digest stays, and
    a repeated row stays once.
    """
    _, rooted = _rooted(docs, shingle, distance)
    key = lambda doc_id: F.coalesce(doc_id.cast("string"), F.lit("")).alias("id")
    stay = (rooted.groupBy("root").agg(F.min("first").alias("first"))
            .select(key(F.col("first.doc_id")), F.col("first.digest").alias("digest")))
    rows = docs.select(key(F.col("doc_id").cast("bigint")), _digest().alias("digest"), F.struct("*").alias("row"))
    return (rows.join(stay, ["id", "digest"], "left_semi")
            .withColumn("nth", F.row_number().over(Window.partitionBy("id", "digest").orderBy("digest")))
            .filter("nth = 1").select("row.*"))
