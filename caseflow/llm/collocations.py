"""Phrase collocations from a weighted de Bruijn graph whose nodes are word triples and whose edges are 4-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseflow.llm.ragged import BYTE_VALUES, RollingHash, flat_texts, mix64, row_chunks
from caseflow.session import arrow_batches, materialize

LONGEST, MIN_COUNT, TOP = 4, 30, 2000
#: Per cent of a phrase's occurrences inside one longer phrase at which it is dropped.
INSIDE_PCT = 80
#: Texts are cut into words together until they have this many bytes.
CHUNK_BYTES = 1 << 20
#: Bytes of texts that a task is sent at once.
BATCH_BYTES = 4 << 20
#: Words whose graph a task builds together, and edges of one path at most (longer ones are parted).
REGION_WORDS, PATH_EDGES = 200_000, 256
#: Pair hashes that a task counts together.
PAIRS_TOGETHER = 1_000_000
#: Groups in which a language's phrases are ranked before the best of them are.
RANK_GROUPS = 64
#: Bits of the set of frequent pairs: 16 for each of them, between these powers of two (16 MB at most).
LEAST_BITS, MOST_BITS = 16, 27

# Capitals become small letters, piece ends line feeds, tabs spaces.
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def word_places(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Cleaned bytes of some texts, start and end of each word, and whether the next word is of the same piece."""
    data = b"\n".join(texts).translate(_CLEAN)
    flat = np.frombuffer(data, np.uint8)
    is_word = np.concatenate([[False], (flat != 0x20) & (flat != 0x0A), [False]])
    edges = np.flatnonzero(is_word[1:] != is_word[:-1])
    starts, ends = edges[::2], edges[1::2]
    piece = np.cumsum(flat == 0x0A)[starts]
    return data, starts, ends, np.append(piece[1:] == piece[:-1], False)[:len(starts)]


def pair_hashes(lang: str, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word and the next one (of the last word: meaningless)."""
    word = RollingHash(BYTE_VALUES[np.frombuffer(data, np.uint8)]).of(starts, ends)
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1))
    return mix64(mix64(word ^ seed) + np.roll(word, -1))


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of each language in stretches of ``CHUNK_BYTES``."""
    langs = batch.column("lang")
    for lang in pc.unique(langs).to_pylist():
        flat, offsets = flat_texts(batch.column("text").filter(pc.equal(langs, lang)))
        for a, b in row_chunks(offsets, CHUNK_BYTES):
            yield lang, [flat[offsets[k]:offsets[k + 1]].tobytes() for k in range(a, b)]


def _number(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense numbers of equal keys, how often each occurs, and where it occurs first."""
    _, first, number, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return number, count, first


class Region:
    """The graph of some texts of one language: paths without a branch, and what ends in it."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.joined: list[np.ndarray] = []

    def add(self, words: list[bytes], joined: np.ndarray) -> None:
        number = self.number
        self.words.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        self.joined.append(joined)

    def rows(self) -> tuple[list[bytes], list[int], list[int]]:
        """(words of a path or of a phrase that ends a run, how many words, how often).

        A node, three words in a row, is unary if all its occurrences come from
        one edge and go on by one edge, that is, if both edges are as frequent as
        the node; a run's first and last node never are, since one occurrence
        has no edge before or behind it.  A path is a longest chain of edges over unary nodes and is
        written once, with the frequency that all its edges have.
        """
        word, joined = np.concatenate(self.words), np.concatenate(self.joined)
        names = list(self.number)
        text, size, weight = [], [], []

        def write(at: np.ndarray, n: np.ndarray, times: np.ndarray) -> None:
            for i, k, t in zip(at.tolist(), n.tolist(), times.tolist()):
                text.append(b" ".join([names[w] for w in word[i:i + k].tolist()]))
                size.append(k)
                weight.append(t)

        last = ~joined  # of a run of joined words
        n_ends = np.bincount(word[last], minlength=len(names))
        used = np.flatnonzero(n_ends)
        text += [names[w] for w in used.tolist()]
        size += [1] * len(used)
        weight += n_ends[used].tolist()

        pair_at = np.flatnonzero(joined)
        pair = np.full(len(word) + 1, -1)
        pair[pair_at] = _number(word[pair_at] << 32 | word[pair_at + 1])[0]
        node_at = pair_at[joined[pair_at + 1]]
        node = np.full(len(word) + 1, -1)
        number, node_count, _ = _number(pair[node_at] << 32 | word[node_at + 2])
        node[node_at] = number
        for at, key, n in ((pair_at[last[pair_at + 1]], pair, 2), (node_at[last[node_at + 2]], node, 3)):
            _, count, first = _number(key[at])
            write(at[first], np.full(len(first), n), count)

        edge_at = node_at[node[node_at + 1] >= 0]
        edge = np.full(len(word) + 1, -1)
        number, edge_count, _ = _number(node[edge_at] << 32 | node[edge_at + 1])
        edge[edge_at] = number
        frequency = np.append(edge_count, 0)[edge[edge_at]]
        following = edge[edge_at + 1]  # -1 where the run ends
        unary = (following >= 0) & (frequency == np.append(edge_count, 0)[following]) & (
            frequency == np.append(node_count, 0)[node[edge_at + 1]])
        begins = np.append(True, ~unary[:-1])[:len(edge_at)]
        chain = np.flatnonzero(begins)
        place = np.arange(len(edge_at)) - np.repeat(chain, np.diff(np.append(chain, len(edge_at))))
        begins |= place % PATH_EDGES == 0
        chain = np.flatnonzero(begins)
        length = np.diff(np.append(chain, len(edge_at)))
        first = _number(edge[edge_at[chain]])[2]  # a path is known by its first edge
        write(edge_at[chain[first]], length[first] + LONGEST - 1, frequency[chain[first]])
        return text, size, weight


def frequent_pairs(docs: DataFrame, min_count: int) -> tuple[np.ndarray, int]:
    """Bit set of the hashes of neighbouring words that occur ``min_count`` times or more, and its power of two.

    Every pair as frequent as that is in it; others may be (equal hashes, or
    shared bits once there are so many that ``MOST_BITS`` give fewer than 16 each).
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            pair, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(times)], ["pair", "times"])

        for batch in batches:
            for lang, texts in _by_lang(batch):
                data, starts, ends, joined = word_places(texts)
                held.append(pair_hashes(lang, data, starts, ends)[joined])
                n += len(held[-1])
                if n >= PAIRS_TOGETHER:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    frequent = materialize(docs.mapInArrow(counted, "pair bigint, times bigint").groupBy("pair")
                           .agg(F.sum("times").alias("times")).filter(F.col("times") >= min_count).select("pair"))
    bits = min(MOST_BITS, max(LEAST_BITS, int(16 * frequent.count()).bit_length()))
    words = (frequent.selectExpr(f"shiftrightunsigned(pair, {64 - bits}) as place").groupBy(F.expr("shiftright(place, 5) as word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(place % 32 as int))) as bits"))).toPandas()
    out = np.zeros(1 << bits - 5, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out, bits


def graph(docs: DataFrame, min_count: int) -> DataFrame:
    """Paths and run ends of all documents: (lang, gram, size, weight), each once for each language.

    Pieces are cut between words whose pair occurs less than ``min_count`` times:
    no phrase as frequent as that reaches over such a place, and the words
    beside it count as ends of runs like those at a piece's end.
    """
    frequent, bits = frequent_pairs(docs, min_count)
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, regions, n = sent.value, {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            while regions:
                lang, region = regions.popitem()
                text, size, weight = region.rows()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(text), pa.string()), pa.array(text, pa.binary()).cast(pa.string()),
                     pa.array(size, pa.int32()), pa.array(weight, pa.int64())], ["lang", "gram", "size", "weight"])

        for batch in batches:
            for lang, texts in _by_lang(batch):
                data, starts, ends, joined = word_places(texts)
                if not len(starts):
                    continue
                place = pair_hashes(lang, data, starts, ends) >> np.uint64(64 - bits)
                joined &= known[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32) & np.uint32(1) > 0
                regions.setdefault(lang, Region()).add(data.split(), joined)
                n += len(starts)
                if n >= REGION_WORDS:
                    yield from flush()
                    n = 0
        yield from flush()

    rows = docs.mapInArrow(built, "lang string, gram string, size int, weight bigint")
    return rows.groupBy("lang", "gram", "size").agg(F.sum("weight").alias("weight"))


def _sub(words: Column, at: Column | int, n: Column | int) -> Column:
    return F.concat_ws(" ", F.slice(words, at, n))


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, size, f) of all phrases of 1 to 4 words that occur ``min_count`` times or more; (lang, n).

    4-grams are the edges of the graph.  A shorter phrase occurs once for each
    occurrence of the phrases that prolong it by a word, and once for each run
    that ends with it: triples from the edges that leave them, pairs from triples,
    words from pairs.
    """
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        g = materialize(graph(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), min_count))
    words = F.split("gram", " ")
    level = (g.filter(F.col("size") >= LONGEST)
             .select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - LONGEST + 1),
                                                   lambda i: _sub(words, i, LONGEST))).alias("gram"), "weight")
             .groupBy("lang", "gram").agg(F.sum("weight").alias("weight")))
    levels = [materialize(level)]
    for n in range(LONGEST - 1, 0, -1):
        flow = levels[-1].select("lang", F.substring_index("gram", " ", n).alias("gram"), "weight")
        ends = g.filter(F.col("size") == n).select("lang", "gram", "weight")
        levels.append(materialize(flow.union(ends).groupBy("lang", "gram").agg(F.sum("weight").alias("weight"))))
    counts = None
    for size, level in zip(range(LONGEST, 0, -1), levels):
        rows = level.filter(F.col("weight") >= min_count).select("lang", "gram", F.lit(size).alias("size"), F.col("weight").alias("f"))
        counts = rows if counts is None else counts.union(rows)
    return materialize(counts), levels[-1].groupBy("lang").agg(F.sum("weight").alias("n"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, inside_pct: int = INSIDE_PCT) -> DataFrame:
    """The ``top`` phrases of 2 to 4 words of each language whose parts are seldom apart.

    Returns lang, ``rank`` (from 1), ``phrase``, ``a`` (its occurrences), ``l`` and
    ``r`` (those of its parts at the cut that scores least), ``n`` (words of the
    language), ``score`` = floor(2000000 a / (l + r)) at that cut (of equal ones the first), and ``cut``, by
    score and a descending, then the phrase's bytes.  A phrase is dropped if
    one longer phrase with ``min_count`` occurrences holds ``inside_pct`` per cent of its own.

    Two passes read the documents where they lie.  The first adds up hashes of
    neighbouring words; those that may be frequent go to every task as a bit
    set of 16 MB at most.  The second builds, in each task, the de Bruijn graph of
    what they join and sends its unbranched paths, so a passage that many
    documents share is a row or two from each task.  Every shuffle is on a
    whole phrase (or the hash of a pair) after adding up in the task: neither a
    hot language nor a very common word, pair or passage gathers in one.

    Null texts are empty, null languages are ``und``.  Rows that repeat an id
    all count; extra columns are ignored; an empty table gives an empty result.  Scores that tie are ordered
    by a, then phrase, which is unique in its language.  Counts are exact at any size (decimal
    products); memory follows the longest text.
    """
    counts, n_words = phrase_counts(docs, min_count)
    words = F.split("gram", " ")
    candidates = counts.filter("size > 1")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: _sub(words, i, n))))
    longer = (candidates.filter("size > 2").select("lang", F.explode(parts).alias("gram"), "f")
              .groupBy("lang", "gram").agg(F.max("f").alias("inside")))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    kept = (candidates.join(longer, ["lang", "gram"], "left")
            .filter(F.col("inside").isNull() | (exact("inside") * 100 < exact("f") * inside_pct)))
    part = counts.filter(F.col("size") < LONGEST)
    cuts = (kept.select("lang", "gram", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
            .select("lang", "gram", "a", "cut", F.expr("substring_index(gram, ' ', cut) as first"),
                    F.expr("substring_index(gram, ' ', cut - size) as rest"))
            .join(part.select("lang", F.col("gram").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(part.select("lang", F.col("gram").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = (cuts.groupBy("lang", "gram", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("least"))
              .select("lang", F.col("gram").alias("phrase"), "a", "least.*"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = scored.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS)))
    for keys in (["lang", "group"], ["lang"]):  # the best of each group, then of them
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(n_words, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score", "cut")
