"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths of the character n-grams, buckets that they are hashed into, and the count added to each bucket.
LENGTHS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
UNKNOWN = "und"
#: n-grams are hashed for this many characters at a time.
CHUNK_CHARS = 1 << 20
_STEPS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def buckets_of(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a lower-cased text, in stretches that bound the memory."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    overlap = max(LENGTHS) - 1
    for a in range(0, max(1, len(points)), CHUNK_CHARS):
        stretch = points[a:a + CHUNK_CHARS + overlap]
        for n in LENGTHS:
            count = min(len(stretch) - n + 1, CHUNK_CHARS)
            if count > 0:
                h = np.full(count, n, np.uint32)
                for k in range(n):
                    h = (h ^ stretch[k:k + count]) * _STEPS[k]
                    h ^= h >> np.uint32(15)
                yield h & np.uint32(BUCKETS - 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: (lang, bucket, n), and the number of texts of a language at bucket -1."""
    table: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            if has_letter(text):
                row = table.setdefault(lang, np.zeros(BUCKETS, np.int64))
                texts[lang] = texts.get(lang, 0) + 1
                for b in buckets_of(text):
                    row += np.bincount(b, minlength=BUCKETS)
    for lang, row in table.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(row[at], texts[lang]))],
            ["lang", "bucket", "n"])


def fit_languages(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log prior and log probability matrix (BUCKETS x languages) from (text, lang).

    Every labelled text counts.  Counting happens per partition and is summed by
    Spark; the driver gets ``BUCKETS`` rows a language at most, whatever the
    number of documents.  Rows with null lang or without a letter teach nothing.
    """
    counts = (labelled.select("text", "lang").filter("lang is not null")
              .mapInArrow(_counts, "lang string, bucket bigint, n bigint")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(counts["lang"].unique())
    column = counts["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(int)
    bucket, n = counts["bucket"].to_numpy(int), counts["n"].to_numpy(float)
    prior, matrix = np.zeros(len(langs)), np.full((BUCKETS, len(langs)), SMOOTHING)
    prior[column[bucket < 0]] = n[bucket < 0]
    matrix[bucket[bucket >= 0], column[bucket >= 0]] += n[bucket >= 0]
    return langs, np.log(prior / max(1.0, prior.sum())), np.log(matrix / matrix.sum(axis=0))


def identify_languages(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, ``lang_pred`` and ``score`` (posterior, 0 to 1) of every whole text.

    The matrix is broadcast (buckets x languages x 4 bytes, independent of the
    corpus).  A text's n-grams are counted once each and multiplied with their
    rows of it.  Null and letterless texts are ``und`` with score 0, and so is
    everything if the model knows no language.  Rows that repeat an id are
    judged one by one; extra columns are ignored.
    """
    langs, prior, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix.astype(np.float32))

    def judge(text: str | None) -> tuple[str, float]:
        if not langs or not has_letter(text):
            return UNKNOWN, 0.0
        score = prior.copy()
        for b in buckets_of(text):
            if len(b) > BUCKETS // 4:
                n = np.bincount(b, minlength=BUCKETS)
                at = np.flatnonzero(n)
                score += n[at] @ shared.value[at].astype(float)
            else:
                score += shared.value[b].sum(axis=0, dtype=float)
        best = int(np.argmax(score))
        return langs[best], float(1.0 / np.exp(score - score[best]).sum())

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = zip(*map(judge, batch.column("text").to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return (docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
            .mapInArrow(judged, "doc_id bigint, lang_pred string, score double"))
