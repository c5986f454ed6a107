"""Quality rules by repetition coverage: characters inside duplicated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseflow.llm.ragged import BYTE_VALUES, RollingHash, flat_texts, mix64, row_chunks

# Thresholds of the published repetition rules.  Shares of the
# characters of all words; a text above one of them is rejected.
MOST_DUP_LINE_CHARS = 0.20
MOST_TOP = {2: 0.20, 3: 0.18, 4: 0.16}
MOST_DUP = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50

#: Bytes of text that a worker looks at together.
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars"]
SHARES = [f"top{n}" for n in MOST_TOP] + [f"dup{n}" for n in MOST_DUP]
SCHEMA = ("doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", "
          + ", ".join(f"{c} double" for c in SHARES) + ", base_failed boolean, kept boolean")


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item the size of its group of equal keys and whether it is the group's first; and the group heads."""
    order = np.argsort(keys)
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.empty(0, int)
    sizes = np.diff(np.append(starts, len(keys)))
    size = np.empty(len(keys), np.int64)
    size[order] = np.repeat(sizes, sizes)
    heads = np.minimum.reduceat(order, starts) if len(keys) else starts
    first = np.zeros(len(keys), bool)
    first[heads] = True
    return size, first, heads


def _covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a stretch of n that begins at one of ``at``."""
    step = np.bincount(at, minlength=total + 1) - np.bincount(at + n, minlength=total + 1)
    return np.cumsum(step[:-1]) > 0


def measure(flat: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of the texts that lie one after another in ``flat``."""
    n_docs, size = len(offsets) - 1, len(flat)
    per_doc = lambda doc, weight=None: np.bincount(doc, weight, n_docs)
    space = _SPACE[flat]
    begins = np.zeros(size + 1, bool)
    begins[offsets] = True  # a text's first byte begins a word whatever stands before it
    word_at = ~space & (begins[:-1] | np.concatenate([[True], space[:-1]])) if size else space
    word_end = ~space & (begins[1:] | np.concatenate([space[1:], [True]])) if size else space
    start, end = np.flatnonzero(word_at), np.flatnonzero(word_end) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    chars_before = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    chars = chars_before[end] - chars_before[start]
    out = {"n_words": per_doc(doc), "word_chars": per_doc(doc, chars).astype(np.int64)}
    symbol_before = np.concatenate([[0], np.cumsum(_SYMBOL[flat])])
    out["n_symbols"] = symbol_before[offsets[1:]] - symbol_before[offsets[:-1]]

    of_bytes = RollingHash(BYTE_VALUES[flat])
    seed = mix64(np.arange(1, n_docs + 1, dtype=np.uint64))  # keeps texts apart
    # lines that have a word: cut at line feeds and at the ends of the texts
    cut = np.unique(np.concatenate([np.flatnonzero(flat == 0x0A) + 1, offsets]))
    line_start, line_end = cut[:-1], cut[1:] - (flat[cut[1:] - 1] == 0x0A) if size else cut[1:]
    words_before = np.concatenate([[0], np.cumsum(word_at)])
    has_word = words_before[line_end] > words_before[line_start]
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    _, first, _ = _groups(of_bytes.of(line_start, line_end) ^ seed[line_doc])
    space_before = np.concatenate([[0], np.cumsum(space)])
    line_chars = (chars_before[line_end] - chars_before[line_start]
                  - (space_before[line_end] - space_before[line_start]))
    out |= {"n_lines": per_doc(line_doc), "n_dup_lines": per_doc(line_doc[~first]),
            "dup_line_chars": per_doc(line_doc[~first], line_chars[~first]).astype(np.int64)}

    of_words = RollingHash(of_bytes.of(start, end))
    total_chars = np.maximum(out["word_chars"], 1)
    chars_to = np.concatenate([[0], np.cumsum(chars)])
    left = np.searchsorted(doc, doc, "right") - np.arange(len(doc))  # words from here to the text's end
    at = np.arange(len(doc))
    for n in range(2, max(MOST_DUP) + 1):
        at = at[left[at] >= n]  # only where the n-gram one shorter occurs twice can this one do so
        count, first, heads = _groups(of_words.of(at, at + n) ^ seed[doc[at]])
        if n in MOST_TOP:
            top = np.zeros(n_docs)
            top_at = at[heads]
            repeated = count[heads] > 1
            np.maximum.at(top, doc[top_at[repeated]],
                          (count[heads] * (chars_to[top_at + n] - chars_to[top_at]))[repeated])
            out[f"top{n}"] = np.minimum(top / total_chars, 1.0)
        if n == 3:
            inside = _covered(at[count > 1], n, len(doc))
            out["n_repeat_words"] = per_doc(doc[inside])
        if n in MOST_DUP:
            inside = _covered(at[~first], n, len(doc))
            out[f"dup{n}"] = per_doc(doc[inside], chars[inside]) / total_chars
        at = at[count > 1]
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of the measures."""
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEAT_PERCENT * m["n_words"])
    bad = m["dup_line_chars"] > MOST_DUP_LINE_CHARS * m["word_chars"]
    for n, most in MOST_TOP.items():
        bad |= m[f"top{n}"] > most
    for n, most in MOST_DUP.items():
        bad |= m[f"dup{n}"] > most
    return failed, ~failed & ~bad


def quality(docs: DataFrame) -> DataFrame:
    """Measure every whole text and judge it.

    Returns doc_id, the counts ``n_words``, ``word_chars`` (code points in words),
    ``n_symbols``, ``n_dup_lines`` (lines equal to an earlier one), ``n_repeat_words``
    (words in 3-word windows that occur twice), ``n_lines`` (lines with a word),
    ``dup_line_chars``; ``top2`` to ``top4`` (share of the word characters in the
    most frequent repeated n-gram), ``dup5`` to ``dup10`` (share in n-grams that
    occurred before); ``base_failed`` (under 50 words, or over half of them
    repeated) and ``kept``: not base_failed and no share above its threshold.  Lines
    count by their characters, so that one short line that a text of three
    lines repeats does not condemn it.

    Texts are measured in numpy, some MB together: words, lines and n-grams get
    64-bit rolling hashes from prefix sums, and equal hashes of a text are
    equal pieces.  Memory follows the longest text.  Null and empty texts have
    no words and fail.  Rows that repeat an id are judged one by one; extra
    columns are ignored.
    """
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = flat_texts(batch.column("text"))
            for a, b in row_chunks(offsets, CHUNK_BYTES):
                m = measure(flat[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                failed, kept = verdict(m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a)] + [pa.array(m[c].astype(np.int64)) for c in COUNTS]
                    + [pa.array(m[c]) for c in SHARES] + [pa.array(failed), pa.array(kept)],
                    ["doc_id", *COUNTS, *SHARES, "base_failed", "kept"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(judge, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with all their columns, in one pass over them."""
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = flat_texts(batch.column("text"))
            for a, b in row_chunks(offsets, CHUNK_BYTES):
                _, kept = verdict(measure(flat[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]))
                yield batch.slice(a, b - a).filter(pa.array(kept))

    return docs.mapInArrow(sift, docs.schema)
