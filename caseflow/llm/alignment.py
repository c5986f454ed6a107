"""Alignment of two tokenizers' tokens by divide and conquer at byte offsets where tokens of both end."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.ragged import flat_texts, row_chunks
from caseflow.llm.token_count import _WHITE, PRE_TOKEN, byte_letters, tokenizer_path
from caseflow.session import materialize

BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A pair is one number: the A id above the B id in so many bits.
B_BITS = 15
#: Texts are aligned together until they have this many bytes, and share one request for pair counts up to so many.
CHUNK_BYTES, REQUEST_BYTES = 1 << 20, 16 << 20
#: Words whose tokens a worker keeps; it also forgets all of them after a word of more than so many characters.
REMEMBERED, REMEMBERED_CHARS = 500_000, 10_000

DOC_SCHEMA = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
              "count_sum bigint, groups_sha256 string")
_PASS_1 = ("chunk bigint, request boolean, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
           "groups_sha256 string, groups string, pairs binary, times binary")

_loaded: dict[tuple[str, str], "Tokenizers"] = {}


class Tokenizers:
    """Tokens of both vocabularies, word by word; each different word goes to the libraries once and is aligned once.

    A word is white space and the signs up to the next white space.  A's
    pre-tokens, those of its published pattern, never reach over such a place.
    Nor does a merge of B, but for the few white signs (carriage returns) that
    a piece holds behind another sign; these do not end a word.  So the tokens
    of a text are those of its words.  (Were there a piece with a space behind
    another sign, a whole text would be one word.)  Both end a token where an
    exact word ends, so the groups and links of a text are those of its words, too.
    """

    def __init__(self, a_path: str, b_path: str):
        import regex
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.a_model = Tokenizer.from_file(a_path).model
        self.letters = byte_letters()
        byte_of = {c: b for b, c in self.letters.items()}
        size = max(vocab.values()) + 1
        self.a_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if all(c in byte_of for c in token):
                self.a_bytes[i] = bytes(byte_of[c] for c in token)
        self.find_a = regex.compile(PRE_TOKEN).findall
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(pieces) > 1 << B_BITS:
            raise ValueError("the second vocabulary has too many pieces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i)
                        else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        # white space that some piece holds behind another sign does not end a word; a space never may
        white = regex.compile(f"[{_WHITE}]")
        inside = "".join(sorted({c for p in pieces for c in white.findall(p[1:])})) + "▁"
        word = f"[{_WHITE}]+[^{_WHITE}]*(?:[{regex.escape(inside)}][{_WHITE}]*[^{_WHITE}]*)*"
        local = not any("▁" in p.lstrip("▁") for p in pieces)
        self.words = regex.compile(word if local else r"(?s).+").findall
        self.a_length = np.array([len(x) for x in self.a_bytes])
        self.b_length = np.array([len(x) for x in self.b_bytes])
        # decimal ids with the sign that follows them in the digest: inside a group's part, and at its end
        self.written = [b"%d%s" % (i, sign) for n, signs in ((size, b",|"), (len(pieces), b",;"))
                        for sign in (signs[:1], signs[1:]) for i in range(n)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.longest = 0
        self.ids, self.at = [np.empty(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2  # of the known words, in order
        self.exact = np.empty(0, bool)
        # of the known words, too: groups, links (as pairs of ids), and the groups as bytes (none unless exact)
        self.n_groups, self.pairs, self.pair_at = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64)
        self.texts: list[bytes] = []

    def learn(self, words: list[str]) -> None:
        """Tokens, groups and links of words not met before; a word is exact if both give back its bytes."""
        self.longest = max(self.longest, max(map(len, words)))
        a = [[t.id for x in self.find_a(w) for t in self.a_model.tokenize("".join(map(self.letters.__getitem__, x.encode())))]
             for w in words]
        # the library puts a space before each text: the word's own one, or one to be taken away again
        b = self.b.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        b = [x[1:] if w[0] != " " else x or [self.space] for w, x in zip(words, b)]
        ids = [np.fromiter(itertools.chain.from_iterable(x), np.int32) for x in (a, b)]
        n = [np.fromiter(map(len, x), np.int64, len(words)) for x in (a, b)]
        exact = self._exact(words, ids, n)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.exact = np.append(self.exact, exact)
        for k in (0, 1):
            self.ids[k] = np.concatenate([self.ids[k], ids[k]])
            self.at[k] = np.append(self.at[k], self.at[k][-1] + np.cumsum(n[k]))
        (a, n_a), (b, n_b) = ((x[np.repeat(exact, m)].astype(np.int64), m * exact) for x, m in zip(ids, n))
        a_end, b_end = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        a_to, b_to = np.cumsum(n_a), np.cumsum(n_b)
        some = n_a > 0
        groups = leaf_groups(a_end, b_end, (a_to - n_a)[some], a_to[some], (b_to - n_b)[some], b_to[some])
        of_group = np.searchsorted(a_to, groups[0], "right")
        self.n_groups = np.append(self.n_groups, np.bincount(of_group, minlength=len(words)))
        link_a, link_b = overlaps(a_end, b_end, groups)
        n_links = np.bincount(np.repeat(np.arange(len(words)), n_a)[link_a], minlength=len(words))
        self.pairs = np.append(self.pairs, a[link_a] << B_BITS | b[link_b])
        self.pair_at = np.append(self.pair_at, self.pair_at[-1] + np.cumsum(n_links))
        self.texts += self._written(a, b, groups, a_to + b_to)

    def _exact(self, words: list[str], ids: list[np.ndarray], n: list[np.ndarray]) -> np.ndarray:
        """Whether the tokens of both give back a word's bytes: as many of them, and the same ones."""
        data = [w.encode() for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        of = np.repeat(np.arange(len(data)), size)
        data = np.frombuffer(b"".join(data), np.uint8)
        exact = np.ones(len(words), bool)
        for x, m, entries, length in zip(ids, n, (self.a_bytes, self.b_bytes), (self.a_length, self.b_length)):
            exact &= np.bincount(np.repeat(np.arange(len(words)), m), length[x], len(words)) == size
            got = np.frombuffer(b"".join(map(entries.__getitem__, x[np.repeat(exact, m)].tolist())), np.uint8)
            same = got == data[exact[of]]
            exact[of[exact[of]][~same]] = False
        return exact

    def _written(self, a: np.ndarray, b: np.ndarray, groups: np.ndarray, to: np.ndarray) -> list[bytes]:
        """The groups of each word as ``a1,a2|b1;a3|b2,b3``; ``to`` is how many tokens of both end with it."""
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[groups[1] - 1], last_b[groups[3] - 1] = True, True
        size_a, size_b = groups[1] - groups[0], groups[3] - groups[2]
        token = np.empty(len(a) + len(b), np.int64)
        of_a, of_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
        token[np.arange(len(a)) + groups[2][of_a]] = a + last_a * len(self.a_bytes)
        token[np.arange(len(b)) + groups[1][of_b]] = 2 * len(self.a_bytes) + b + last_b * len(self.b_bytes)
        written = list(map(self.written.__getitem__, token.tolist()))
        to = to.tolist()
        return [b"".join(written[i:j])[:-1] for i, j in zip([0] + to, to)]

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known words that the texts consist of, and the text of each.

        Texts that either tokenizer does not give back byte by byte have none.
        """
        words = [self.words(" " + t) if t else [] for t in texts]
        new = set().union(*words).difference(self.known)
        if new:
            self.learn(list(new))
        size = np.array([len(w) for w in words])
        word = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(words)), np.int64, size.sum())
        text = np.repeat(np.arange(len(texts)), size)
        lost = (np.bincount(text[~self.exact[word]], minlength=len(texts)) > 0)[text]
        return word[~lost], text[~lost]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B: the ids of a space and each text, and each text's number of them.

        Texts that either does not give back byte by byte have none.
        """
        word, text = self.cut(texts)
        out = []
        for ids, at in zip(self.ids, self.at):
            n = at[word + 1] - at[word]
            out.append((ids[stretches(at[word], n)].astype(np.int64), np.bincount(text, n, len(texts)).astype(np.int64)))
        self.tidy()
        return out

    def tidy(self) -> None:
        """Forget the words if there are many, or long ones among them."""
        if len(self.known) > REMEMBERED or self.longest > REMEMBERED_CHARS:
            self.forget()


def loaded(a_path: str, b_path: str) -> Tokenizers:
    """The two tokenizers, read once in each worker."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Tokenizers(a_path, b_path)
    return _loaded[a_path, b_path]


def stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places from each ``begin``, as many as its ``size``, one stretch after another."""
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


def leaf_groups(a_end: np.ndarray, b_end: np.ndarray, a_from: np.ndarray, a_to: np.ndarray,
                b_from: np.ndarray, b_to: np.ndarray) -> np.ndarray:
    """Divide intervals of tokens at shared ends until none is left inside; rows (a_from, a_to, b_from, b_to).

    ``a_end`` and ``b_end`` rise over all texts; an interval's tokens of A and B
    begin and end at the same bytes.  All intervals go down together: each looks
    for the A end nearest to its middle that is a B end too (a bisection in B),
    in a window that widens fourfold until it covers the interval.  Where one is
    found both halves go on; an interval without any is a leaf.
    """
    todo = np.stack([a_from, a_to, b_from, b_to, np.ones_like(a_from)])
    leaves = [np.empty((4, 0), np.int64)]
    while todo.shape[1]:
        single = (todo[1] - todo[0] == 1) | (todo[3] - todo[2] == 1)
        leaves.append(todo[:4, single])
        a0, a1, b0, b1, reach = todo = todo[:, ~single]
        if not todo.shape[1]:
            break
        middle = (a0 + a1 - 2) >> 1  # of the ends inside: a0 to a1 - 2
        low, high = np.maximum(a0, middle - reach + 1), np.minimum(a1 - 2, middle + reach - 1)
        width = high - low + 1
        first = np.cumsum(width) - width
        owner = np.repeat(np.arange(len(width)), width)
        tried = np.arange(len(owner)) + (low - first)[owner]
        place = np.searchsorted(b_end, a_end[tried])
        shared = b_end[place] == a_end[tried]
        away = np.where(shared, 2 * np.abs(tried - middle[owner]) + (tried > middle[owner]), np.iinfo(np.int64).max)
        least = np.minimum.reduceat(away, first)
        found = least != np.iinfo(np.int64).max
        chosen = np.flatnonzero(shared & (away == least[owner]))  # one for each interval that found any
        cut_a, cut_b = tried[chosen] + 1, place[chosen] + 1
        wider = ~found & ((low > a0) | (high < a1 - 2))
        leaves.append(todo[:4, ~found & ~wider])
        ones = np.ones_like(cut_a)
        todo = np.concatenate([
            np.stack([a0[found], cut_a, b0[found], cut_b, ones]), np.stack([cut_a, a1[found], cut_b, b1[found], ones]),
            np.stack([a0[wider], a1[wider], b0[wider], b1[wider], 4 * reach[wider]])], axis=1)
    out = np.concatenate(leaves, axis=1)
    return out[:, np.argsort(out[0])]


def overlaps(a_end: np.ndarray, b_end: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B for each overlap, by merging the ends inside the leaf groups.

    Two neighbours of all ends of a group bound one stretch, which lies in one
    token of each; overlapping tokens share exactly one such stretch.
    """
    inside = np.ones(len(b_end), bool)
    inside[groups[3] - 1] = False  # a group's last end is A's as well
    ends = np.sort(np.concatenate([a_end, b_end[inside]]), kind="stable")
    return np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)


def pack_numbers(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd").compress(planes, asbytes=True)


def unpack_numbers(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 4 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


class Aligned:
    """Tokens, groups and linked pairs of some texts."""

    def __init__(self, both: Tokenizers, texts: list[str]):
        n = len(texts)
        word, document = both.cut(texts)
        total = lambda per_word: np.bincount(document, per_word[word], n).astype(np.int64)
        self.n_a, self.n_b, self.n_groups = total(np.diff(both.at[0])), total(np.diff(both.at[1])), total(both.n_groups)
        links = both.pair_at[word + 1] - both.pair_at[word]
        self.n_links = np.bincount(document, links, n).astype(np.int64)
        # each document's different pairs and how often each is linked
        order = np.sort(np.repeat(document, links) << 32 | both.pairs[stretches(both.pair_at[word], links)])
        new = np.flatnonzero(np.diff(order, prepend=-1))
        self.pairs, self.times = order[new] & 0xFFFFFFFF, np.diff(np.append(new, len(order)))
        self.pair_at = np.searchsorted(order[new] >> 32, np.arange(n + 1))
        written = list(map(both.texts.__getitem__, word.tolist()))
        to = np.searchsorted(document, np.arange(n), "right").tolist()
        self.texts = [b";".join(written[i:j]) for i, j in zip([0] + to, to)]
        both.tidy()


def align(docs: DataFrame, a: str = BYTE_TOKENIZER, b: str = PIECE_TOKENIZER, with_groups: bool = False) -> DataFrame:
    """Align the tokens of two tokenizers in every whole text; one row for each document.

    Returns doc_id, ``n_a``, ``n_b`` (tokens), ``n_groups`` (stretches between
    neighbouring byte offsets where tokens of both end), ``n_links`` (overlapping
    pairs of tokens), ``n_best`` (links whose pair has the highest count of its A
    id; ties all count), ``count_sum`` (of the links' counts) and
    ``groups_sha256``; with ``with_groups`` also the ``groups`` themselves.  A
    pair's count is the number of documents that hold it linked.  ``a`` names a byte-level
    BPE file and ``b`` a sentencepiece file of the public tokenizers, or paths that
    every machine has.

    The first pass reads the documents where they lie, aligns them and writes,
    for each document, its different pairs (compressed), and for each stretch of
    some 16 MB of text one request: its different pairs and how many of its
    documents hold each.  Counts are summed over the requests (a pair in all documents is one
    row a request) and go back to the stretches that asked; there each document's pairs are
    looked up.  No text moves.  The best count of each A id is broadcast: a
    row for each id of that vocabulary at most.  Pair counts themselves are joined.

    Null or empty texts, and texts that either tokenizer does not give back byte
    by byte, have no tokens: zeros, and an empty digest.  Rows that repeat an id are documents
    of their own; extra columns are ignored; an empty table gives an empty result.
    Memory follows the longest text.
    """
    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = loaded(*(x if "/" in x else tokenizer_path(x) for x in (a, b)))
        chunk, read, asked = TaskContext.get().partitionId() << 32, 0, []
        schema = pa.schema([(name, {"boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}.get(kind, pa.int64()))
                            for name, kind in (c.split() for c in _PASS_1.split(", "))])

        def request() -> pa.RecordBatch:
            pairs, place = np.unique(np.concatenate([p for p, _ in asked]), return_inverse=True)
            held = np.bincount(place, np.concatenate([n for _, n in asked])).astype(np.int64)
            row = {"chunk": chunk, "request": True, "pairs": pack_numbers(np.diff(pairs, prepend=0)), "times": pack_numbers(held)}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            flat, offsets = flat_texts(batch.column("text"))
            for i, j in row_chunks(offsets, CHUNK_BYTES):
                done = Aligned(both, [flat[offsets[k]:offsets[k + 1]].tobytes().decode() for k in range(i, j)])
                at = done.pair_at.tolist()
                blobs = [(pack_numbers(np.diff(done.pairs[s:t], prepend=0)), pack_numbers(done.times[s:t]))
                         for s, t in zip(at, at[1:])]
                digests = [hashlib.sha256(t).hexdigest() if t else "" for t in done.texts]
                n = j - i
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk] * n), pa.array([False] * n), batch.column("doc_id").slice(i, n),
                    pa.array(done.n_a), pa.array(done.n_b), pa.array(done.n_groups), pa.array(done.n_links), pa.array(digests),
                    pa.array([t.decode() for t in done.texts] if with_groups else [None] * n, pa.string()),
                    pa.array([p for p, _ in blobs]), pa.array([t for _, t in blobs])], schema=schema)
                if len(done.pairs):
                    asked.append(np.unique(done.pairs, return_counts=True))
                read += int(offsets[j] - offsets[i])
                if read >= REQUEST_BYTES and asked:
                    yield request()
                    chunk, read, asked = chunk + 1, 0, []
        if asked:
            yield request()

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, times in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "times"))):
                pairs = np.cumsum(unpack_numbers(pairs))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), chunk)), pa.array(pairs),
                                                  pa.array(unpack_numbers(times))], ["chunk", "pair", "held"])

    def scored(of_chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(answers["pair"].to_numpy())
        known, count, best = (answers[c].to_numpy()[order] for c in ("pair", "count", "is_best"))
        n_best, count_sum = [], []
        for pairs, times in zip(of_chunk["pairs"], of_chunk["times"]):
            times = unpack_numbers(times)
            place = np.searchsorted(known, np.cumsum(unpack_numbers(pairs)))
            n_best.append(int(times[best[place]].sum()) if len(times) else 0)
            count_sum.append(int((times * count[place]).sum()) if len(times) else 0)
        return of_chunk.assign(n_best=n_best, count_sum=count_sum)[names]

    schema = DOC_SCHEMA + (", groups string" if with_groups else "")
    names = [c.split()[0] for c in schema.split(", ")]
    written = materialize(docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(first_pass, _PASS_1))
    requests = written.filter("request").select("chunk", "pairs", "times").mapInArrow(unpacked, "chunk bigint, pair bigint, held bigint")
    a_id = F.shiftright("pair", B_BITS).alias("a")
    counts = requests.groupBy("pair").agg(F.sum("held").alias("count"))
    best = counts.groupBy(a_id).agg(F.max("count").alias("best"))
    answers = (requests.select("chunk", "pair", a_id).join(counts, "pair").join(F.broadcast(best), "a")
               .select("chunk", "pair", "count", (F.col("count") == F.col("best")).alias("is_best")))
    return (written.filter("not request").groupBy("chunk").cogroup(answers.groupBy("chunk"))
            .applyInPandas(scored, schema))
