"""Token counts by rank-synchronous merging of ragged pre-token arrays (byte-level BPE)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseflow.llm.ragged import flat_texts, row_chunks

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512

#: White space as Unicode has it (the file separators U+001C to U+001F are not part of it).
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the published pattern that cuts a text before the merges.
PRE_TOKEN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+"
             rf"|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")

#: A worker keeps the counts of this many pre-tokens of up to so many characters; others are merged whenever they come.
REMEMBERED, REMEMBERED_CHARS = 300_000, 64
#: Texts are counted together until they have this many bytes.
CHUNK_BYTES = 2 << 20
_NONE = np.iinfo(np.int64).max

_loaded: dict[str, "RankMerger"] = {}


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class RankMerger:
    """Counts the symbols that remain of pre-tokens when all merges are done."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        letters = byte_letters()
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        left, right, made = (np.array(x, np.int64) for x in
                             zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges)))
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.pair, self.rank, self.made = key[order], order, made
        self.find = regex.compile(PRE_TOKEN).findall
        special = [regex.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
        self.known: dict[str, int] = {}

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.pair, pairs), len(self.pair) - 1)
        return np.where(self.pair[at] == pairs, self.rank[at], _NONE)

    def merged_lengths(self, tokens: list[bytes]) -> np.ndarray:
        """Number of symbols left of each pre-token (none is empty).

        All pre-tokens advance together: in each round every one of them merges
        all places of its own lowest-ranked pair, left to right without overlap;
        those without a mergeable pair leave with the symbols they have.
        """
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbol = self.byte_id[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), size)
        out = size.copy()
        while len(symbol) > 1:
            rank = self.ranks(symbol[:-1] << 32 | symbol[1:])
            rank[owner[:-1] != owner[1:]] = _NONE
            rank = np.append(rank, _NONE)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(starts, len(owner)))
            lowest = np.minimum.reduceat(rank, starts)
            hit = (rank == np.repeat(lowest, sizes)) & (rank != _NONE)
            # in a run of hits (the pair x x within x x x ...) every second one merges
            places = np.flatnonzero(hit)
            if len(places):
                new_run = np.concatenate([[True], np.diff(places) > 1])
                run_start = places[new_run][np.cumsum(new_run) - 1]
                places = places[(places - run_start) % 2 == 0]
                symbol[places] = self.made[rank[places]]
            stays = np.ones(len(symbol), bool)
            stays[places + 1] = False
            out[owner[starts]] = np.add.reduceat(stays, starts, dtype=np.int64)
            stays &= np.repeat(lowest != _NONE, sizes)
            symbol, owner = symbol[stays], owner[stays]
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings in a text are one token each."""
        cut, extra = [], []
        for text in texts:
            pieces = self.special.split(text) if self.special and self.special.search(text) else [text]
            cut.append([t for p in pieces for t in self.find(p)] if len(pieces) > 1 else self.find(pieces[0]))
            extra.append(len(pieces) - 1)
        new = list(set().union(*cut) - self.known.keys())
        self.known.update(zip(new, self.merged_lengths([t.encode() for t in new]).tolist()))
        out = [sum(map(self.known.__getitem__, tokens)) + n for tokens, n in zip(cut, extra)]
        for t in new:
            if len(t) > REMEMBERED_CHARS:
                del self.known[t]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return out


def merger(path: str) -> RankMerger:
    """The merger of a vocabulary file, read once in each worker."""
    if path not in _loaded:
        _loaded[path] = RankMerger(path)
    return _loaded[path]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, limit: int = TOKEN_LIMIT, tokenizer: str = TOKENIZER) -> DataFrame:
    """Count the tokens of every whole text.

    Returns doc_id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``
    (n_tokens > limit).  ``tokenizer`` names a file of the public tokenizers, or is the
    path of a byte-level BPE vocabulary that every machine has.  Null counts as empty: no tokens.  Rows that
    repeat an id are counted one by one; extra columns are ignored.  Memory
    follows the longest text; a pre-token that is one long run takes one round
    for each different merge in it.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = merger(tokenizer if "/" in tokenizer else tokenizer_path(tokenizer))
        for batch in batches:
            flat, offsets = flat_texts(batch.column("text"))
            n_tokens = [n for a, b in row_chunks(offsets, CHUNK_BYTES)
                        for n in merge.count([flat[offsets[k]:offsets[k + 1]].tobytes().decode() for k in range(a, b)])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n_tokens, pa.int64()),
                 pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return (docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
            .mapInArrow(counted, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"))
