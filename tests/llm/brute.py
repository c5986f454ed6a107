"""Plain versions of the operators, one text at a time, that tests hold the Spark results against."""

from __future__ import annotations

import hashlib
from collections import Counter


def words_of(text):
    return [] if text is None else [w.decode() for w in text.encode().split()]


def quality(text):
    """The contract's counts and every share, from lists and counters of plain strings."""
    from caseflow.llm.quality import MOST_DUP, MOST_TOP
    words, text = words_of(text), text or ""
    lines = [x for x in text.split("\n") if words_of(x)]
    seen, dup_lines, dup_chars = set(), 0, 0
    for x in lines:
        if x in seen:
            dup_lines, dup_chars = dup_lines + 1, dup_chars + sum(map(len, words_of(x)))
        seen.add(x)
    chars = sum(map(len, words))
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
           "n_dup_lines": dup_lines, "n_lines": len(lines), "dup_line_chars": dup_chars}
    for n in range(2, 11):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        count, before, inside, later = Counter(grams), set(), set(), set()
        for i, g in enumerate(grams):
            if count[g] > 1:
                inside |= set(range(i, i + n))
            if g in before:
                later |= set(range(i, i + n))
            before.add(g)
        if n == 3:
            out["n_repeat_words"] = len(inside)
        if n in MOST_TOP:
            top = max([c * sum(map(len, g)) for g, c in count.items() if c > 1], default=0)
            out[f"top{n}"] = min(1.0, top / max(1, chars))
        if n in MOST_DUP:
            out[f"dup{n}"] = sum(len(words[i]) for i in later) / max(1, chars)
    return out


def fingerprint(text, n=3):
    import xxhash
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = words_of(lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(rows, distance=3, n=3):
    """{index: least id reachable} over rows of (doc_id, text), by comparing all pairs."""
    fps = [fingerprint(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(f"{fps[i]:016x}", least.get(find(i))) for i in range(len(rows))]


def remove_repeats(rows, n=100):
    """(n_bytes, n_removed, n_spans, kept) for rows of (doc_id, bytes) with different ids, by a dictionary of all strings."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        gone = [False] * len(text)
        for i in range(len(text) - n + 1):
            if text[i:i + n] in seen:
                gone[i:i + n] = [True] * n
            seen.add(text[i:i + n])
        spans = sum(g and not p for g, p in zip(gone, [False] + gone))
        out[doc_id] = (len(text), sum(gone), spans, bytes(b for b, g in zip(text, gone) if not g))
    return out


def mixed_copies(sized, target):
    """Copies of each (key, source, size): whole ones, and one more for the draws up to the best limit of the source."""
    draw = lambda key: int(hashlib.md5(f"20240607:{key}".encode()).hexdigest()[:13], 16) / (1 << 52)
    out = {}
    for source in {s for _, s, _ in sized}:
        own = [(draw(key), size, key) for key, s, size in sized if s == source]
        total = sum(size for _, size, _ in own)
        rate = target[source] / total if total else 1
        rest, words, best = target[source] - int(rate) * total, 0, None
        for d in sorted({d for d, _, _ in own}):
            words += sum(size for other, size, _ in own if other == d)
            if best is None or (abs(words - rest), d) < best:
                best = (abs(words - rest), d)
        limit = best[1] if best[0] < rest else -1
        out |= {(key, source): int(rate) + (d <= limit) for d, _, key in own}
    return out
