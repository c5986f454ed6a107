"""Token alignment against both libraries and plain loops over tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from caseflow.llm import alignment
from caseflow.llm.token_count import byte_letters, tokenizer_path
from tests.llm.conftest import SCHEMA


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(tokenizer_path(alignment.BYTE_TOKENIZER))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(alignment.PIECE_TOKENIZER))
    byte_of = {c: n for n, c in byte_letters().items()}

    def tokens(text):
        if not text:
            return [], [], [], []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return [], [], [], []
        ends = [np.cumsum([len(x) for x in t]).tolist() for t in (bytes_a, bytes_b)]
        return ids_a, ids_b, *ends
    return tokens


def brute(tokens, rows):
    """One result for each (doc_id, text)."""
    linked, out = [], []
    for _, text in rows:
        a, b, end_a, end_b = tokens(text)
        groups, links, i, j = [], Counter(), 0, 0
        for cut in sorted(set(end_a) & set(end_b)):
            x, y = [k for k in range(i, len(a)) if end_a[k] <= cut], [k for k in range(j, len(b)) if end_b[k] <= cut]
            for p in x:
                for q in y:
                    if max(end_a[p - 1] if p else 0, end_b[q - 1] if q else 0) < min(end_a[p], end_b[q]):
                        links[a[p], b[q]] += 1
            groups.append(",".join(str(a[k]) for k in x) + "|" + ",".join(str(b[k]) for k in y))
            i, j = i + len(x), j + len(y)
        linked.append(links)
        out.append((len(a), len(b), len(groups), sum(links.values()), ";".join(groups)))
    count = Counter(p for links in linked for p in links)
    best = defaultdict(int)
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    return Counter((d, *o[:4], sum(n for p, n in links.items() if count[p] == best[p[0]]),
                    sum(n * count[p] for p, n in links.items()), hashlib.sha256(o[4].encode()).hexdigest() if o[4] else "")
                   for (d, _), o, links in zip(rows, out, linked))


MORE = [(950, " two  blanks and\ttab\n\n new\r\nline ", "en", "a", 0), (951, "<|endoftext|> <s> </s> <0x0A> <unk>", "en", "a", 0),
        (952, "▁ a piece sign", "en", "a", 0), (953, "字🙂\x00 \x1c naïve café", None, None, 0), (954, " ", "en", "a", 0)]


def test_alignment(docs, rows, libraries):
    df = docs.union(docs.sparkSession.createDataFrame(MORE, SCHEMA))
    want = brute(libraries, [(d, t) for d, t, *_ in rows + MORE])
    assert Counter(map(tuple, alignment.align(df).collect())) == want
    assert any(w[0] == 952 and w[1] == 0 for w in want)


def test_requests_of_few_texts_change_nothing(docs, monkeypatch):
    plain = Counter(map(tuple, alignment.align(docs).collect()))
    got = alignment.align(docs.repartition(3), with_groups=True).collect()
    assert Counter(tuple(r)[:-1] for r in got) == plain
    assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 for r in got)


def test_tokens_like_the_libraries(libraries):
    rng = random.Random(1)
    signs = list("aabé  \n\t\r'stmdlr12½!?-_,;)\x1c\x85\xa0　́字🙂\x00▁") + ["<|endoftext|>", "'ll", " the", "<s>", "</s>", ");\r\n"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    both = alignment.Tokenizers(*map(tokenizer_path, (alignment.BYTE_TOKENIZER, alignment.PIECE_TOKENIZER)))
    (a, n_a), (b, n_b) = both.tokens(texts)
    want = [libraries(t)[:2] for t in texts]
    assert a.tolist() == [i for x, _ in want for i in x] and b.tolist() == [i for _, x in want for i in x]
    assert n_a.tolist() == [len(x) for x, _ in want] and n_b.tolist() == [len(x) for _, x in want]
    assert 500 < (n_a == 0).sum() < 3500


def test_a_word_is_aligned_once(monkeypatch, libraries):
    """However often a word comes, its tokens are divided into groups once."""
    divided = []
    plain = alignment.leaf_groups
    monkeypatch.setattr(alignment, "leaf_groups", lambda a_end, *rest: divided.append(len(a_end)) or plain(a_end, *rest))
    both = alignment.Tokenizers(*map(tokenizer_path, (alignment.BYTE_TOKENIZER, alignment.PIECE_TOKENIZER)))
    words = ["alignment", "of", "unlikelywords", "again"]
    texts = ["", " ".join(words * 50), "of of alignment", " \u2581 of", " ".join(words[::-1])] * 20
    done = alignment.Aligned(both, texts)
    once = sum(len(libraries(w)[0]) for w in words)
    assert sum(divided) == once
    for k, t in enumerate(texts):
        a, b, end_a, end_b = libraries(t)
        assert (done.n_a[k], done.n_b[k], done.n_groups[k]) == (len(a), len(b), len(set(end_a) & set(end_b)))


def test_leaves_are_the_shared_ends():
    rng = np.random.default_rng(3)
    for share in (0.02, 0.3, 0.9):
        at_a, at_b, spans = [], [], []
        last = 0
        for _ in range(30):  # texts one after another
            n = int(rng.integers(1, 400))
            ends = np.arange(1, n + 1)
            x = np.append(ends[:-1][rng.random(n - 1) < share], n) + last
            y = np.append(ends[:-1][rng.random(n - 1) < share], n) + last
            spans.append((len(x), len(y)))
            at_a.append(x), at_b.append(y)
            last += n
        a, b = np.concatenate(at_a), np.concatenate(at_b)
        a_to, b_to = np.cumsum([x for x, _ in spans]), np.cumsum([y for _, y in spans])
        groups = alignment.leaf_groups(a, b, np.append(0, a_to[:-1]), a_to, np.append(0, b_to[:-1]), b_to)
        shared = np.intersect1d(a, b)
        assert (a[groups[1] - 1] == shared).all() and (b[groups[3] - 1] == shared).all()
        assert (groups[0][1:] == groups[1][:-1]).all() and (groups[2][1:] == groups[3][:-1]).all()
        link_a, link_b = alignment.overlaps(a, b, groups)
        start_a, start_b = np.append(0, a[:-1]), np.append(0, b[:-1])
        want = {(i, j) for i in range(len(a)) for j in range(max(0, np.searchsorted(b, start_a[i]) - 1), len(b))
                if start_b[j] < a[i] and max(start_a[i], start_b[j]) < min(a[i], b[j])}
        assert set(zip(link_a.tolist(), link_b.tolist())) == want and len(link_a) == len(want)


def test_empty_table_clashing_names_and_long_text(spark, docs, no_docs, clashing, libraries):
    assert alignment.align(no_docs).collect() == []
    assert Counter(map(tuple, alignment.align(clashing).collect())) == Counter(map(tuple, alignment.align(docs).collect()))
    long = "".join(chr(97 + i * i % 23) for i in range(20_000)) + " tail" * 250_000
    df = spark.createDataFrame([(1, long, None, None, 0), (2, "tail", None, None, 0), (2, "tail", None, None, 0)], SCHEMA)
    got = {r.doc_id: r for r in alignment.align(df.coalesce(1)).collect()}
    a, b, end_a, end_b = libraries(long)
    assert (got[1].n_a, got[1].n_b, got[1].n_groups) == (len(a), len(b), len(set(end_a) & set(end_b)))
    assert got[2].n_best == got[2].n_links and got[2].count_sum == 3 * got[2].n_links
