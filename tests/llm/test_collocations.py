"""Collocations against plain counters of all phrases."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from caseflow.llm import collocations as phrases
from caseflow.llm.queries import ORACLE
from tests.llm.conftest import SCHEMA


def counted(rows):
    f = defaultdict(Counter)
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, 5):
                f["und" if lang is None else lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    return f


def brute(rows, least, top):
    out = []
    for lang, f in counted(rows).items():
        n_words = sum(v for k, v in f.items() if len(k) == 1)
        candidates = [k for k, v in f.items() if len(k) > 1 and v >= least]
        inside = {k[i:i + n] for k in candidates for n in range(2, len(k)) for i in range(len(k) - n + 1)
                  if 100 * f[k] >= 80 * f[k[i:i + n]]}
        scored = []
        for k in set(candidates) - inside:
            score, cut = min((2000000 * f[k] // (f[k[:c]] + f[k[c:]]), c) for c in range(1, len(k)))
            scored.append((-score, -f[k], " ".join(k).encode(), f[k[:cut]], f[k[cut:]], cut))
        for rank, (score, a, phrase, left, right, cut) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n_words, -score, cut))
    return sorted(out)


def texts(n=150):
    """Few words in a row, so that pairs, loops and passages are frequent; separators of every kind."""
    rng = random.Random(5)
    vocabulary = ["a", "B", "b", "cc", "é", "the", "x-1", "\xa0"]
    passage = "one common passage of some words that goes on and on for long"
    rows = []
    for d in range(n):
        words = rng.choices(vocabulary, [8, 1, 4, 3, 2, 5, 1, 1], k=rng.randint(0, 40))
        text = "".join(w + rng.choice([" ", " ", " ", "\t ", ", ", "\n", ". ", "\r\n", "\x0b"]) for w in words)
        rows.append((d, rng.choice([text, text + passage, passage.upper(), "a b a b a b a b"]), rng.choice(["en", "en", "fr", None]), "s", 1))
    return rows + [(n, None, "en", "s", 0), (n, "", None, "s", 0), (None, "a", "de", "s", 0)] + rows[:3] * 2


@pytest.mark.parametrize("least,top", [(2, 2000), (30, 2000), (5, 4)])
def test_collocations(spark, least, top):
    rows = texts()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, phrases.collocations(df, least, top).collect()))
    assert got == brute([(r[2], r[1]) for r in rows], least, top) and got


def test_collocations_of_the_corpus(docs, rows):
    got = sorted(map(tuple, phrases.collocations(docs, 2).collect()))
    assert got == brute([(r[2], r[1]) for r in rows], 2, 2000) and len(got) > 100


def test_a_full_bit_set_changes_nothing(docs, rows, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 5)
    got = sorted(map(tuple, phrases.collocations(docs, 5).collect()))
    assert got == brute([(r[2], r[1]) for r in rows], 5, 2000)


@pytest.mark.parametrize("together,edges", [(7, 256), (1000, 2)])
def test_regions_and_parted_paths_change_nothing(monkeypatch, together, edges):
    rows = texts(60)
    monkeypatch.setattr(phrases, "PATH_EDGES", edges)
    total = Counter()
    for lo in range(0, len(rows), together):
        part = phrases.Region()
        for _, text, lang, *_ in rows[lo:lo + together]:
            if lang == "en":
                data, starts, _, joined = phrases.word_places([(text or "").encode()])
                if len(starts):
                    part.add(data.split(), joined)
        if part.words:
            for text, size, weight in zip(*part.rows()):
                assert len(text.split(b" ")) == size <= edges + 3
                total[text.decode(), size] += weight
    f = Counter()
    for (text, size), weight in total.items():
        w = text.split(" ")
        for i in range(max(1, size - 3)):
            for n in range(1, min(size, 4) + 1):
                f[tuple(w[i:i + n])] += weight
    want = counted([(r[2], r[1]) for r in rows])["en"]
    assert f == +want


def test_texts_come_in_batches_of_bounded_size(spark, docs, monkeypatch):
    from caseflow import session

    def sizes(batches):
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes for b in batches])], ["n"])

    long = spark.range(0, 3000, 1, 1).selectExpr("repeat('abc', 1000) as text").mapInArrow(sizes, "n bigint")
    default = spark.conf.get(session.ARROW_BATCH_BYTES)
    with session.arrow_batches(spark, 1 << 20):
        got = [r.n for r in long.collect()]
    assert len(got) > 5 and max(got) <= 1.1 * (1 << 20)
    assert spark.conf.get(session.ARROW_BATCH_BYTES) == default
    limits, plain = [], phrases.materialize
    monkeypatch.setattr(phrases, "materialize", lambda df: limits.append(spark.conf.get(session.ARROW_BATCH_BYTES)) or plain(df))
    phrases.phrase_counts(docs, 2)
    assert limits[:2] == [str(phrases.BATCH_BYTES)] * 2  # the two passes over the texts
    assert spark.conf.get(session.ARROW_BATCH_BYTES) == default


def test_paths_are_compact():
    region = phrases.Region()
    data, _, _, joined = phrases.word_places([b"p q r s t u v w x y z\np q r s t u v w x y z"])
    region.add(data.split(), joined)
    paths = [row for row in zip(*region.rows()) if row[1] > 3]
    assert paths == [(b"p q r s t u v w x y z", 11, 2)]


def test_empty_table_clashing_names_large_counts_and_long_text(spark, docs, no_docs, clashing):
    assert phrases.collocations(no_docs).collect() == []
    assert sorted(map(tuple, phrases.collocations(clashing, 2).collect())) == sorted(map(tuple, phrases.collocations(docs, 2).collect()))
    long = "alpha beta gamma delta " * 120_000  # one piece of 2.8 MB
    got = phrases.collocations(spark.createDataFrame([(1, long, "en", "a", 0)], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute([("en", long)], 30, 2000)


def test_sql_twin(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, phrases.collocations(spark.read.parquet(f"{sf}/documents.parquet")).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    result = con.execute(ORACLE["op13_collocations"])
    names = [c[0] for c in result.description]
    assert names == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut"]
    assert sorted(map(tuple, result.fetchall())) == got and got
