"""The whole pipeline against a plain version, and its stages' contract."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from caseflow.llm import packing
from caseflow.llm.quality import LEAST_WORDS, MOST_DUP, MOST_DUP_LINE_CHARS, MOST_REPEAT_PERCENT, MOST_TOP
from tests.llm import brute
from tests.llm.conftest import SCHEMA
from tests.llm.test_operators import library, water_level


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = [(d, text(rng.randint(20, 160)), "en", rng.choice("aaab") + rng.choice(["", "1"]), 0) for d in range(120)]
    rows += [(200 + k, rows[k][1], "en", "b", 0) for k in range(15)]  # copies
    rows += [(300 + k, rows[k][1] + ".", "en", "c", 0) for k in range(20, 35)]  # near copies
    rows += [(400 + k, ("spam and more " * 30) + text(10), "en", "a", 0) for k in range(5)]  # repeats itself
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0), (502, "\n".join([text(12)] * 9), "en", None, 0),
             (503, text(6000), "en", "a", 0)]
    return rows


def good(text):
    m = brute.quality(text)
    return not (m["n_words"] < LEAST_WORDS or 100 * m["n_repeat_words"] > MOST_REPEAT_PERCENT * m["n_words"]
                or m["dup_line_chars"] > MOST_DUP_LINE_CHARS * m["word_chars"]
                or any(m[f"top{n}"] > x for n, x in MOST_TOP.items()) or any(m[f"dup{n}"] > x for n, x in MOST_DUP.items()))


def plain_pipeline(rows):
    """Pieces (doc_id, piece, start, length, crc) of the mixed corpus."""
    rows = [r for r in rows if good(r[1])]
    last = {r[1]: r for r in sorted(rows, key=lambda r: r[0])}  # of equal texts the largest id
    rows = list(last.values())
    rows = [r for r, (_, least) in zip(rows, brute.near_components([r[:2] for r in rows])) if r[0] == least]
    size = Counter()
    for r in rows:
        size[r[3]] += len(brute.words_of(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, water_level([size[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2)))
    copies = brute.mixed_copies([(str(d), s, len(brute.words_of(t))) for d, t, _, s, _ in rows], target)
    encode, out = library(packing.TOKENIZER).encode, Counter()
    for d, text, _, source, _ in rows:
        ids = encode(text, add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k:k + 4096]
            crc = zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            out[(d, k // 4096, k, len(part), crc)] += copies[str(d), source]
    return +out


def test_pipeline_like_the_plain_version(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain_pipeline(rows)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert sum(n for _, n in places) <= 4096
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]


def test_stages_but_the_last_return_the_columns_of_documents(spark):
    rows = corpus()[:60] + [corpus()[0]]
    docs = spark.createDataFrame(rows, SCHEMA).persist()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mix",
                                                           "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
