"""Every operator against a plain version, on documents with nulls, blanks, ties, copies and one long text."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from caseflow.llm import exact_dedup as exact
from caseflow.llm import langid, mixing, packing, pii, quality, sharding, simhash, suffix_dedup, token_count
from tests.llm import brute
from tests.llm.conftest import SCHEMA, as_set


def library(name):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(token_count.tokenizer_path(name))


def utf8(text):
    return (text or "").encode()


OPERATORS = {
    "suffix": suffix_dedup.remove_repeats, "quality": quality.quality, "exact": exact.exact_dedup,
    "simhash": simhash.near_duplicates, "pii": pii.pseudonymise, "mixing": mixing.mixing_plan,
    "tokens": token_count.count_tokens, "pack": packing.pack, "shard": sharding.shard_by_bytes,
    "language": lambda docs: langid.identify_languages(docs, langid.fit_languages(docs)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_and_clashing_names(name, docs, no_docs, clashing):
    assert OPERATORS[name](no_docs).collect() == []
    plain, other = OPERATORS[name](docs), OPERATORS[name](clashing)
    assert plain.columns == other.columns and plain.count() == other.count()


@pytest.mark.parametrize("stage", [quality.keep_good, exact.keep_one, simhash.keep_one, mixing.mix])
def test_filters_return_the_columns_they_got(stage, docs, no_docs, clashing):
    assert stage(no_docs).collect() == [] and stage(no_docs).columns == no_docs.columns
    assert stage(clashing).columns == clashing.columns
    assert as_set(stage(clashing).select(docs.columns)) == as_set(stage(docs))


def test_suffix_dedup(spark, rows):
    whole = {d: t for d, t, *_ in rows if d is not None and d != 8}  # ids that occur with one text
    df = spark.createDataFrame([(d, t) for d, t in whole.items()], "doc_id bigint, text string").repartition(4)
    for n, digit in ((100, 32), (20, 8), (12, 12)):
        want = {d: (a, b, c, hashlib.sha256(kept).hexdigest())
                for d, (a, b, c, kept) in brute.remove_repeats([(d, utf8(t)) for d, t in whole.items()], n).items()}
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
               for r in suffix_dedup.remove_repeats(df, n, digit).collect()}
        assert got == want
        assert any(b for _, b, *_ in want.values())


def test_suffix_dedup_repeated_rows_ids_and_texts(spark):
    long = "".join(chr(97 + (i * i) % 23) + str(i) for i in range(200))
    df = spark.createDataFrame([(None, long), (3, long), (3, long), (3, long + "!"), (9, "a" * 250)],
                               "doc_id bigint, text string").repartition(3)
    got = suffix_dedup.remove_repeats(df, with_text=True).collect()
    assert len(got) == 5
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    assert by_id[9][0].n_removed == 249 and by_id[9][0].kept == b"a"  # overlapping repeats within one text
    assert by_id[None][0].n_removed == len(long)
    # the repeated row is one document; of the texts of one id one is earlier than the other
    removed = sorted((r.n_bytes, r.n_removed) for r in by_id[3])
    assert removed[0] == removed[1]
    assert removed in ([(len(long), 0)] * 2 + [(len(long) + 1, len(long))],
                       [(len(long), len(long))] * 2 + [(len(long) + 1, 0)])


def test_quality(docs):
    got = quality.quality(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in got:
        if r.doc_id in (7, 8):
            continue
        want = brute.quality(r.text)
        for name, value in want.items():
            assert r[name] == pytest.approx(value), (r.doc_id, name)
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r.base_failed == failed and not (failed and r.kept)
    assert any(r.kept for r in got) and any(not r.kept for r in got)


@pytest.mark.parametrize("keep,hot_rows", [("max", None), ("min", None), ("max", 2), ("min", 1)])
def test_exact_dedup(docs, rows, keep, hot_rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[t or ""].append(d)
    best = {t: {"max": max, "min": min}[keep]((d for d in g if d is not None), default=None) for t, g in groups.items()}
    want = Counter((d, best[t or ""], len(groups[t or ""]), hashlib.sha256(utf8(t)).hexdigest()) for d, t, *_ in rows)
    got = exact.exact_dedup(docs, keep, hot_rows=hot_rows).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert sorted(h for _, h in kept) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    stay = exact.keep_one(docs, keep, hot_rows).collect()
    assert Counter((r.doc_id, r.text or "") for r in stay) == Counter((best[t], t) for t in groups)


def test_exact_dedup_decides_nothing_by_a_digest(docs, monkeypatch):
    plain = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(docs).collect())
    for name in ("sha2", "md5"):
        monkeypatch.setattr(exact.F, name, lambda *a: F.lit("one digest for all"))
    for hot_rows in (None, 2):
        got = exact.exact_dedup(docs, hot_rows=hot_rows).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == plain
        assert {r.text_sha256 for r in got} == {"one digest for all"}


def test_exact_dedup_of_one_key_and_of_a_hot_text_without_ids(spark):
    front, end = "f" * 40, "e" * 40
    same_key = [(k, front + f"{k % 5}" + "m" * 100 + end) for k in range(60)]  # front, middle, end and length agree
    df = spark.createDataFrame(same_key + [(None, "hot")] * 300 + [(7, "hot"), (7, "hot"), (1000, "x" * 3_000_000),
                                                                   (1001, "x" * 3_000_000)], "doc_id long, text string")
    df = df.repartition(6)
    for hot_rows in (None, 10):
        got = exact.exact_dedup(df, hot_rows=hot_rows).collect()
        assert Counter((r.keep_id, r.group_size) for r in got if r.kept) == Counter(
            {(7, 302): 1, (1001, 2): 1} | {(55 + k, 12): 1 for k in range(5)})
        assert sorted(r.doc_id for r in exact.keep_one(df, hot_rows=hot_rows).collect()) == [7, 55, 56, 57, 58, 59, 1001]
    sizes = (exact.content_sorted(df.select("doc_id", F.col("text").alias("body")), "max", 10)
             .filter("body = 'hot'").groupBy("stretch").count().collect())
    assert len(sizes) > 20 and max(r["count"] for r in sizes) < 40  # rows without an id are spread as well


def test_simhash(docs, rows):
    want = Counter((d, f, c) for (d, *_), (f, c) in zip(rows, brute.near_components([(d, t) for d, t, *_ in rows])))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.keep_one(docs).collect()
    heads = {c for _, _, c in want}
    assert {r.doc_id for r in kept} == heads


def test_simhash_links_of_dense_groups(spark, monkeypatch):
    import random

    import numpy as np
    rng, fps = random.Random(2), set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(400):
            x = centre
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3):
            root[find(i)] = find(int(j))
    want = Counter(Counter(find(i) for i in range(len(fps))).values())
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint").repartition(3)
    from caseflow.llm.components import components
    found = Counter(r.root for r in components(simhash.links(df)).collect())
    assert Counter(found.values()) == Counter({k: v for k, v in want.items() if k > 1})
    # one bucket alone, cut again by its other bits, connects the same members
    low = np.unique(fps & np.uint64(0xFFFFFF0F) | fps[0] & np.uint64(0xFFFFFFFF00000000))
    signature = np.full(len(low), (1 << 38) | (32 << 32))
    pieces = []
    for large in (4096, 20):
        monkeypatch.setattr(simhash, "LARGE_GROUP", large)
        a, b = simhash.link_groups(signature, low, 3)
        assert (np.bitwise_count(a ^ b) <= 3).all()
        group = {int(x): int(x) for x in low}

        def top(x):
            while group[x] != x:
                x = group[x]
            return x
        for x, y in zip(a.tolist(), b.tolist()):
            group[top(x)] = top(y)
        pieces.append(Counter(Counter(top(int(x)) for x in low).values()))
    assert pieces[0] == pieces[1]


def luhn_ok(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def test_pseudonyms(spark):
    import datetime as dt
    import re
    values = {
        "card": ["4465758382889437", "4111-1111-1111-1111", "378282246310005"], "ssn": ["123-45-6789", "899-01-0001"],
        "phone": ["+1 (743) 555-3824", "743-555-3824"], "ip": ["233.233.171.252", "7.0.0.1"],
        "mail": ["orpc.76@mail3.example.com"], "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
        "date": ["1984-02-29", "25/12/1999", "12/25/1999", "31.12.2001"],
        "secret": ["11acdfb36bb72224148e6160f674b4be45601bff"], "abroad": ["+49 151 2345 6789"]}
    invalid = ["4111111111111112", "666-12-1234", "000-11-2222", "300.1.1.1", "2.0.", "1984-02-30", "2001/13/01",
               "GB82WEST12345698765433", "1234", "01.2.3.4"]
    flat = [v for vs in values.values() for v in vs]
    texts = [f"see {v}!! and {v}### end" for v in flat] + [f"keep {v} as is" for v in invalid] + [None, "", "no numbers"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df).collect()}
    new = {}
    for k, v in enumerate(flat):
        a, b = re.fullmatch(r"see (.*)!! and (.*)### end", got[k].text).groups()
        assert a == b != v and got[k].n_replaced == 2  # equal values stay equal
        assert v in values["ip"] or re.sub(r"\d", "9", a) == re.sub(r"\d", "9", v) or "@" in v \
            or v in values["iban"] + values["secret"]
        assert [len(x) for x in re.split(r"\W", a)] == [len(x) for x in re.split(r"\W", v)] or v in values["ip"]
        new[v] = a
    for v in values["card"]:
        assert luhn_ok(re.sub(r"\D", "", new[v]))
    for v in values["iban"]:
        plain = new[v].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    for v in values["ip"]:
        assert all(0 <= int(o) <= 255 for o in new[v].split("."))
    for v, form in zip(values["date"], ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d.%m.%Y"]):
        assert dt.date(1900, 1, 1) <= dt.datetime.strptime(new[v], form).date() <= dt.date(2099, 12, 31)
    assert re.sub(r"\D", "", new["+1 (743) 555-3824"])[1:] == re.sub(r"\D", "", new["743-555-3824"])
    assert all(got[len(flat) + k].text == f"keep {v} as is" for k, v in enumerate(invalid))
    assert [got[len(texts) - k].text for k in (3, 2, 1)] == [None, "", "no numbers"]
    other = {r.doc_id: r.text for r in pii.pseudonymise(df, key="another key").collect()}
    assert all(other[k] != got[k].text for k in range(len(flat)))


def test_pseudonyms_are_permutations(spark):
    pairs = spark.range(4297 * 17).select(
        pii.permuted_pair(F.floor(F.col("id") / 17), F.col("id") % 17, pii.DAYS, "date", "k").alias("p"))
    assert pairs.distinct().count() == 4297 * 17
    digits = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    new = digits.select(pii.permuted(F.col("d"), F.lit("999"), "x", "k").alias("n"))
    assert {r.n for r in new.collect()} == {f"{k:03d}" for k in range(1000)}
    days = spark.range(73049).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")),
                                                   "dd/MM/yyyy").alias("text"), F.col("id").alias("doc_id"))
    day_first = days.filter("substring(text, 1, 2) > '12' and doc_id % 7 = 0")
    out = [r.text for r in pii.pseudonymise(day_first).collect()]
    assert len(set(out)) == len(out) and all(t[:2] > "12" for t in out)


def water_level(sizes, weights, share, most):
    """Targets by handing the excess out again and again."""
    wanted, target, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left, weight = wanted - sum(target[k] for k in range(len(sizes)) if k not in free), sum(weights[k] for k in free)
        for k in free:
            target[k] = left * weights[k] / weight
        over = {k for k in free if target[k] > most * sizes[k]}
        for k in over:
            target[k] = most * sizes[k]
        if not over:
            break
        free -= over
    return target


def test_mixing(docs, rows):
    size = lambda t: len(brute.words_of(t))
    total = Counter()
    for _, t, _, s, _ in rows:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, water_level([total[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2)))
    got = mixing.mixing_plan(docs).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((d, s, size(t)) for d, t, _, s, _ in rows)
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        rate = target[r.source] / total[r.source] if total[r.source] else 1
        assert int(rate) <= r.copies <= int(rate) + 1 and r.taken == r.copies * r["size"] <= 2 * r["size"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(total.values()))
    assert as_set(mixing.mixing_plan(docs.repartition(3))) == as_set(mixing.mixing_plan(docs))  # reruns agree
    mixed = Counter(r.text for r in mixing.mix(docs).collect())
    want = Counter()
    for r, times in Counter((r.doc_id, r.copies, r["size"]) for r in got).items():
        want[r[2]] += r[1] * times
    assert Counter({k: v for k, v in want.items() if v}) == sum((Counter({size(t): n}) for t, n in mixed.items()), Counter())


def test_mixing_meets_targets(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text",
                                       "concat('s', id % 3) as source")
    plan = mixing.mixing_plan(df).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 7 / 2 for r in plan)


def test_mixing_meets_targets_of_small_sources(spark):
    """Few and uneven documents: the miss stays within half a document; a source without words beside others, ties."""
    rows = [(k, "w " * (1 + k * k % 90), "en", "abc"[k % 3], 0) for k in range(40)]
    rows += [(100 + k, "", "en", "empty", 0) for k in range(3)] + [(200, "w " * 50, "en", None, 0)] * 3 + [(None, "x y", "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    plan = mixing.mixing_plan(docs).collect()
    target = {r.source: r.target for r in plan}
    key = lambda d, t: str(d) if d is not None else hashlib.md5(t.encode()).hexdigest()
    want = brute.mixed_copies([(key(d, t), s, len(t.split())) for d, t, _, s, _ in rows], target)
    assert Counter((r.doc_id, r.source, r.copies) for r in plan) == \
        Counter((d, s, want[key(d, t), s]) for d, t, _, s, _ in rows)
    for s in "abc":
        assert abs(sum(r.taken for r in plan if r.source == s) - target[s]) <= max(r["size"] for r in plan if r.source == s) / 2
    assert [r.copies for r in plan if r.source == "empty"] == [1, 1, 1]
    assert sorted(Counter(r.doc_id for r in mixing.mix(docs).collect()).items(), key=str) == \
        sorted(((d, n) for d, n in (Counter(x for r in plan for x in [r.doc_id] * r.copies)).items()), key=str)


def test_token_counts(docs, rows):
    encode = library(token_count.TOKENIZER).encode
    extra = [(900, "<|endoftext|> it's <|endoftext|><|endoftext|>x", None, None, 0), (901, "a" * 3000 + " \n\n  b", None, None, 0)]
    df = docs.union(docs.sparkSession.createDataFrame(extra, SCHEMA))
    want = Counter()
    for d, t, *_ in rows + extra:
        n = len(encode(t or "", add_special_tokens=False).ids)
        want[(d, len(utf8(t)), n, n > 512)] += 1
    assert Counter(map(tuple, token_count.count_tokens(df).collect())) == want


def test_token_merging_like_the_library():
    import random
    rng, encode = random.Random(1), library(token_count.TOKENIZER).encode_batch
    signs = list("aabé  \n\t'stmdlr12½!?-_\x1c\x85\xa0　́字🙂\x00") + ["<|endoftext|>", "'ll", " the"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    merge = token_count.merger(token_count.tokenizer_path(token_count.TOKENIZER))
    assert merge.count(texts) == [len(e.ids) for e in encode(texts, add_special_tokens=False)]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit_languages(docs.filter(~held_out))
    got = langid.identify_languages(docs, model).join(docs.filter(held_out).select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_counts_are_those_of_all_grams():
    import numpy as np
    text = "Ab c" * 5
    points = [ord(c) for c in text.lower()]
    assert sum(len(b) for b in langid.buckets_of(text)) == sum(len(points) - n + 1 for n in langid.LENGTHS)
    whole = np.sort(np.concatenate(list(langid.buckets_of(text))))
    old, langid.CHUNK_CHARS = langid.CHUNK_CHARS, 7
    try:
        assert (np.sort(np.concatenate(list(langid.buckets_of(text)))) == whole).all()
    finally:
        langid.CHUNK_CHARS = old


def test_language_without_letters_or_labels(docs, no_docs):
    model = langid.fit_languages(docs)
    got = {r.doc_id: r for r in langid.identify_languages(docs, model).collect()}
    for r in docs.collect():
        letters = any(c.isalpha() for c in r.text or "")
        if not letters:
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
    assert {r.lang_pred for r in langid.identify_languages(docs, langid.fit_languages(no_docs)).collect()} == {"und"}


def ids_of(encode, text):
    return encode(text or "", add_special_tokens=False).ids + [1]


def test_packing(docs, rows):
    encode = library(packing.TOKENIZER).encode
    for capacity in (4096, 64):
        got = packing.pack(docs, capacity).collect()
        want = Counter()
        for d, t, *_ in rows:
            ids = ids_of(encode, t)
            for k in range(0, len(ids), capacity):
                part = ids[k:k + capacity]
                want[(d, k // capacity, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for places in bins.values():
            places.sort()
            assert places[0][0] == 0 and sum(n for _, n in places) <= capacity
            assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        total = sum(r.length for r in got)
        assert len(bins) <= 1.1 * total / capacity + 2


def test_packing_ids_like_the_library():
    import random

    import numpy as np
    rng, encode = random.Random(1), library(packing.TOKENIZER).encode_batch
    signs = list("aabJHTWYéÉßÀ×  \n\t'stmdl12½!?-_\x1c\x85\xa0́̌字🙂Σςİ.,\"()<|>") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'ll"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 20))) for _ in range(5000)]
    words = packing.word_ids(packing.tokenizer_path(packing.TOKENIZER))
    want = [np.array(e.ids, "<u4").tobytes() for e in encode(texts, add_special_tokens=False)]
    assert words.of([t.encode() for t in texts]) == want


def test_best_fit_fills_bins():
    import random
    rng = random.Random(4)
    sizes = [rng.randint(1, 900) for _ in range(3000)]
    bins = packing.best_fit(sizes, 1000)
    assert sorted(k for b in bins for k in b) == list(range(3000))
    assert all(sum(sizes[k] for k in b) <= 1000 for b in bins)
    assert len(bins) <= 1.02 * sum(sizes) / 1000 + 1


def test_sharding(docs, rows):
    got = sharding.shard_by_bytes(docs, shards=4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (d, len(utf8(t)) + 1, zlib.crc32(utf8(t))) for d, t, *_ in rows)
    total = sum(r["size"] for r in got)
    largest = max(r["size"] for r in got)
    for s in range(4):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= largest
        assert all(r.law == "bytes" and r.grown_shard is None for r in own)


def test_sharding_keeps_small_groups_whole_and_parts_large_ones(spark):
    small = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id div 5) as text")
    got = sharding.shard_by_bytes(small).groupBy("text_crc32").agg(F.countDistinct("shard").alias("n"))
    assert got.filter("n > 1").count() == 0
    hot = spark.range(4000).selectExpr("id as doc_id", "if(id % 2 = 0, 'the same', concat('text ', id)) as text")
    sizes = [r["sum(size)"] for r in sharding.shard_by_bytes(hot).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 40


@pytest.mark.parametrize("together", [100_000, 150])
def test_packing_of_input_ordered_by_length(spark, monkeypatch, together):
    monkeypatch.setattr(packing, "PIECES_TOGETHER", together)
    df = spark.range(1600).selectExpr("id as doc_id", "repeat('a ', if(id < 800, 2399, 1599)) as text").repartitionByRange(8, "doc_id")
    got = packing.pack(df).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in got) == 800 * 4000 and max(r.n for r in got) <= 4096
    assert len(got) <= 830  # 800 are the fewest possible


def test_packing_of_copies_without_ids(spark):
    df = spark.range(500).selectExpr("cast(null as bigint) as doc_id", "repeat('a ', 1023) as text").repartition(5)
    got = packing.pack(df).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert [r.n for r in got] == [4096] * 125


def test_pseudonyms_behind_rejected_candidates(spark):
    values = ["ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "4111 1111 1111 1111"]
    texts = ["pay {} BIC: CAIXESBB", "pay {} EUR", "in 2024 {} paid", "REF ID42 CARD {}", "call +49 151 2345 6789 2024 {}"]
    cases = [(values[0], texts[0]), (values[1], texts[0]), (values[1], texts[1]), (values[0], texts[1]),
             (values[2], texts[2]), (values[2], texts[3])]
    cases += [("+49 151 2345 6789", "call {} 2024 now"), (values[2], texts[4]), ("10.20.30.40", "{}")]
    df = spark.createDataFrame([(k, t.format(v)) for k, (v, t) in enumerate(cases)]
                               + [(100 + k, f"is {v}") for k, (v, _) in enumerate(cases)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df).collect()}
    for k, (v, t) in enumerate(cases):
        new = got[100 + k].text[3:]
        assert new != v and got[100 + k].n_replaced == 1
        if k != 7:
            assert got[k].text == t.format(new) and got[k].n_replaced == 1, t
    assert got[7].text.endswith(got[107].text[3:]) and got[7].n_replaced == 2


def test_pseudonyms_of_plain_phone_numbers_and_timestamps(spark):
    texts = ["+12125551234", "2125551234", "212-555-1234", "212555-1234", "2024-03-05T10:00:00Z", "2024-03-05 10:00",
             "at 2024-03-05Texas", "1125551234", "21255512345"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {texts[r.doc_id]: r.text for r in pii.pseudonymise(df).collect()}
    plain = got["2125551234"]
    assert plain != "2125551234" and len(plain) == 10
    assert got["+12125551234"] == f"+1{plain}"
    assert got["212-555-1234"] == f"{plain[:3]}-{plain[3:6]}-{plain[6:]}" and got["212555-1234"] == f"{plain[:6]}-{plain[6:]}"
    day = got["2024-03-05 10:00"][:10]
    assert day != "2024-03-05" and got["2024-03-05T10:00:00Z"] == f"{day}T10:00:00Z"
    assert all(got[t] == t for t in texts[-3:])


def test_suffix_dedup_of_many_texts_without_an_id(spark):
    import random
    rng = random.Random(5)
    own = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    shared = own(120)
    rows = [(1, shared)] + [(None, own(150 + k % 300) + (shared if k % 3 == 0 else "")) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = {t: shared in t and d is None for d, t in rows}
    got = suffix_dedup.remove_repeats(df, with_text=True).collect()
    whole = sorted(r.kept.decode() for r in got if not r.n_removed)
    assert whole == sorted(t for t, cut in want.items() if not cut)
    rest = [r for r in got if r.n_removed]
    assert len(rest) == 1000 and all(120 <= r.n_removed < 130 and r.n_spans == 1 for r in rest)
    assert Counter(r.n_bytes for r in rest) == Counter(len(t) for t, cut in want.items() if cut)


def test_suffix_dedup_largest_id_is_not_a_missing_one(spark):
    shared = "".join(str(i * i) for i in range(60))
    rows = [(2 ** 63 - 1, shared), (None, shared), (2 ** 63 - 1, None), (None, None), (2 ** 63 - 1, "a" + shared)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    cut = Counter((r.doc_id, r.n_bytes, r.n_removed > 0) for r in got)
    n = len(shared)
    first = Counter({(None, n, True): 1, (None, 0, False): 1, (2 ** 63 - 1, 0, False): 1})
    # a null id is the last; of the two texts of the largest id one comes before the other
    assert cut in [first + Counter({(2 ** 63 - 1, n, x): 1, (2 ** 63 - 1, n + 1, not x): 1}) for x in (True, False)]


def test_suffix_dedup_of_a_row_repeated_in_many_tasks(spark):
    text = "".join(str(i * i) for i in range(120))
    df = spark.createDataFrame([(4, text + text)] * 8 + [(5, text)], "doc_id bigint, text string").repartition(8)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == {(4, 2 * len(text), len(text)): 8, (5, len(text), len(text)): 1}


def test_simhash_keeps_one_row_of_each_group(spark):
    text = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    a, b, c, d = (text(x, 300) for x in "abcd")
    rows = [(None, a), (None, a), (None, b), (5, b), (5, c), (3, c), (5, b), (7, d)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = simhash.keep_one(df).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(None, a), (5, b), (3, c), (7, d)])
