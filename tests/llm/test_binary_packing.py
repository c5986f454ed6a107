"""Power-of-two packing against ids of the tokenizer's library."""

import struct
import zlib
from collections import Counter, defaultdict

import pytest

from caseflow.llm import binary_packing, token_count
from tests.llm.conftest import SCHEMA


def ids_of(text):
    from tokenizers import Tokenizer
    if not hasattr(ids_of, "encode"):
        ids_of.encode = Tokenizer.from_file(token_count.tokenizer_path(binary_packing.TOKENIZER)).encode
    return ids_of.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize("capacity", [4096, 64, 1])
def test_pieces_are_binary_and_whole(docs, rows, capacity):
    want = Counter()
    for d, t, *_ in rows:
        ids, at = ids_of(t), 0
        lengths = [capacity] * (len(ids) // capacity) + [1 << b for b in range(12, -1, -1)
                                                        if 1 << b < capacity and len(ids) % capacity >> b & 1]
        for n in lengths:
            want[d, at, n, crc(ids[at:at + n]), len(ids)] += 1
            at += n
        assert at == len(ids)
    got = binary_packing.decompose(docs, capacity, with_ids=True).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    assert all(r.length == 1 << r.bucket == len(r.ids) and crc(r.ids) == r.ids_crc32 for r in got)
    order = sorted(got, key=lambda r: r.sequence_id)
    assert [r.bucket for r in order] == sorted(r.bucket for r in got)


def test_empty_table_clashing_names_and_capacity(docs, no_docs, clashing):
    assert binary_packing.decompose(no_docs).collect() == []
    plain, other = (sorted(map(str, binary_packing.decompose(x).drop("sequence_id").collect())) for x in (docs, clashing))
    assert plain == other
    with pytest.raises(ValueError):
        binary_packing.decompose(docs, 100)


def test_text_above_a_chunk_and_repeated_rows(spark):
    long = "some words and more of them " * 100_000  # 2.8 MB
    df = spark.createDataFrame([(1, long, None, None, 0)] + [(2, "a b c", "en", "a", 5)] * 3, SCHEMA).coalesce(1)
    got = defaultdict(list)
    for r in binary_packing.decompose(df).collect():
        got[r.doc_id].append(r)
    n = len(ids_of(long))
    assert sum(r.length for r in got[1]) == n and sum(r.length == 4096 for r in got[1]) == n // 4096
    assert len(got[2]) == 3 and {r.doc_tokens for r in got[2]} == {4}  # 4 ids are one piece of 4


def test_buckets_are_folders(docs, tmp_path):
    path = str(tmp_path / "sequences")
    binary_packing.write_buckets(binary_packing.decompose(docs, 64), path)
    back = docs.sparkSession.read.parquet(path)
    assert back.filter("length != shiftleft(1, bucket)").count() == 0
    assert back.filter("bucket = 6").select("length").distinct().collect()[0][0] == 64
