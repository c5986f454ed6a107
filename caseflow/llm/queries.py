"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.alignment import align
from caseflow.llm.binary_packing import decompose
from caseflow.llm.collocations import collocations
from caseflow.llm.common import table
from caseflow.llm.exact_dedup import exact_dedup
from caseflow.llm.langid import fit_languages, identify_languages
from caseflow.llm.mixing import mixing_plan
from caseflow.llm.packing import pack
from caseflow.llm.pii import pseudonymise
from caseflow.llm.quality import quality
from caseflow.llm.sharding import shard_by_bytes
from caseflow.llm.simhash import near_duplicates
from caseflow.llm.suffix_dedup import remove_repeats
from caseflow.llm.token_count import count_tokens


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings taken out of all documents."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of all documents."""
    return quality(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup over all documents; the largest id of equal texts stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal numbers, dates and addresses replaced by pseudonyms of their format."""
    return pseudonymise(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents to target weights: what each document gives."""
    plan = mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents: 3-word shingles, 3 differing bits at most."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those whose crc32(doc_id) mod 4 is not 2."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.filter(~held_out))
    return identify_languages(docs, model).withColumn("held_out", held_out)


def op9_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def op10_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 contiguous shards of nearly equal bytes."""
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op11_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into sequences whose lengths are powers of two up to 4096."""
    return decompose(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE and sentencepiece tokens of all documents, aligned where both end."""
    return align(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality": op2_quality,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash": op4_simhash,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_source_mix": op6_source_mix,
    "op7_token_counts": op7_token_counts,
    "op8_language": op8_language,
    "op9_packed_sequences": op9_packed_sequences,
    "op10_byte_shards": op10_byte_shards,
    "op11_binary_packing": op11_binary_packing,
    "op12_token_alignment": op12_token_alignment,
    "op13_collocations": op13_collocations,
}

ORACLE = {
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op6_source_mix": """
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5('20240607:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE
          / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS ws,
         sum(w) OVER () AS all_w, 1.5::DOUBLE * sum(source_size) OVER () AS wanted
  FROM sources
  WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, encode(source) NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, cap * (all_w - ws) <= (wanted - caps) * w AS is_full FROM ordered),
level AS (
  SELECT (max(wanted) - coalesce(sum(cap) FILTER (is_full), 0)) / sum(w) FILTER (NOT is_full) AS l FROM filled),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(cap, l * w) END AS target FROM filled, level),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS rate FROM targets),
placed AS (
  SELECT source, draw, sum(sum(size)) OVER (PARTITION BY source ORDER BY draw)::DOUBLE AS words
  FROM sized GROUP BY source, draw),
missed AS (
  SELECT p.source, draw, target - floor(rate) * source_size AS rest, abs(words - (target - floor(rate) * source_size)) AS miss
  FROM placed p JOIN rated r ON p.source IS NOT DISTINCT FROM r.source),
limits AS (
  SELECT source, CASE WHEN min(miss) < max(rest) THEN arg_min(draw, (miss, draw)) ELSE -1 END AS until
  FROM missed GROUP BY source),
drawn AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, (floor(r.rate) + (d.draw <= l.until)::INT)::INT AS copies
  FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
  JOIN limits l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM drawn
""",
    "op13_collocations": """
WITH low AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM low),
worded AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2),
                                           lambda i: array_to_string(w[i:i + size - 1], ' '))) AS gram
  FROM worded, (VALUES (1), (2), (3), (4)) AS s(size) WHERE len(w) >= size),
f AS (SELECT lang, size, gram, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(gram, ' ') AS w FROM f WHERE size > 1 AND f >= 30),
longer AS (
  SELECT lang, sub, max(f) AS inside FROM (
    SELECT lang, f, unnest(list_transform(range(1, size - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS sub
    FROM candidates, (VALUES (2), (3)) AS s(n) WHERE n < size) GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN longer o ON c.lang = o.lang AND c.gram = o.sub
  WHERE inside IS NULL OR 100::HUGEINT * inside < 80::HUGEINT * f),
cuts AS (
  SELECT k.lang, k.gram, k.f AS a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * k.f // (x.f + y.f))::BIGINT AS score
  FROM kept k JOIN (VALUES (1), (2), (3)) AS s(cut) ON cut < k.size
  JOIN f x ON x.lang = k.lang AND x.size = cut AND x.gram = array_to_string(k.w[1:cut], ' ')
  JOIN f y ON y.lang = k.lang AND y.size = k.size - cut AND y.gram = array_to_string(k.w[cut + 1:], ' ')),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(gram)) AS rank,
       gram AS phrase, a, l, r, n, score, cut
FROM least JOIN totals USING (lang)
QUALIFY rank <= 2000
""",
}
