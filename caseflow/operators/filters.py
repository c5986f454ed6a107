"""Event- and case-level filters (FLT-1..12).

Case-level filters follow one pattern: a per-case aggregate (map-side combined,
so a huge case costs one partial row per map task), then a semi / anti join on
``case_id``.  The join lets the event side keep one hash partitioning on
``case_id`` that later per-case windows reuse.  Case tables are not broadcast
(they grow with the data); AQE switches to a broadcast join at run time when the
aggregate turns out small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.operators.schema import ACT, CASE, IDX, TS
from caseflow.operators.sequence import DEFAULT_CHUNK_ROWS, ordered_scan
from caseflow.functions.scalar import attach_scalars, small_side

# Optional columns that join the default dedup key when present.
DEDUP_OPTIONAL_KEYS = ["lifecycle:transition", "org:resource", "EventID", "EventOrigin"]
# Lifecycle column candidates, in preference order.
LIFECYCLE_CANDIDATES = ["lifecycle:transition", "lifecycle", "transition"]


def dedup_keys(df: DataFrame, keys: list[str] | None = None) -> list[str]:
    if keys:
        return [k for k in keys if k in df.columns]
    return [CASE, ACT, TS] + [c for c in DEDUP_OPTIONAL_KEYS if c in df.columns]


def deduplicate_events(df: DataFrame, keys: list[str] | None = None, keep: str | bool = "first") -> DataFrame:
    """FLT-1: one event per key (nulls equal).  keep = first / last (by source order) / none.

    An aggregate, not a window: duplicates collapse map-side before the shuffle.
    """
    keys = dedup_keys(df, keys)
    others = [c for c in df.columns if c not in keys]
    payload = F.struct(*[F.col(f"`{c}`") for c in others])
    if keep == "first":
        agg = df.groupBy(*keys).agg(F.min_by(payload, F.col(IDX)).alias("_p"))
    elif keep == "last":
        agg = df.groupBy(*keys).agg(F.max_by(payload, F.col(IDX)).alias("_p"))
    elif keep in (False, "none", "False"):
        agg = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min_by(payload, F.col(IDX)).alias("_p"))
               .where("_n = 1"))
    else:
        raise ValueError(f"keep must be first / last / none, got {keep!r}")
    flat = {c: F.col(f"`{c}`") for c in keys}
    flat.update({c: F.col("_p")[c] for c in others})
    return agg.select(*[flat[c].alias(c) for c in df.columns])


def dedup_stats(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """FLT-2: rows, duplicates dropped (keep first), rate, groups with duplicates, max group size."""
    g = df.groupBy(*dedup_keys(df, keys)).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(
        F.sum("_n").cast("bigint").alias("n_rows"),
        F.sum(F.col("_n") - 1).cast("bigint").alias("n_dropped"),
        F.count_if(F.col("_n") > 1).cast("bigint").alias("n_dup_groups"),
        F.max("_n").cast("bigint").alias("max_group_size"),
    ).withColumn("dup_rate", F.try_divide(F.col("n_dropped"), F.col("n_rows")))


def case_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy(CASE).agg(F.count(F.lit(1)).alias("n_events"))


def keep_cases(df: DataFrame, cases: DataFrame) -> DataFrame:
    """Semi join on case_id (JON-3)."""
    return df.join(cases.select(CASE), CASE, "left_semi")


def drop_cases(df: DataFrame, cases: DataFrame) -> DataFrame:
    """Anti join on case_id (JON-4)."""
    return df.join(cases.select(CASE), CASE, "left_anti")


def filter_short_cases(df: DataFrame, min_events: int = 2) -> DataFrame:
    """FLT-3: keep cases with at least ``min_events`` events."""
    return keep_cases(df, case_sizes(df).where(F.col("n_events") >= min_events))


def case_length_threshold(df: DataFrame, percentile: float = 99.0, hard_max: int | None = None) -> DataFrame:
    """FLT-4 fit: one row ``threshold`` = int(linear percentile of case lengths), or ``hard_max``."""
    if hard_max is not None:
        return df.sparkSession.range(1).select(F.lit(int(hard_max)).cast("bigint").alias("threshold"))
    return case_sizes(df).agg(
        F.floor(F.percentile(F.col("n_events").cast("double"), F.lit(percentile / 100.0))).cast("bigint")
        .alias("threshold"))


def filter_case_length(df: DataFrame, percentile: float = 99.0, hard_max: int | None = None) -> DataFrame:
    """FLT-4: drop cases longer than the threshold (1-row aggregate, broadcast)."""
    thr = case_length_threshold(df, percentile, hard_max)
    long_cases = attach_scalars(case_sizes(df), thr).where(F.col("n_events") > F.col("threshold"))
    return drop_cases(df, long_cases)


def filter_zero_duration_cases(df: DataFrame) -> DataFrame:
    """FLT-5: drop cases whose last - first time is <= 0 (null duration kept)."""
    spans = df.groupBy(CASE).agg(F.min(TS).alias("_a"), F.max(TS).alias("_b"))
    return drop_cases(df, spans.where(F.col("_b") <= F.col("_a")))


def infrequent_activities(df: DataFrame, min_trace_freq: float = 0.005) -> DataFrame:
    """FLT-6 fit: activities seen in fewer than max(1, int(f * #cases)) distinct cases.

    The per-activity table is bounded by the activity vocabulary, so it is
    broadcast.  Distinct (activity, case) pairs are de-duplicated map-side.
    """
    n_cases = df.agg(F.count_distinct(CASE).alias("n_cases"))
    per_act = df.select(ACT, CASE).distinct().groupBy(ACT).agg(F.count(F.lit(1)).alias("trace_count"))
    thr = n_cases.select(F.greatest(F.lit(1), F.floor(F.col("n_cases") * F.lit(float(min_trace_freq))))
                         .cast("bigint").alias("min_count"))
    return attach_scalars(per_act, thr).where(F.col("trace_count") < F.col("min_count")).select(ACT)


def filter_infrequent_activities(df: DataFrame, min_trace_freq: float = 0.005) -> DataFrame:
    """FLT-6: drop events of infrequent activities (broadcast anti join, vocab-sized)."""
    return df.join(small_side(infrequent_activities(df, min_trace_freq)), ACT, "left_anti").select(*df.columns)


def filter_consecutive_duplicates(df: DataFrame, chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """FLT-7: drop an event whose activity equals the previous one in its case (skew-aware lag)."""
    s = ordered_scan(df, [TS, IDX], lags={"_prev_act": ACT}, chunk_rows=chunk_rows)
    return s.where(F.col("_prev_act").isNull() | (F.col("_prev_act") != F.col(ACT))).drop("_prev_act")


def case_variant_ids(df: DataFrame, chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Variant identity per case without collecting the case: (n_events, h1, h2).

    h1 / h2 are XORs of two independent 64-bit hashes of (position, activity);
    positions come from a skew-aware running count, the XOR is a plain
    (map-side combined) aggregate.  Two different variants share an id with
    probability ~2^-128.
    """
    s = ordered_scan(df.withColumn("_one", F.lit(1)), [TS, IDX], running_sum={"_pos": "_one"}, chunk_rows=chunk_rows)
    a = F.coalesce(F.col(ACT), F.lit("UNKNOWN"))
    return s.groupBy(CASE).agg(F.count(F.lit(1)).alias("n_events"),
                               F.bit_xor(F.xxhash64(F.lit(1), F.col("_pos"), a)).alias("_vh1"),
                               F.bit_xor(F.xxhash64(F.lit(2), F.col("_pos"), a)).alias("_vh2"))


def case_variants(df: DataFrame) -> DataFrame:
    """Variant text per case: activities in (timestamp, index) order joined by ``>``.

    For reports only; the text of a case is as long as the case.  Filters use
    ``case_variant_ids``.
    """
    g = df.groupBy(CASE).agg(F.sort_array(F.collect_list(F.struct(TS, IDX, ACT))).alias("_evs"))
    return g.select(CASE, F.concat_ws(">", F.col(f"_evs.{ACT}")).alias("variant"),
                    F.size("_evs").alias("n_events"))


def filter_rare_variants(df: DataFrame, min_variant_count: int = 5,
                         chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """FLT-8: drop cases whose variant occurs in fewer than ``min_variant_count`` cases."""
    v = case_variant_ids(df, chunk_rows)
    key = ["n_events", "_vh1", "_vh2"]
    counts = v.groupBy(*key).agg(F.count(F.lit(1)).alias("_vc"))
    rare = v.join(counts.where(F.col("_vc") < min_variant_count), key, "left_semi")
    return drop_cases(df, rare)


def case_starts(df: DataFrame) -> DataFrame:
    return df.groupBy(CASE).agg(F.min(TS).alias("case_start_time"))


def filter_since_date(df: DataFrame, since_date: str) -> DataFrame:
    """FLT-9: keep cases that start at or after ``since_date`` (UTC)."""
    cutoff = F.to_timestamp(F.lit(since_date))
    return keep_cases(df, case_starts(df).where(F.col("case_start_time") >= cutoff))


def filter_recent_pct(df: DataFrame, recent_pct: float = 80.0) -> DataFrame:
    """FLT-10: keep the latest ``recent_pct`` % of cases by start (ties by case_id).

    skip = int(n * (1 - p/100)) earliest cases are dropped.  The rank is a
    distributed global rank (see ``ranking.global_rank``), not a single-task window.
    """
    from caseflow.operators.ranking import global_rank

    starts = case_starts(df)
    ranked = global_rank(starts, [F.col("case_start_time"), F.col(CASE)], "_rank")
    n = starts.agg(F.count(F.lit(1)).alias("_n"))
    skip = n.select(F.floor(F.col("_n") * F.lit(1.0 - recent_pct / 100.0)).cast("bigint").alias("_skip"))
    keep = attach_scalars(ranked, skip).where(F.col("_rank") > F.col("_skip"))
    return keep_cases(df, keep)


def lifecycle_column(df: DataFrame, candidates=None) -> str | None:
    for c in candidates or LIFECYCLE_CANDIDATES:
        if c in df.columns:
            return c
    return None


def lifecycle_keep(df: DataFrame, keep: list[str] | None = None, candidates=None) -> DataFrame:
    """FLT-11: keep events whose trimmed, lower-cased lifecycle is in ``keep``; no-op without column."""
    col = lifecycle_column(df, candidates)
    if col is None or not keep:
        return df
    vals = [str(v).strip().lower() for v in keep]
    return df.where(F.lower(F.trim(F.col(f"`{col}`").cast("string"))).isin(*vals))


def lifecycle_drop(df: DataFrame, drop: list[str], col: str = "lifecycle:transition") -> DataFrame:
    """FLT-12: drop events whose lifecycle value is exactly in ``drop`` (nulls kept)."""
    if col not in df.columns or not drop:
        return df
    c = F.col(f"`{col}`")
    return df.where(c.isNull() | ~c.isin(*drop))
