"""Log profiling (AGG-1..24, SRC-6): each report is one or two aggregates.

Case-level numbers come from a per-case aggregate (partially aggregated, so a
hot case is cheap); percentiles are exact (``percentile``, linear) by default,
``approx=True`` switches to ``percentile_approx`` for very large logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.quantiles import exact_quantiles
from caseflow.functions.scalar import seconds_between
from caseflow.operators.filters import case_variants
from caseflow.operators.schema import ACT, CASE, CORE, IDX, TS
from caseflow.functions.scalar import attach_scalars


def _pct(c, q, approx=False):
    return F.percentile_approx(c, F.lit(q), 10000) if approx else F.percentile(c, F.lit(q))


def case_stats(log: DataFrame) -> DataFrame:
    return log.groupBy(CASE).agg(F.count(F.lit(1)).alias("n_events"), F.min(TS).alias("t0"), F.max(TS).alias("t1"))


def trace_length_stats(log: DataFrame, approx: bool = False) -> DataFrame:
    """AGG-1: events, cases, min/max time, trace length min / median / mean / p95 / max."""
    cs = case_stats(log)
    n = F.col("n_events").cast("double")
    return cs.agg(F.sum("n_events").cast("bigint").alias("n_events"), F.count(F.lit(1)).alias("n_cases"),
                  F.min("t0").alias("min_time"), F.max("t1").alias("max_time"),
                  F.min("n_events").cast("bigint").alias("len_min"), _pct(n, 0.5, approx).alias("len_median"),
                  F.avg(n).alias("len_mean"), _pct(n, 0.95, approx).alias("len_p95"),
                  F.max("n_events").cast("bigint").alias("len_max"))


def case_duration_stats(log: DataFrame, approx: bool = False) -> DataFrame:
    """AGG-2: case duration in days: min / median / mean / p95 / max and #zero.

    Durations are continuous (one value per case), so the exact quantiles use the
    distributed path when there are many cases (``exact_quantiles``).
    """
    d = seconds_between("t0", "t1") / 86400.0
    cs = case_stats(log).select(d.alias("d"))
    base = cs.agg(F.min("d").alias("dur_min_days"), F.avg("d").alias("dur_mean_days"),
                  F.max("d").alias("dur_max_days"), F.count_if(F.col("d") == 0).alias("n_zero_duration"))
    q = (cs.agg(_pct(F.col("d"), 0.5, True).alias("q0"), _pct(F.col("d"), 0.95, True).alias("q1")) if approx
         else exact_quantiles(cs, "d", [0.5, 0.95]))
    return attach_scalars(base, q).select("dur_min_days", F.col("q0").alias("dur_median_days"), "dur_mean_days",
                                          F.col("q1").alias("dur_p95_days"), "dur_max_days", "n_zero_duration")


def activity_frequency(log: DataFrame) -> DataFrame:
    """AGG-3: count per activity with its rank from the top and from the bottom (ties by name).

    The table is activity-vocabulary sized; top-10 = ``rank_desc <= 10``, bottom-5 = ``rank_asc <= 5``.
    """
    c = log.groupBy(ACT).agg(F.count(F.lit(1)).alias("n"))
    return (c.withColumn("rank_desc", F.row_number().over(Window.orderBy(F.desc("n"), F.asc(ACT))))
            .withColumn("rank_asc", F.row_number().over(Window.orderBy(F.asc("n"), F.asc(ACT))))
            .withColumn("n_distinct", F.count(F.lit(1)).over(Window.partitionBy())))


def consecutive_duplicate_count(log: DataFrame) -> DataFrame:
    """AGG-4: events whose activity equals the previous event's in the same case (skew-aware lag)."""
    from caseflow.operators.sequence import ordered_scan
    s = ordered_scan(log, [TS, IDX], lags={"_prev": ACT})
    return s.agg(F.count_if(F.col("_prev") == F.col(ACT)).alias("n_consecutive_duplicates"))


def _attr_cols(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in CORE and not c.startswith("_")]


def missing_values(log: DataFrame) -> DataFrame:
    """AGG-5: null count and percent per attribute (only attributes with nulls)."""
    cols = _attr_cols(log)
    if not cols:
        return log.sparkSession.createDataFrame([], "column string, n_missing bigint, pct_missing double")
    row = log.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}")
                                                 for i, c in enumerate(cols)])
    long = row.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing"))
                                                for i, c in enumerate(cols)])).alias("r"))
    return long.select("r.column", F.col("r.n_missing").cast("bigint").alias("n_missing"),
                       (F.col("r.n_missing") * 100.0 / F.col("_n")).alias("pct_missing")).where("n_missing > 0")


def missing_cell_rate(log: DataFrame) -> DataFrame:
    """AGG-15: share of null cells over all columns."""
    cols = log.columns
    nulls = sum((F.col(f"`{c}`").isNull().cast("bigint") for c in cols), F.lit(0).cast("bigint"))
    return log.agg(F.sum(nulls).cast("bigint").alias("n_missing_cells"),
                   (F.count(F.lit(1)) * F.lit(len(cols))).cast("bigint").alias("n_cells")) \
        .withColumn("missing_rate", F.col("n_missing_cells") / F.col("n_cells"))


def variant_counts(log: DataFrame) -> DataFrame:
    """Variants with their case counts and length (variant text built per case: report use)."""
    return case_variants(log).groupBy("variant").agg(F.count(F.lit(1)).alias("n_cases"),
                                                     F.first("n_events").alias("n_steps"))


def variant_stats(log: DataFrame) -> DataFrame:
    """AGG-6: #variants, #singleton variants, cases (hash identities: no per-case lists)."""
    from caseflow.operators.filters import case_variant_ids
    v = case_variant_ids(log).groupBy("n_events", "_vh1", "_vh2").agg(F.count(F.lit(1)).alias("n_cases"))
    return v.agg(F.count(F.lit(1)).alias("n_variants"), F.count_if(F.col("n_cases") == 1).alias("n_singletons"),
                 F.sum("n_cases").cast("bigint").alias("n_cases"))


def top_variants(log: DataFrame, k: int = 10) -> DataFrame:
    """AGG-14: top-k variants with percent of cases and a short label (first 2 … last for > 4 steps).

    Variants are counted by hash identity; text is built only for one
    representative case of each candidate variant (those with at least the k-th
    largest count, so ties at the cut are ordered by text exactly).
    """
    from caseflow.operators.filters import case_variant_ids
    key = ["n_events", "_vh1", "_vh2"]
    vc = case_variant_ids(log).groupBy(*key).agg(F.count(F.lit(1)).alias("n_cases"), F.min(CASE).alias("_rep"))
    kth = vc.orderBy(F.desc("n_cases")).limit(k).agg(F.min("n_cases").alias("_kth"))
    tot = vc.agg(F.sum("n_cases").alias("_tot"))
    cand = attach_scalars(vc, kth).where(F.col("n_cases") >= F.col("_kth"))
    reps = log.join(cand.select(F.col("_rep").alias(CASE)), CASE, "left_semi")
    text = case_variants(reps).select(F.col(CASE).alias("_rep"), "variant")
    v = attach_scalars(cand.join(text, "_rep"), tot)
    steps = F.split("variant", ">")
    short = F.when(F.size(steps) > 4, F.concat_ws(" → ", F.get(steps, 0), F.get(steps, 1), F.lit("…"),
                                                    F.element_at(steps, -1))) \
        .otherwise(F.array_join(steps, " → "))
    return (v.select("variant", "n_cases", F.col("n_events").alias("n_steps"),
                     (F.col("n_cases") * 100.0 / F.col("_tot")).alias("pct"), short.alias("label"))
            .orderBy(F.desc("n_cases"), F.asc("variant")).limit(k))


def last_event_values(log: DataFrame, cols: list[str]) -> DataFrame:
    """Per case, the last non-null value of each column (time order)."""
    aggs = [F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.struct(TS, IDX))).alias(c) for c in cols]
    return log.groupBy(CASE).agg(*aggs)


def column_profile(log: DataFrame, max_values: int = 500, sample: int = 30) -> DataFrame:
    """AGG-7: per attribute: nulls, blanks (pct), distinct last-event values, and the first
    ``sample`` of them (sorted as text) when the cardinality is 1..``max_values``.

    The sample is a per-column top-``sample`` over distinct values (row_number
    limit), so a high-cardinality column never gathers its whole set in one task.
    """
    cols = [c for c in log.columns if c not in (CASE, TS) and not c.startswith("_")]
    base = log.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"nu{i}") for i, c in enumerate(cols)],
                   *[F.count_if(F.trim(F.col(f"`{c}`").cast("string")) == "").alias(f"bl{i}") for i, c in enumerate(cols)])
    last = last_event_values(log, cols)
    long = last.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
                                           for c in cols])).alias("r")).select("r.*").where("value IS NOT NULL").distinct()
    card = long.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct_last"))
    w = Window.partitionBy("column").orderBy("value")
    samp = (long.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample)
            .groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("sample_values")))
    rows = base.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"nu{i}").alias("n_null"),
                                                          F.col(f"bl{i}").alias("n_blank")) for i, c in enumerate(cols)]))
                       .alias("r")).select("_n", "r.*")
    j = rows.join(card, "column", "left").join(samp, "column", "left")
    nd = F.coalesce(F.col("n_distinct_last"), F.lit(0)).cast("bigint")
    return j.select("column", "n_null", (F.col("n_null") * 100.0 / F.col("_n")).alias("pct_null"),
                    "n_blank", (F.col("n_blank") * 100.0 / F.col("_n")).alias("pct_blank"),
                    nd.alias("n_distinct_last"),
                    F.when((nd >= 1) & (nd <= max_values), F.col("sample_values")).alias("sample_values"))


def outcome_candidates(log: DataFrame, lo: int = 2, hi: int = 100) -> DataFrame:
    """AGG-8: columns whose last-event cardinality is in [lo, hi]; activity always listed."""
    p = column_profile(log)
    return p.where((F.col("column") == ACT) | F.col("n_distinct_last").between(lo, hi)).select("column", "n_distinct_last")


def event_attribute_candidates(log: DataFrame, lo: int = 1, hi: int = 50) -> DataFrame:
    """AGG-9: non-``case:`` attributes with 1..50 distinct values over all events."""
    cols = [c for c in _attr_cols(log) if not c.startswith("case:")]
    if not cols:
        return log.sparkSession.createDataFrame([], "column string, n_distinct bigint")
    # distinct (column, value) pairs, combined before the shuffle
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])
    seen = log.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").distinct()
    return seen.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct")).where(F.col("n_distinct").between(lo, hi))


def activity_counts_pct(log: DataFrame, k: int = 30) -> DataFrame:
    """AGG-10: top-k activities with percent of events."""
    c = log.groupBy(ACT).agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum("n").alias("_tot"))
    return (attach_scalars(c, tot).select(ACT, "n", (F.col("n") * 100.0 / F.col("_tot")).alias("pct"))
            .orderBy(F.desc("n"), F.asc(ACT)).limit(k))


def histogram(values: DataFrame, col: str, bins: int, upper_q: float | None = None) -> DataFrame:
    """Equal-width histogram between min and max (or the ``upper_q`` percentile); top edge in the last bin."""
    v = F.col(col).cast("double")
    if upper_q is not None:
        cap = exact_quantiles(values, col, [upper_q]).select(F.col("q0").alias("_cap"))
        values = attach_scalars(values, cap).where(v <= F.col("_cap")).drop("_cap")
    rng = values.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    j = attach_scalars(values, rng)
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(
        F.least(F.lit(bins), F.width_bucket(v, F.col("_lo"), F.col("_hi"), F.lit(bins))))
    return j.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def duration_stats(log: DataFrame) -> DataFrame:
    """AGG-11 (stats): case duration days p25 / p75 / p90 (exact, distributed when large)."""
    d = (seconds_between("t0", "t1") / 86400.0)
    cs = case_stats(log).select(d.alias("d"))
    q = exact_quantiles(cs, "d", [0.25, 0.75, 0.9])
    return q.select(F.col("q0").alias("p25_days"), F.col("q1").alias("p75_days"), F.col("q2").alias("p90_days"))


def duration_histogram(log: DataFrame, bins: int = 8) -> DataFrame:
    """AGG-11 (histogram): 8 equal-width bins of durations ≤ p95."""
    d = (seconds_between("t0", "t1") / 86400.0)
    return histogram(case_stats(log).select(d.alias("d")), "d", bins, upper_q=0.95)


def case_length_histogram(log: DataFrame) -> DataFrame:
    """AGG-12: case lengths in min(8, int(p95)) equal-width bins."""
    cs = case_stats(log)
    p95 = cs.agg(F.percentile(F.col("n_events").cast("double"), F.lit(0.95)).alias("_p95"))
    nb = p95.select(F.greatest(F.lit(1), F.least(F.lit(8), F.floor("_p95").cast("int"))).alias("_bins"))
    rng = cs.agg(F.min("n_events").alias("_lo"), F.max("n_events").alias("_hi"))
    j = attach_scalars(attach_scalars(cs, nb), rng)
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(
        F.least(F.col("_bins"), F.width_bucket(F.col("n_events").cast("double"), F.col("_lo").cast("double"),
                                               F.col("_hi").cast("double"), F.col("_bins").cast("bigint"))))
    return j.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def auto_max_prefix_len(log: DataFrame) -> DataFrame:
    """AGG-13: max(2, min(30, int(p95 case length)))."""
    cs = case_stats(log)
    return cs.agg(F.greatest(F.lit(2), F.least(F.lit(30), F.floor(F.percentile(F.col("n_events").cast("double"),
                                                                                F.lit(0.95))).cast("int")))
                  .alias("auto_max_prefix_len"))


def events_per_month(log: DataFrame) -> DataFrame:
    """AGG-16."""
    return log.groupBy(F.date_format(TS, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_events"))


def lifecycle_values(log: DataFrame, col: str = "lifecycle:transition") -> DataFrame:
    """AGG-17 / AGG-22: lifecycle values with counts."""
    if col not in log.columns:
        return log.sparkSession.createDataFrame([], "value string, n bigint")
    return log.groupBy(F.col(f"`{col}`").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def avg_case_duration_days(log: DataFrame) -> DataFrame:
    """AGG-18."""
    return case_stats(log).agg(F.avg(seconds_between("t0", "t1") / 86400.0).alias("avg_case_duration_days"))


def label_qc(prefixes: DataFrame, label_col: str, numeric: bool) -> DataFrame:
    """AGG-19: numeric -> NA count, min, max, quantiles, #negative; class -> per-class counts."""
    if numeric:
        y = F.col(label_col).try_cast("double")
        qs = [0.5, 0.9, 0.95, 0.99, 0.999]
        base = prefixes.agg(F.count_if(y.isNull()).alias("n_na"), F.min(y).alias("min"), F.max(y).alias("max"),
                            F.count_if(y < 0).alias("n_negative"))
        q = exact_quantiles(prefixes.select(y.alias("_y")), "_y", qs)
        return attach_scalars(base, q).select("n_na", "min", "max",
                                              *[F.col(f"q{i}").alias(f"q{str(x)[2:]}") for i, x in enumerate(qs)],
                                              "n_negative")
    c = prefixes.groupBy(F.col(label_col).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("label"))))


def step_counts(log: DataFrame) -> DataFrame:
    """AGG-23 / AGG-24 / SRC-6: rows, cases, average events per case."""
    return log.agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct(CASE).alias("n_cases")) \
        .withColumn("avg_events_per_case", F.col("n_events") / F.col("n_cases"))


def load_qc(raw: DataFrame, ts_col: str = TS) -> DataFrame:
    """SRC-6: rows, columns, cases, unparsable timestamps, min/max time in one pass."""
    ts = F.col(ts_col)
    parsed = ts if dict(raw.dtypes).get(ts_col, "").startswith("timestamp") else F.try_to_timestamp(ts.cast("string"))
    return raw.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(raw.columns)).alias("n_columns"),
                   F.count_distinct(CASE).alias("n_cases"),
                   F.count_if(ts.isNotNull() & parsed.isNull()).alias("n_ts_parse_failures"),
                   F.min(parsed).alias("min_time"), F.max(parsed).alias("max_time"))
