"""Exact linear-interpolation quantiles that scale past one task's memory.

Spark's ``percentile`` is exact but keeps every distinct value of the group in
one aggregation buffer.  Up to ``small_rows`` values it is used directly;
beyond, the values are range-sorted across the cluster (``global_rank``) and
only the ≤ 2 ranks around each quantile position are read back.  Both paths
give ``v[lo] + (p - lo) * (v[hi] - v[lo])`` with ``p = q * (n - 1)``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 5_000_000


def exact_quantiles(df: DataFrame, col: str, qs: list[float], small_rows: int = SMALL_ROWS) -> DataFrame:
    """One-row DataFrame with columns ``q0, q1, ...`` (null when there are no values)."""
    spark = df.sparkSession
    vals = df.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    n = vals.count()
    if n <= small_rows:
        return vals.agg(*[F.percentile("_v", F.lit(float(q))).alias(f"q{i}") for i, q in enumerate(qs)])
    from caseflow.operators.ranking import global_rank
    ranked = global_rank(vals, [F.col("_v")], "_r")
    need = set()
    for q in qs:
        p = q * (n - 1)
        need |= {math.floor(p) + 1, math.ceil(p) + 1}
    at = {r["_r"]: r["_v"] for r in ranked.where(F.col("_r").isin(*sorted(need))).collect()}  # ≤ 2 per quantile
    out = []
    for q in qs:
        p = q * (n - 1)
        lo, hi = at[math.floor(p) + 1], at[math.ceil(p) + 1]
        out.append(lo + (p - math.floor(p)) * (hi - lo))
    return spark.createDataFrame([tuple(out)], ", ".join(f"q{i} double" for i in range(len(qs))))


def exact_quantiles_by(df: DataFrame, group: list[str], col: str, qs: list[float],
                       small_rows: int = SMALL_ROWS) -> DataFrame:
    """Per-group exact quantiles: one row per group with columns ``q0, q1, ...``.

    Groups whose size stays below ``small_rows`` use Spark's ``percentile``.
    Otherwise all values are range-sorted by (group, value) across the cluster;
    a group's start offset comes from the (small) per-group count table, and
    only the ≤ 2 ranks per group and quantile are joined back and interpolated.
    """
    from pyspark.sql import Window

    vals = df.select(*group, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    sizes = vals.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    max_n = sizes.agg(F.max("_n")).first()[0]
    if max_n is None or max_n <= small_rows:
        return vals.groupBy(*group).agg(*[F.percentile("_v", F.lit(float(q))).alias(f"q{i}") for i, q in enumerate(qs)])
    from caseflow.operators.ranking import global_rank
    ranked = global_rank(vals, [*[F.col(g) for g in group], F.col("_v")], "_r")
    # group table: one row per group, so the unpartitioned running sum is small
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(
        Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    need = starts.select(*group, "_start", "_n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("qi"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("p")) for i, q in enumerate(qs)]))
        .alias("_q")).select(*group, "_start", "_q.qi", "_q.p")
    need = need.select(*group, "qi", "p", F.explode(F.array(
        F.struct(F.lit("lo").alias("w"), (F.floor("p") + 1 + F.col("_start")).cast("long").alias("_r")),
        F.struct(F.lit("hi").alias("w"), (F.ceil("p") + 1 + F.col("_start")).cast("long").alias("_r")))).alias("_k")) \
        .select(*group, "qi", "p", "_k.w", "_k._r")
    # a rank lies in one group only, so it alone is the key: a null group joins as any other
    got = ranked.drop(*group).join(need, "_r")
    per_q = got.groupBy(*group, "qi").agg(F.first("p").alias("p"),
                                           F.max(F.when(F.col("w") == "lo", F.col("_v"))).alias("lo"),
                                           F.max(F.when(F.col("w") == "hi", F.col("_v"))).alias("hi"))
    val = F.col("lo") + (F.col("p") - F.floor("p")) * (F.col("hi") - F.col("lo"))
    return per_q.groupBy(*group).agg(*[F.max(F.when(F.col("qi") == i, val)).alias(f"q{i}") for i in range(len(qs))])
