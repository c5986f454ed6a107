"""Skew-aware ordered scans within a case: lag and running max / sum.

A plain ``Window.partitionBy(case_id)`` sends every event of a case to one task;
a case holding a third of the log would then run in a single task.  Here:

1. one aggregate (case sizes and the range of the leading order key) finds hot
   cases: more than ``chunk_rows`` events.  Their number is bounded by
   ``total_rows / chunk_rows``, so that small table is collected and broadcast.
2. without hot cases the plain per-case window is used (no extra cost beyond
   the size aggregate, and the ``case_id`` partitioning stays reusable);
3. with hot cases, each hot case is cut into contiguous chunks of about
   ``chunk_rows`` rows on the leading order key (``timestamp`` or
   ``_event_index``): fine equal-width buckets are counted and merged by a
   running count.  The window runs per (case, chunk), and each chunk's first row
   gets the carry from earlier chunks (last value / running max / running sum)
   from a per-(case, chunk) aggregate.  Rows with equal leading key always
   share a chunk, so order ties are broken inside one partition.  Results equal
   the plain window exactly.

A single fine bucket is never split, so rows sharing one key value stay
together (a case whose events all carry the same timestamp is one chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.operators.schema import CASE, IDX, TS

DEFAULT_CHUNK_ROWS = 2_000_000
# session setting that overrides the default threshold (rows per case before it is split)
HOT_CASE_CONF = "caseflow.hotCaseRows"


def _key_num(c: str, df: DataFrame) -> Column:
    """A number that never falls while the key rises in sort order; 0 for keys that are not numbers or times."""
    t = df.schema[c].dataType
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(c).cast("timestamp"))
    if isinstance(t, T.NumericType):  # differences must fit in a long, too; NaN sorts above all numbers
        exact = isinstance(t, T.IntegralType)
        most = 4 * 10 ** 18 if exact else 4e18
        bounded = F.greatest(F.least(F.col(c).cast("bigint" if exact else "double"), F.lit(most)), F.lit(-most))
        return F.when(F.col(c).isNotNull(), bounded.cast("bigint"))
    return F.when(F.col(c).isNotNull(), F.lit(0)).cast("bigint")


def hot_case_chunks(df: DataFrame, order: list[str], chunk_rows: int, oversample: int = 8):
    """Hot cases and their chunk map, or None when there are none.

    Each hot case's key range is cut into ``oversample`` x (needed chunks) fine
    equal-width buckets; rows per fine bucket are counted (a small aggregate)
    and consecutive buckets are merged into chunks of about ``chunk_rows`` rows
    by a running count.  Chunks stay contiguous in key order and are balanced
    even when the case's events are bursty in time.
    Returns (geometry, chunk_map): geometry has one row per hot case (bounded
    by total_rows / chunk_rows); chunk_map has one row per non-empty fine bucket.
    """
    k = _key_num(order[0], df)
    st = (df.groupBy(CASE).agg(F.count(F.lit(1)).alias("_hn"), F.min(k).alias("_hlo"), F.max(k).alias("_hhi"))
          .where(F.col("_hn") > chunk_rows))
    rows = st.collect()  # bounded by total_rows / chunk_rows
    if not rows:
        return None
    spark = df.sparkSession
    data = []
    for r in rows:
        n_fine = oversample * -(-int(r["_hn"]) // chunk_rows)
        lo, hi = int(r["_hlo"] or 0), int(r["_hhi"] or 0)
        width = max(1, -(-(hi - lo + 1) // n_fine))
        data.append((r[CASE], lo, width, n_fine))
    geometry = spark.createDataFrame(data, f"{CASE} string, _hlo long, _hwidth long, _hfine long")
    fine = _fine_bucket(df.join(F.broadcast(geometry), CASE), k)
    counts = fine.groupBy(CASE, "_fine").agg(F.count(F.lit(1)).alias("_fc"))
    before = F.coalesce(F.sum("_fc").over(Window.partitionBy(CASE).orderBy("_fine")
                                          .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunk_map = counts.select(CASE, "_fine", F.floor(before / F.lit(chunk_rows)).cast("long").alias("_chunk"))
    return geometry, chunk_map


def _fine_bucket(joined: DataFrame, k: Column) -> DataFrame:
    """Bucket of the key; null keys sort first and have bucket -1."""
    place = F.least(F.col("_hfine") - 1, F.floor((k - F.col("_hlo")) / F.col("_hwidth")))
    return joined.withColumn("_fine", F.when(k.isNull(), F.lit(-1)).otherwise(place).cast("long"))


def _with_chunk(df: DataFrame, order: list[str], hot) -> DataFrame:
    geometry, chunk_map = hot
    k = _key_num(order[0], df)
    j = _fine_bucket(df.join(F.broadcast(geometry), CASE, "left"), k)
    # chunk map: one row per fine bucket of the hot cases; joined normally (AQE broadcasts it when small)
    j = j.join(chunk_map, [CASE, "_fine"], "left")
    return j.withColumn("_chunk", F.coalesce(F.col("_chunk"), F.lit(0)).cast("long")) \
        .drop("_hlo", "_hwidth", "_hfine", "_fine")


def ordered_scan(df: DataFrame, order: list[str] | None = None, lags: dict[str, str] | None = None,
                 running_max: dict[str, str] | None = None, running_sum: dict[str, str] | None = None,
                 chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Add ``lags`` {out: col} (previous row's value), ``running_max`` / ``running_sum``
    {out: col} (inclusive, over rows so far) per case in ``order``.

    ``chunk_rows=None`` forces the plain per-case window.
    """
    order = order or [TS, IDX]
    lags, running_max, running_sum = lags or {}, running_max or {}, running_sum or {}
    if chunk_rows == DEFAULT_CHUNK_ROWS:
        chunk_rows = int(df.sparkSession.conf.get(HOT_CASE_CONF, str(DEFAULT_CHUNK_ROWS)))
    hot = hot_case_chunks(df, order, chunk_rows) if chunk_rows else None
    if hot is None:
        w = Window.partitionBy(CASE).orderBy(*order)
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        cols = {o: F.lag(F.col(f"`{c}`")).over(w) for o, c in lags.items()}
        cols.update({o: F.max(F.col(f"`{c}`")).over(run) for o, c in running_max.items()})
        cols.update({o: F.sum(F.col(f"`{c}`")).over(run) for o, c in running_sum.items()})
        return df.withColumns(cols)

    base = _with_chunk(df, order, hot)
    w = Window.partitionBy(CASE, "_chunk").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    local = {"_first": F.row_number().over(w) == 1}
    local.update({f"_l_{o}": F.lag(F.col(f"`{c}`")).over(w) for o, c in lags.items()})
    local.update({f"_m_{o}": F.max(F.col(f"`{c}`")).over(run) for o, c in running_max.items()})
    local.update({f"_s_{o}": F.sum(F.col(f"`{c}`")).over(run) for o, c in running_sum.items()})
    scanned = base.withColumns(local)

    # carry table: one row per (hot case, chunk); hot cases only, so it is small
    okey = F.struct(*[F.col(c) for c in order])
    per_chunk = base.join(F.broadcast(hot[0].select(CASE)), CASE, "left_semi") \
        .groupBy(CASE, "_chunk").agg(
            *[F.max_by(F.col(f"`{c}`"), okey).alias(f"_cl_{o}") for o, c in lags.items()],
            *[F.max(F.col(f"`{c}`")).alias(f"_cm_{o}") for o, c in running_max.items()],
            *[F.sum(F.col(f"`{c}`")).alias(f"_cs_{o}") for o, c in running_sum.items()])
    cw = Window.partitionBy(CASE).orderBy("_chunk")
    before = cw.rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(
        CASE, "_chunk",
        *[F.lag(f"_cl_{o}").over(cw).alias(f"_pl_{o}") for o in lags],
        *[F.max(f"_cm_{o}").over(before).alias(f"_pm_{o}") for o in running_max],
        *[F.sum(f"_cs_{o}").over(before).alias(f"_ps_{o}") for o in running_sum])
    j = scanned.join(carry, [CASE, "_chunk"], "left")
    out = {}
    for o in lags:
        out[o] = F.when(F.col("_first"), F.col(f"_pl_{o}")).otherwise(F.col(f"_l_{o}"))
    for o in running_max:
        out[o] = F.greatest(F.col(f"_m_{o}"), F.col(f"_pm_{o}"))
    for o in running_sum:
        # null as long as every value so far is null, as in a plain window
        out[o] = F.coalesce(F.col(f"_s_{o}") + F.col(f"_ps_{o}"), F.col(f"_s_{o}"), F.col(f"_ps_{o}"))
    res = j.withColumns(out)
    return res.select(*df.columns, *out.keys())
