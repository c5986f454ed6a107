"""Aggregated case table -> event log (SRC-5).

Input: one row per case with a start time, ``wf_<state>`` seconds spent in a
state and optional ``wfe_<state>`` event counts.  Output: one event per counted
visit, spread evenly over the state's duration, states laid end to end in
column order.  Everything is row-local array work (no shuffle): offsets are
running sums computed with higher-order functions over a per-row array of states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aggregated_to_events(df: DataFrame, case_id_col: str = "id", start_time_col: str = "started",
                         end_time_col: str = "ended", duration_prefix: str = "wf_",
                         count_prefix: str = "wfe_") -> DataFrame:
    dur_cols = [c for c in df.columns if c.startswith(duration_prefix)]
    if not dur_cols:
        raise ValueError(f"no duration columns with prefix {duration_prefix!r}")
    cnt_cols = {c for c in df.columns if c.startswith(count_prefix)}
    states = [c[len(duration_prefix):] for c in dur_cols]
    meta_cols = [c for c in df.columns
                 if c not in {case_id_col, start_time_col, end_time_col} and c not in dur_cols and c not in cnt_cols]

    def _count(state: str):
        c = f"{count_prefix}{state}"
        if c not in cnt_cols:
            return F.lit(1)
        x = F.col(c).cast("double")
        # null or 0 -> one event; a fraction in (0, 1) -> one event; negative -> none
        return (F.when(x.isNull() | F.isnan(x) | (x == 0), F.lit(1))
                 .when(x < 0, F.lit(0))
                 .otherwise(F.greatest(F.lit(1), F.floor(x).cast("int"))))

    def _dur(state: str):
        x = F.col(f"{duration_prefix}{state}").cast("double")
        return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)

    arr = F.array(*[
        F.struct(F.lit(s).alias("state"), _dur(s).alias("dur"), _count(s).cast("int").alias("n"))
        for s in states
    ])
    start = F.try_to_timestamp(F.col(start_time_col).cast("string"))
    base = df.select(
        F.col(case_id_col).cast("string").alias("case_id"),
        start.alias("_start"),
        arr.alias("_states"),
        *[F.col(c).alias(f"case:{c}") for c in meta_cols],
    ).where(F.col("_start").isNotNull())

    # running offset (seconds) and running event number before each state
    with_offsets = base.withColumn("_states", F.transform(
        "_states",
        lambda s, i: F.struct(
            s["state"].alias("state"), s["dur"].alias("dur"), s["n"].alias("n"),
            F.aggregate(F.slice("_states", 1, i), F.lit(0.0).cast("double"),
                        lambda acc, y: acc + F.coalesce(y["dur"], F.lit(0.0))).alias("off"),
            F.aggregate(F.slice("_states", 1, i), F.lit(0).cast("bigint"),
                        lambda acc, y: acc + F.when(y["dur"].isNotNull() & (y["dur"] != 0), y["n"])
                        .otherwise(0).cast("bigint")).alias("seq0"),
        )))
    visited = with_offsets.select("*", F.explode(F.filter(
        "_states", lambda s: s["dur"].isNotNull() & (s["dur"] != 0) & (s["n"] > 0))).alias("_s"))
    events = visited.select("*", F.explode(F.sequence(F.lit(0), F.col("_s.n") - 1)).alias("_i"))
    offset_sec = F.col("_s.off") + F.col("_i") * F.col("_s.dur") / F.col("_s.n")
    ts = F.timestamp_micros(F.unix_micros("_start") + F.round(offset_sec * 1e6).cast("bigint"))
    return events.select(
        "case_id",
        F.col("_s.state").alias("activity"),
        ts.alias("timestamp"),
        (F.col("_s.seq0") + F.col("_i")).cast("bigint").alias("_event_index"),
        *[f"`case:{c}`" for c in meta_cols],
    )
