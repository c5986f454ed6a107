"""Lifecycle handling: occurrence ids and start/complete collapse (WIN-9, WIN-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.operators.schema import ACT, CASE, IDX, TS
from caseflow.operators.sequence import DEFAULT_CHUNK_ROWS, ordered_scan


def with_occurrence(df: DataFrame, lifecycle_col: str = "lifecycle:transition", name: str = "_occurrence",
                    chunk_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """WIN-9: running count of 'new logical event' flags within a case.

    A flag is raised when the activity differs from the previous event's or the
    lifecycle value is ``start`` (trimmed, case-insensitive).  Two skew-aware
    scans: a lag, then a running sum.
    """
    s = ordered_scan(df, [TS, IDX], lags={"_prev_act": ACT}, chunk_rows=chunk_rows)
    changed = F.col("_prev_act").isNull() | (F.col(ACT) != F.col("_prev_act"))
    if lifecycle_col in df.columns:
        changed = changed | F.coalesce(F.lower(F.trim(F.col(f"`{lifecycle_col}`").cast("string"))) == F.lit("start"),
                                       F.lit(False))
    flagged = s.withColumn("_new_evt", changed.cast("int")).drop("_prev_act")
    out = ordered_scan(flagged, [TS, IDX], running_sum={name: "_new_evt"}, chunk_rows=chunk_rows)
    return out.withColumn(name, F.col(name).cast("int")).drop("_new_evt")


def lifecycle_collapse(df: DataFrame, lifecycle_col: str = "lifecycle:transition", event_id_col: str = "EventID",
                       prefer_lifecycle: str = "complete", normalize_lifecycle_to_prefer: bool = False,
                       use_event_id: bool | None = None) -> DataFrame:
    """WIN-10: keep one row per logical event.

    Group by (case, EventID) when any EventID is present (rows with a null
    EventID drop out), else by (case, activity, occurrence).  The kept row is the
    one with the preferred lifecycle, then the latest time, then the latest index.
    ``_occurrence`` stays in the output in the second mode.
    """
    if use_event_id is None:
        use_event_id = event_id_col in df.columns and \
            df.where(F.col(f"`{event_id_col}`").isNotNull()).limit(1).count() > 0
    if use_event_id:
        work, keys = df.where(F.col(f"`{event_id_col}`").isNotNull()), [CASE, event_id_col]
    else:
        work, keys = with_occurrence(df, lifecycle_col), [CASE, ACT, "_occurrence"]
    if lifecycle_col in df.columns:
        prefer = (F.lower(F.trim(F.col(f"`{lifecycle_col}`").cast("string")))
                  == F.lit(prefer_lifecycle.strip().lower()))
        prefer = F.coalesce(prefer, F.lit(False))
    else:
        prefer = F.lit(False)
    cols = work.columns
    payload = F.struct(*[F.col(f"`{c}`") for c in cols if c not in keys])
    # latest-by-(prefer, ts, idx) per group as an aggregate: duplicates collapse map-side
    g = work.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.max_by(payload, F.struct(prefer.cast("int"), F.col(TS), F.col(IDX))).alias("_p"))
    sel = {k: F.col(f"`{k}`") for k in keys}
    sel.update({c: F.col("_p")[c] for c in cols if c not in keys})
    out = g.select(*[sel[c].alias(c) for c in cols])
    if normalize_lifecycle_to_prefer and lifecycle_col in cols:
        out = out.withColumn(lifecycle_col, F.lit(prefer_lifecycle))
    return out
