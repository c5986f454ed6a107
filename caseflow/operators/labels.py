"""Case table and case labels (LBL-1..3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.operators.schema import ACT, CASE, IDX, TS

# Case-attribute columns that may carry the true completion time, in order.
END_TIME_CANDIDATES = ["case:endDate", "endDate", "case:end_time", "end_time"]
# Raw XES names that are renamed by schema normalisation.
XES_ALIASES = {"concept:name": "activity", "case:concept:name": "case_id", "time:timestamp": "timestamp"}


def _first_non_null(c: str):
    """First non-null value of ``c`` in (timestamp, index) order: min_by skips null orderings."""
    col = F.col(f"`{c}`")
    return F.min_by(col, F.when(col.isNotNull(), F.struct(F.col(TS), F.col(IDX))))


def _last_non_null(c: str):
    col = F.col(f"`{c}`")
    return F.max_by(col, F.when(col.isNotNull(), F.struct(F.col(TS), F.col(IDX))))


def case_table(df: DataFrame, outcome_col: str = "", outcome_values: str | list[str] = "",
               label_col: str = "label_outcome", end_col: str | None = "auto", extra_aggs: list | None = None) -> DataFrame:
    """One row per case: start, end, outcome label (LBL-1..3).

    * start / end = min / max timestamp.
    * end override (LBL-2): first non-null value of the first end column present,
      used only when it is not before the observed end.
    * outcome (LBL-3): last non-null value of ``outcome_col`` in time order, as text;
      values outside the whitelist become ``Other``; no column -> ``unknown``.

    A single ``groupBy(case_id)``: partial aggregation keeps a hot case cheap.
    ``extra_aggs`` ride along in the same aggregate (e.g. case size, case attributes).
    """
    aggs = [F.min(TS).alias("case_start_time"), F.max(TS).alias("case_end_time")] + list(extra_aggs or [])
    if end_col == "auto":
        end_col = next((c for c in END_TIME_CANDIDATES if c in df.columns), None)
    if end_col and end_col in df.columns:
        aggs.append(_first_non_null(end_col).alias("_end_attr"))
    oc = (outcome_col or "").strip()
    if oc and oc not in df.columns and oc in XES_ALIASES and XES_ALIASES[oc] in df.columns:
        oc = XES_ALIASES[oc]
    has_outcome = bool(oc) and oc in df.columns
    if has_outcome:
        aggs.append(_last_non_null(oc).cast("string").alias("_outcome"))
    t = df.groupBy(CASE).agg(*aggs)
    if "_end_attr" in t.columns:
        e = F.try_to_timestamp(F.col("_end_attr").cast("string"))
        t = t.withColumn("case_end_time", F.when(e.isNotNull() & (e >= F.col("case_end_time")), e)
                         .otherwise(F.col("case_end_time"))).drop("_end_attr")
    if has_outcome:
        vals = outcome_values if isinstance(outcome_values, list) else \
            [v.strip() for v in (outcome_values or "").split(",") if v.strip()]
        lab = F.coalesce(F.col("_outcome"), F.lit("unknown"))
        if vals:
            lab = F.when(F.col("_outcome").isin(*vals), F.col("_outcome")).otherwise(F.lit("Other"))
        t = t.withColumn(label_col, lab).drop("_outcome")
    else:
        t = t.withColumn(label_col, F.lit("unknown"))
    return t


def outcome_distribution(cases: DataFrame, label_col: str = "label_outcome", top: int = 20) -> DataFrame:
    """AGG-20: class counts, top ``top`` by count (ties by value)."""
    return (cases.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_cases"))
            .orderBy(F.desc("n_cases"), F.asc(label_col)).limit(top))


__all__ = ["case_table", "outcome_distribution", "END_TIME_CANDIDATES", "ACT"]
