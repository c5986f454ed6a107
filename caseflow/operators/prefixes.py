"""Prefix extraction: one row per (case, k) for the first k events (PFX-*, LBL-4..6, INF-1).

Plan shape (all per-case work shares one hash partitioning on ``case_id``):

1. ``case_table`` (groupBy case_id, partial aggregation) gives start, end, size, outcome.
2. ``row_number() over (case order by ts, idx) <= max_len + 1`` keeps only the
   head of each case.  Catalyst turns this filter into a WindowGroupLimit that
   runs *before* the shuffle, so a case with a billion events ships at most
   ``max_len + 1`` rows per map task.
3. A second window over the capped head computes lead / lag / running lists /
   last non-null attributes: at most ``max_len + 1`` rows per case, so the
   running ``collect_list`` is O(max_len^2) per case, never O(n^2).
4. Join with the case table on ``case_id`` (same partitioning, no extra shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.scalar import calendar_features, log1p_nonneg, safe_attr_name, seconds_between
from caseflow.operators.labels import case_table as build_case_table
from caseflow.operators.schema import ACT, CASE, IDX, TS

# Columns never treated as event attributes.
PREFIX_RESERVED = {
    "case_id", "activity", "timestamp", "prefix_row_id", "prefix_len", "prefix_activities", "prefix_end_time",
    "label_next_activity", "label_outcome", "label_remaining_time_sec", "label_remaining_time_log1p", "bucket_id",
}


def case_attribute_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    if cols:
        return [c for c in cols if c in df.columns]
    return [c for c in df.columns if c.startswith("case:")]


def event_attribute_columns(df: DataFrame, case_cols: list[str], cols: list[str] | None = None,
                            exclude: list[str] | None = None) -> list[str]:
    if cols:
        return [c for c in cols if c in df.columns]
    skip = PREFIX_RESERVED | set(case_cols) | set(exclude or [])
    # helper columns (leading underscore) and label columns never become features
    return [c for c in df.columns if c not in skip and not c.startswith("_") and not c.startswith("label_")]


def extract_prefixes(log: DataFrame, cases: DataFrame | None = None, max_prefix_len: int = 30,
                     min_prefix_len: int = 1, add_time_features: bool = True, add_calendar_features: bool = True,
                     add_log_features: bool = True, add_log_target: bool = True, feat_prefix: str = "feat_",
                     include_case_attributes: bool = True, case_attribute_cols: list[str] | None = None,
                     include_event_attributes: bool = True, event_attribute_cols: list[str] | None = None,
                     event_agg_policy: str = "last_non_null", next_event_attr_cols: list[str] | None = None,
                     case_out_prefix: str = "case__", event_out_prefix: str = "event_last__",
                     include_complete: bool = False, only_longest: bool = False,
                     sample_frac: float | None = None, seed: int = 42) -> DataFrame:
    """Prefix samples (PFX-1..5).

    For a case of n > 1 events, k runs over min..min(max, n-1); the full case is
    never a prefix.  ``include_complete=True`` (scoring of running cases, INF-1)
    also emits k = n and allows single-event cases; ``only_longest`` keeps the
    largest k per case.  Key is (case_id, prefix_len).
    """
    if min_prefix_len < 1 or max_prefix_len < min_prefix_len:
        raise ValueError("invalid prefix length bounds")
    if event_agg_policy not in ("last_non_null", "last"):
        raise ValueError("event_agg_policy must be last_non_null or last")
    case_cols = case_attribute_columns(log, case_attribute_cols) if include_case_attributes else []
    end_cols = ["case:endDate", "endDate", "case:end_time", "end_time"]
    ev_cols = (event_attribute_columns(log, case_cols, event_attribute_cols, exclude=end_cols)
               if include_event_attributes else [])
    nxt_cols = [c for c in (next_event_attr_cols or []) if c != ACT]

    # case-level: size + first non-null case attributes (partial aggregation)
    case_aggs = [F.count(F.lit(1)).alias("_n")]
    for c in case_cols:
        col = F.col(f"`{c}`")
        case_aggs.append(F.min_by(col, F.when(col.isNotNull(), F.struct(TS, IDX))).alias(f"_ca{case_cols.index(c)}"))
    if cases is None:
        # one case-level aggregate: times, outcome, size and case attributes together
        info = build_case_table(log, extra_aggs=case_aggs)
    else:
        info = log.groupBy(CASE).agg(*case_aggs).join(cases, CASE, "left")

    keep = [CASE, ACT, TS, IDX] + list(dict.fromkeys(ev_cols + [c for c in nxt_cols if c in log.columns]))
    w = Window.partitionBy(CASE).orderBy(TS, IDX)
    head = (log.select(*[F.col(f"`{c}`") for c in keep])
            .withColumn("prefix_len", F.row_number().over(w))
            .where(F.col("prefix_len") <= max_prefix_len + 1))

    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = [
        F.col(CASE), F.col("prefix_len"),
        F.collect_list(F.coalesce(F.col(ACT), F.lit("UNKNOWN"))).over(run).alias("prefix_activities"),
        F.col(TS).alias("prefix_end_time"),
        F.lead(ACT).over(w).alias("label_next_activity"),
        F.lag(TS).over(w).alias("_prev_ts"),
    ]
    for c in nxt_cols:
        src = F.lead(F.col(f"`{c}`")).over(w).cast("string") if c in log.columns else F.lit(None).cast("string")
        cols.append(F.coalesce(src, F.lit("unknown")).alias(f"label_next_{safe_attr_name(c)}"))
    for c in ev_cols:
        v = F.last(F.col(f"`{c}`"), ignorenulls=True).over(run) if event_agg_policy == "last_non_null" else F.col(f"`{c}`")
        cols.append(v.alias(f"{event_out_prefix}{c}"))
    feats = head.select(*cols)

    p = feats.join(info, CASE)
    upper = F.least(F.lit(max_prefix_len), F.col("_n") if include_complete else F.col("_n") - 1)
    p = p.where((F.col("prefix_len") >= min_prefix_len) & (F.col("prefix_len") <= upper))
    if only_longest:
        p = p.where(F.col("prefix_len") == upper)

    remaining = seconds_between("prefix_end_time", "case_end_time")
    out = [F.col(CASE), F.col("prefix_len").cast("int").alias("prefix_len"), "prefix_activities",
           F.col("prefix_end_time"), "label_next_activity",
           F.coalesce(F.col("label_outcome"), F.lit("0")).alias("label_outcome"),
           remaining.alias("label_remaining_time_sec")]
    out += [f"`label_next_{safe_attr_name(c)}`" for c in nxt_cols]
    if add_time_features:
        elapsed = F.coalesce(seconds_between("case_start_time", "prefix_end_time"), F.lit(0.0))
        since = F.coalesce(seconds_between("_prev_ts", "prefix_end_time"), F.lit(0.0))
        # clamped at 0 for training and scoring alike (one shared builder, A-22)
        elapsed, since = F.greatest(elapsed, F.lit(0.0)), F.greatest(since, F.lit(0.0))
        out += [elapsed.alias(f"{feat_prefix}elapsed_time_sec"), since.alias(f"{feat_prefix}time_since_last_event_sec")]
        if add_log_features:
            out += [log1p_nonneg(elapsed).alias(f"{feat_prefix}elapsed_time_log1p"),
                    log1p_nonneg(since).alias(f"{feat_prefix}time_since_last_log1p")]
        if add_calendar_features:
            out += calendar_features("prefix_end_time", prefix=f"{feat_prefix}prefix_end_")
    for i, c in enumerate(case_cols):
        out.append(F.col(f"_ca{i}").alias(f"{case_out_prefix}{c[5:] if c.startswith('case:') else c}"))
    out += [f"`{event_out_prefix}{c}`" for c in ev_cols]
    if add_log_target:
        out.append(log1p_nonneg(remaining, null_as_zero=False).alias("label_remaining_time_log1p"))
    res = p.select(*out)
    if sample_frac is not None:
        res = res.sample(fraction=float(sample_frac), seed=seed)
    return res


def running_case_prefixes(log: DataFrame, max_prefix_len: int | None = None, include_case_attributes: bool = True,
                          include_event_attributes: bool = True, feat_prefix: str = "feat_",
                          case_out_prefix: str = "case__", event_out_prefix: str = "event_last__",
                          case_starts: DataFrame | None = None) -> DataFrame:
    """INF-1: one scoring row per running case, describing its state at its latest event.

    ``prefix_activities`` holds all activities of the case in order, as training
    prefixes do, so counts and positions mean the same; a ``max_prefix_len`` that is
    asked for keeps only the latest ones.  One aggregate over the log gives
    everything; a case's row is as long as the case.  Elapsed / since-last are clamped at 0.
    ``case_starts`` (case_id, case_start_time) overrides the observed start.
    """
    case_cols = case_attribute_columns(log) if include_case_attributes else []
    ev_cols = event_attribute_columns(log, case_cols, exclude=["case:endDate", "endDate", "case:end_time", "end_time"]) \
        if include_event_attributes else []
    order = F.struct(TS, IDX)
    aggs = [F.count(F.lit(1)).alias("prefix_len"), F.min(TS).alias("_start")]
    for i, c in enumerate(case_cols):
        col = F.col(f"`{c}`")
        aggs.append(F.min_by(col, F.when(col.isNotNull(), order)).alias(f"_ca{i}"))
    for i, c in enumerate(ev_cols):
        col = F.col(f"`{c}`")
        aggs.append(F.max_by(col, F.when(col.isNotNull(), order)).alias(f"_ev{i}"))
    event = F.struct(TS, IDX, F.coalesce(F.col(ACT), F.lit("UNKNOWN")).alias("a"))
    state = log.groupBy(CASE).agg(F.sort_array(F.collect_list(event)).alias("_evs"), *aggs)
    j = (state.withColumn("prefix_end_time", F.element_at("_evs", -1)[TS])
         .withColumn("_prev_ts", F.try_element_at("_evs", F.lit(-2))[TS]))
    if case_starts is not None:
        # known start times (a case may begin before its first logged event) win over the observed minimum
        given = case_starts.select(CASE, F.col("case_start_time").cast("timestamp").alias("_given_start"))
        j = j.join(given, CASE, "left").withColumn("_start", F.coalesce("_given_start", "_start")).drop("_given_start")
    acts = F.transform("_evs", lambda e: e["a"])
    if max_prefix_len is not None:
        acts = F.slice(acts, F.greatest(F.size(acts) - (max_prefix_len - 1), F.lit(1)), F.lit(max_prefix_len))
    elapsed = F.greatest(F.coalesce(seconds_between("_start", "prefix_end_time"), F.lit(0.0)), F.lit(0.0))
    since = F.greatest(F.coalesce(seconds_between("_prev_ts", "prefix_end_time"), F.lit(0.0)), F.lit(0.0))
    out = [F.col(CASE), F.col("prefix_len").cast("int").alias("prefix_len"), acts.alias("prefix_activities"),
           "prefix_end_time", elapsed.alias(f"{feat_prefix}elapsed_time_sec"),
           since.alias(f"{feat_prefix}time_since_last_event_sec"),
           log1p_nonneg(elapsed).alias(f"{feat_prefix}elapsed_time_log1p"),
           log1p_nonneg(since).alias(f"{feat_prefix}time_since_last_log1p"),
           *calendar_features("prefix_end_time", prefix=f"{feat_prefix}prefix_end_")]
    for i, c in enumerate(case_cols):
        out.append(F.col(f"_ca{i}").alias(f"{case_out_prefix}{c[5:] if c.startswith('case:') else c}"))
    for i, c in enumerate(ev_cols):
        out.append(F.col(f"_ev{i}").alias(f"{event_out_prefix}{c}"))
    return j.select(*out)


def running_case_state(log: DataFrame, positions: int = 30, include_case_attributes: bool = True,
                       include_event_attributes: bool = True, feat_prefix: str = "feat_",
                       case_out_prefix: str = "case__", event_out_prefix: str = "event_last__") -> DataFrame:
    """INF-1 without a list as long as the case: one scoring row per running case, of bounded size.

    ``activity_counts`` (a map: how often each activity came), ``prefix_activities``
    (the first ``positions`` only, for positional features), ``last_activity``, and the same times and attributes as
    :func:`running_case_prefixes`.  A row is as long as the alphabet and ``positions``.

    Every part is added up in the tasks before its shuffle: counts by (case,
    activity) and then by case, attributes as ``min_by`` / ``max_by``, and the first
    and last events by ranks that Catalyst cuts off inside each task
    (WindowGroupLimit).  A case as long as the log thus sends each task's few
    rows, and no task holds its events.
    """
    case_cols = case_attribute_columns(log) if include_case_attributes else []
    ev_cols = event_attribute_columns(log, case_cols, exclude=["case:endDate", "endDate", "case:end_time", "end_time"]) \
        if include_event_attributes else []
    act = F.coalesce(F.col(ACT), F.lit("UNKNOWN"))
    order = F.struct(TS, IDX)
    aggs = [F.count(F.lit(1)).alias("prefix_len"), F.min(TS).alias("_start"), F.max(TS).alias("prefix_end_time"),
            F.max_by(act, order).alias("last_activity")]
    for c in case_cols:
        aggs.append(F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), order))
                    .alias(f"{case_out_prefix}{c[5:] if c.startswith('case:') else c}"))
    for c in ev_cols:
        aggs.append(F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), order)).alias(f"{event_out_prefix}{c}"))
    counts = (log.groupBy(CASE, act.alias("_a")).agg(F.count(F.lit(1)).alias("_n")).groupBy(CASE)
              .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_a", "_n")))).alias("activity_counts")))
    events = log.select(CASE, TS, IDX, act.alias("_a"))
    first = (events.withColumn("_r", F.row_number().over(Window.partitionBy(CASE).orderBy(TS, IDX)))
             .where(F.col("_r") <= positions).groupBy(CASE)
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_a"))), lambda e: e["_a"]).alias("prefix_activities")))
    before_last = (events.withColumn("_r", F.row_number().over(Window.partitionBy(CASE).orderBy(F.desc(TS), F.desc(IDX))))
                   .where(F.col("_r") <= 2).where(F.col("_r") == 2).select(CASE, F.col(TS).alias("_prev_ts")))
    state = (log.groupBy(CASE).agg(*aggs).join(counts, CASE).join(first, CASE).join(before_last, CASE, "left")
             .withColumn("prefix_len", F.col("prefix_len").cast("int")))
    elapsed = F.greatest(F.coalesce(seconds_between("_start", "prefix_end_time"), F.lit(0.0)), F.lit(0.0))
    since = F.greatest(F.coalesce(seconds_between("_prev_ts", "prefix_end_time"), F.lit(0.0)), F.lit(0.0))
    return state.select("*", elapsed.alias(f"{feat_prefix}elapsed_time_sec"), since.alias(f"{feat_prefix}time_since_last_event_sec"),
                        log1p_nonneg(elapsed).alias(f"{feat_prefix}elapsed_time_log1p"),
                        log1p_nonneg(since).alias(f"{feat_prefix}time_since_last_log1p"),
                        *calendar_features("prefix_end_time", prefix=f"{feat_prefix}prefix_end_")).drop("_start", "_prev_ts")


def prefix_qc(prefixes: DataFrame) -> DataFrame:
    """PFX-6: rows, cases, max prefix length."""
    return prefixes.agg(F.count(F.lit(1)).cast("bigint").alias("n_prefix_rows"),
                        F.count_distinct(CASE).cast("bigint").alias("n_cases"),
                        F.max("prefix_len").cast("bigint").alias("max_prefix_len"))
