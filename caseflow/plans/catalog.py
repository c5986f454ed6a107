"""Query catalogue: one Spark query per operator, each over the whole test tables.

Every function takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the DuckDB twin in ``caseflow.plans.oracle``.  Doubles are rounded
half-up (``round_half_up``) and timestamps returned as ``timestamp_ntz`` so the
two engines hash the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.functions.scalar import round_half_up
from caseflow.operators import filters, labels, prefixes, schema
from caseflow.sources import testlogs

ntz = lambda c: F.col(c).cast("timestamp_ntz")


def clean_line_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line log -> dedup (keep first) -> drop single-event cases."""
    log = testlogs.line_log(spark, sf_dir)
    return filters.filter_short_cases(filters.deduplicate_events(log), 2)


def q_prefix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship (§7.2): prefixes of the cleaned line log, summarised by
    (prefix_len, last activity, next activity): count and mean remaining time."""
    p = prefixes.extract_prefixes(clean_line_log(spark, sf_dir), include_event_attributes=False)
    return (p.groupBy("prefix_len", F.element_at("prefix_activities", -1).alias("last_activity"),
                      "label_next_activity")
            .agg(F.count(F.lit(1)).alias("n_prefixes"),
                 round_half_up(F.avg("label_remaining_time_sec"), 2).alias("avg_remaining_sec")))


def q_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PFX-1 / LBL-4 / LBL-6: every prefix row of the cleaned line log."""
    p = prefixes.extract_prefixes(clean_line_log(spark, sf_dir), include_event_attributes=False,
                                  add_time_features=False)
    return p.select("case_id", "prefix_len", F.concat_ws(">", "prefix_activities").alias("prefix_path"),
                    ntz("prefix_end_time").alias("prefix_end_time"), "label_next_activity",
                    round_half_up("label_remaining_time_sec", 3).alias("label_remaining_time_sec"),
                    round_half_up("label_remaining_time_log1p", 6).alias("label_remaining_time_log1p"))


def q_case_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LBL-1/3: start, end and last-event outcome per case (customer log, outcome = priority)."""
    log = testlogs.customer_log(spark, sf_dir)
    t = labels.case_table(log, outcome_col="o_orderpriority", outcome_values="1-URGENT,2-HIGH")
    return t.select("case_id", ntz("case_start_time").alias("case_start_time"),
                    ntz("case_end_time").alias("case_end_time"), "label_outcome")


def q_dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-1: keep-first dedup on (case, activity, timestamp) of the line log."""
    d = filters.deduplicate_events(testlogs.line_log(spark, sf_dir))
    return d.select("case_id", "activity", ntz("timestamp").alias("timestamp"), "_event_index",
                    "l_suppkey", "l_quantity")


def q_filter_short_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-3 on the user-day log (many single-event cases)."""
    d = filters.filter_short_cases(testlogs.user_day_log(spark, sf_dir), 2)
    return d.select("case_id", "activity", ntz("timestamp").alias("timestamp"), "_event_index")


QUERIES = {
    "prefix_summary": q_prefix_summary,
    "prefixes": q_prefixes,
    "case_labels": q_case_labels,
    "dedup_events": q_dedup_events,
    "filter_short_cases": q_filter_short_cases,
}


# ---------------------------------------------------------------- derived logs with planted nulls / noise
# The test tables have no nulls, so null and disorder paths are planted with
# deterministic rules on the row key (same rule in the DuckDB twin).

def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _out(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[ntz(c).alias(c) if c in ("timestamp",) else F.col(f"`{c}`") for c in cols])


def q_canonical_schema(spark, sf_dir):
    """PRJ-1: candidates CaseID (has nulls) vs trace_id (none) -> trace_id; Activity before task; time."""
    e = _events(spark, sf_dir)
    raw = e.select(F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("CaseID"),
                   F.col("user_id").cast("string").alias("trace_id"), F.col("event_type").alias("Activity"),
                   F.concat(F.col("event_type"), F.lit("_x")).alias("task"), F.col("ts").alias("time"), "event_id")
    n = schema.normalize_schema(raw)
    return _out(n, ["CaseID", "case_id", "activity", "task", "timestamp", "event_id"])


def _noisy_user_log(spark, sf_dir):
    log = testlogs.user_log(spark, sf_dir)
    i = F.col("_event_index")
    act = (F.when(i % 13 == 0, F.lit(None)).when(i % 11 == 0, F.lit("nan")).when(i % 7 == 0, F.lit(""))
           .when(i % 5 == 0, F.concat(F.lit(" "), F.col("activity"), F.lit(" "))).otherwise(F.col("activity")))
    ts = F.when(i % 17 == 0, F.lit(None)).otherwise(F.col("timestamp"))
    return log.withColumn("activity", act).withColumn("timestamp", ts)


def q_clean_events(spark, sf_dir):
    """PRJ-5: null time dropped, null activity -> UNKNOWN."""
    c = schema.clean_events(_noisy_user_log(spark, sf_dir))
    return _out(c, ["case_id", "activity", "timestamp", "_event_index"])


def q_normalize_activities(spark, sf_dir):
    """PRJ-6: trim; '', 'nan', 'None', null -> UNKNOWN."""
    c = schema.normalize_activities(_noisy_user_log(spark, sf_dir))
    return _out(c, ["case_id", "activity", "_event_index"])


def _shuffled_time_log(spark, sf_dir):
    log = testlogs.user_log(spark, sf_dir)
    back = F.col("timestamp") - F.expr("INTERVAL 2 HOURS")
    return log.withColumn("timestamp", F.when(F.col("_event_index") % 4 == 0, back).otherwise(F.col("timestamp")))


def q_repair_ts_ffill(spark, sf_dir):
    """PRJ-7: running max of time in source order."""
    return _out(schema.repair_timestamps(_shuffled_time_log(spark, sf_dir), "forward_fill"),
                ["case_id", "_event_index", "timestamp"])


def q_repair_ts_drop(spark, sf_dir):
    """PRJ-8: drop events earlier than their original predecessor."""
    return _out(schema.repair_timestamps(_shuffled_time_log(spark, sf_dir), "drop"),
                ["case_id", "_event_index", "timestamp"])


def _holey_customer_log(spark, sf_dir):
    log = testlogs.customer_log(spark, sf_dir)
    k = F.col("_event_index")
    return (log.withColumn("o_totalprice", F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("o_totalprice")))
            .withColumn("o_orderpriority", F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))))


def q_impute_attrs(spark, sf_dir):
    """PRJ-9: numeric null -> median, text null -> mode (ties: smallest)."""
    c = schema.impute_missing_attributes(_holey_customer_log(spark, sf_dir))
    return c.select("case_id", "_event_index", "o_orderpriority", round_half_up("o_totalprice", 4).alias("o_totalprice"))


def q_drop_columns(spark, sf_dir):
    """PRJ-4: listed columns dropped, unknown names ignored."""
    d = schema.drop_columns(testlogs.customer_log(spark, sf_dir), ["o_totalprice", "not_there"])
    return _out(d, d.columns)


def q_dedup_stats(spark, sf_dir):
    """FLT-2 on the line log."""
    return filters.dedup_stats(testlogs.line_log(spark, sf_dir)).select(
        "n_rows", "n_dropped", "n_dup_groups", "max_group_size", round_half_up("dup_rate", 6).alias("dup_rate"))


def q_dedup_keep_last(spark, sf_dir):
    """FLT-1 keep='last' on the customer log."""
    d = filters.deduplicate_events(testlogs.customer_log(spark, sf_dir), keep="last")
    return _out(d, ["case_id", "activity", "timestamp", "_event_index"])


def q_dedup_keep_none(spark, sf_dir):
    """FLT-1 keep=none: every duplicated key disappears."""
    d = filters.deduplicate_events(testlogs.customer_log(spark, sf_dir), keep="none")
    return _out(d, ["case_id", "activity", "timestamp", "_event_index"])


def q_filter_case_length(spark, sf_dir):
    """FLT-4: customer cases longer than int(p99 length) dropped."""
    d = filters.filter_case_length(testlogs.customer_log(spark, sf_dir), 99.0)
    return d.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_events"))


def q_filter_zero_duration(spark, sf_dir):
    """FLT-5 on the line log."""
    d = filters.filter_zero_duration_cases(testlogs.line_log(spark, sf_dir))
    return d.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_events"))


def _fine_activity_log(spark, sf_dir):
    log = testlogs.user_day_log(spark, sf_dir)
    return log.withColumn("activity", F.concat_ws(":", F.col("activity"), (F.col("prop_k") % 20).cast("string")))


def q_filter_infrequent_activities(spark, sf_dir):
    """FLT-6: activities in fewer than max(1, int(0.005 * #cases)) cases dropped."""
    d = filters.filter_infrequent_activities(_fine_activity_log(spark, sf_dir), 0.005)
    return d.groupBy("activity").agg(F.count(F.lit(1)).alias("n_events"))


def q_filter_consecutive_dups(spark, sf_dir):
    """FLT-7 on the user log."""
    return _out(filters.filter_consecutive_duplicates(testlogs.user_log(spark, sf_dir)),
                ["case_id", "activity", "_event_index"])


def q_filter_rare_variants(spark, sf_dir):
    """FLT-8: user-day cases whose variant occurs in < 5 cases dropped."""
    d = filters.filter_rare_variants(testlogs.user_day_log(spark, sf_dir), 5)
    return _out(d, ["case_id", "activity", "_event_index"])


def q_since_date(spark, sf_dir):
    """FLT-9: user-day cases starting on/after 2024-01-15."""
    return _out(filters.filter_since_date(testlogs.user_day_log(spark, sf_dir), "2024-01-15"),
                ["case_id", "_event_index"])


def q_recent_pct(spark, sf_dir):
    """FLT-10: latest 80 % of customer cases by start (ties by case_id)."""
    d = filters.filter_recent_pct(testlogs.customer_log(spark, sf_dir), 80.0)
    return d.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_events"))


def _lifecycle_log(spark, sf_dir):
    log = testlogs.user_log(spark, sf_dir)
    lc = (F.when(F.col("activity").isin("view", "click"), F.lit(" Start"))
          .when(F.col("_event_index") % 9 == 0, F.lit(None)).otherwise(F.lit("complete ")))
    return log.withColumn("lifecycle:transition", lc)


def q_lifecycle_keep(spark, sf_dir):
    """FLT-11: keep 'complete' (trim, case-insensitive)."""
    return _out(filters.lifecycle_keep(_lifecycle_log(spark, sf_dir), ["COMPLETE"]), ["case_id", "_event_index"])


def q_lifecycle_drop(spark, sf_dir):
    """FLT-12: drop exact ' Start'."""
    return _out(filters.lifecycle_drop(_lifecycle_log(spark, sf_dir), [" Start"]), ["case_id", "_event_index"])


def q_lifecycle_collapse_occurrence(spark, sf_dir):
    """WIN-9/10 without EventID: group by (case, activity, occurrence)."""
    from caseflow.operators.lifecycle import lifecycle_collapse
    d = lifecycle_collapse(_lifecycle_log(spark, sf_dir), use_event_id=False)
    return _out(d, ["case_id", "activity", "_occurrence", "_event_index", "timestamp"])


def q_lifecycle_collapse_id(spark, sf_dir):
    """WIN-10 with EventID (= prop_k as text): group by (case, EventID)."""
    from caseflow.operators.lifecycle import lifecycle_collapse
    log = _lifecycle_log(spark, sf_dir).withColumn("EventID", F.col("prop_k").cast("string"))
    d = lifecycle_collapse(log, use_event_id=True)
    return _out(d, ["case_id", "EventID", "activity", "_event_index", "timestamp"])


QUERIES.update({
    "canonical_schema": q_canonical_schema,
    "clean_events": q_clean_events,
    "normalize_activities": q_normalize_activities,
    "repair_ts_ffill": q_repair_ts_ffill,
    "repair_ts_drop": q_repair_ts_drop,
    "impute_attrs": q_impute_attrs,
    "drop_columns": q_drop_columns,
    "dedup_stats": q_dedup_stats,
    "dedup_keep_last": q_dedup_keep_last,
    "dedup_keep_none": q_dedup_keep_none,
    "filter_case_length": q_filter_case_length,
    "filter_zero_duration": q_filter_zero_duration,
    "filter_infrequent_activities": q_filter_infrequent_activities,
    "filter_consecutive_dups": q_filter_consecutive_dups,
    "filter_rare_variants": q_filter_rare_variants,
    "since_date": q_since_date,
    "recent_pct": q_recent_pct,
    "lifecycle_keep": q_lifecycle_keep,
    "lifecycle_drop": q_lifecycle_drop,
    "lifecycle_collapse_occurrence": q_lifecycle_collapse_occurrence,
    "lifecycle_collapse_id": q_lifecycle_collapse_id,
})


# ---------------------------------------------------------------- labels, prefixes, splits, buckets, encoders

def customer_case_log(spark, sf_dir):
    """Customer log + case attributes from ``customer`` and planted nulls in event attributes."""
    log = _holey_customer_log(spark, sf_dir)
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").cast("string").alias("case_id"), F.col("c_mktsegment").alias("case:segment"),
        F.col("c_acctbal").alias("case:acctbal"))
    return log.join(cust, "case_id")


def model_prefixes(spark, sf_dir, max_prefix_len: int = 30, **kw):
    return prefixes.extract_prefixes(customer_case_log(spark, sf_dir), max_prefix_len=max_prefix_len, **kw)


def model_frame(spark, sf_dir, activities: bool = True):
    """Prefixes of the customer log with a random case split (the modelling base).

    Fitting and scoring read this frame many times (vocabularies, encoders,
    bucketers, metrics), so it is materialised once in the checkpoint folder.
    Without ``activities`` (``last_state`` reads none) their lists are neither gathered nor written.
    """
    from caseflow.operators.splits import attach_split, split_cases
    from caseflow.session import materialize
    log = customer_case_log(spark, sf_dir)
    p = prefixes.extract_prefixes(log)
    return materialize(attach_split(p if activities else p.drop("prefix_activities"), split_cases(log)))


def q_end_override(spark, sf_dir):
    """LBL-2: case:endDate (first non-null) replaces the end when not earlier."""
    log = testlogs.customer_log(spark, sf_dir)
    k = F.col("_event_index")
    end = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.col("timestamp") + F.expr("INTERVAL 400 DAYS")) \
        .otherwise(F.col("timestamp") - F.expr("INTERVAL 1 DAYS"))
    t = labels.case_table(log.withColumn("case:endDate", end))
    return t.select("case_id", ntz("case_end_time").alias("case_end_time"), "label_outcome")


def q_next_attribute_labels(spark, sf_dir):
    """LBL-5: label of the next event's priority; null -> 'unknown'."""
    p = model_prefixes(spark, sf_dir, next_event_attr_cols=["o_orderpriority", "absent_col"],
                       include_event_attributes=False, add_time_features=False)
    return p.select("case_id", "prefix_len", "label_next_activity", "label_next_o_orderpriority", "label_next_absent_col")


def q_prefix_time_features(spark, sf_dir):
    """PFX-2 + LBL-6: elapsed, since-last and their log1p; remaining time."""
    p = model_prefixes(spark, sf_dir, include_event_attributes=False, include_case_attributes=False,
                       add_calendar_features=False)
    return p.select("case_id", "prefix_len",
                    round_half_up("feat_elapsed_time_sec", 3).alias("feat_elapsed_time_sec"),
                    round_half_up("feat_time_since_last_event_sec", 3).alias("feat_time_since_last_event_sec"),
                    round_half_up("feat_elapsed_time_log1p", 6).alias("feat_elapsed_time_log1p"),
                    round_half_up("feat_time_since_last_log1p", 6).alias("feat_time_since_last_log1p"),
                    round_half_up("label_remaining_time_sec", 3).alias("label_remaining_time_sec"))


def q_prefix_calendar(spark, sf_dir):
    """PFX-3: hour, weekday (Mon=0), weekend flag, month of the prefix end (user log, sub-day times)."""
    p = prefixes.extract_prefixes(testlogs.user_log(spark, sf_dir), include_event_attributes=False)
    return p.select("case_id", "prefix_len", "feat_prefix_end_hour", "feat_prefix_end_weekday",
                    "feat_prefix_end_is_weekend", "feat_prefix_end_month")


def q_prefix_case_attrs(spark, sf_dir):
    """PFX-4: case:* columns -> case__* (first non-null per case)."""
    p = model_prefixes(spark, sf_dir, include_event_attributes=False, add_time_features=False)
    return p.select("case_id", "prefix_len", "case__segment", round_half_up("case__acctbal", 4).alias("case__acctbal"))


def q_prefix_event_attrs(spark, sf_dir):
    """PFX-5 (last_non_null): last non-null event attribute within the prefix."""
    p = model_prefixes(spark, sf_dir, include_case_attributes=False, add_time_features=False)
    return p.select("case_id", "prefix_len", "event_last__o_orderpriority",
                    round_half_up("event_last__o_totalprice", 4).alias("event_last__o_totalprice"))


def q_prefix_event_attrs_last(spark, sf_dir):
    """PFX-5 (last): attribute of the prefix's last event, nulls kept."""
    p = model_prefixes(spark, sf_dir, include_case_attributes=False, add_time_features=False,
                       event_agg_policy="last")
    return p.select("case_id", "prefix_len", "event_last__o_orderpriority",
                    round_half_up("event_last__o_totalprice", 4).alias("event_last__o_totalprice"))


def q_running_case_prefix(spark, sf_dir):
    """INF-1: one scoring row per case from all its events (capped at 30), single-event cases included."""
    p = prefixes.running_case_prefixes(testlogs.user_day_log(spark, sf_dir), include_event_attributes=False)
    return p.select("case_id", "prefix_len", F.concat_ws(">", "prefix_activities").alias("prefix_path"),
                    round_half_up("feat_elapsed_time_sec", 3).alias("feat_elapsed_time_sec"),
                    round_half_up("feat_time_since_last_event_sec", 3).alias("feat_time_since_last_event_sec"))


def q_split_random(spark, sf_dir):
    """SPL-1: cases ordered by md5('42:'||case_id); 70 / 15 / 15."""
    from caseflow.operators.splits import split_cases
    return split_cases(testlogs.customer_log(spark, sf_dir))


def q_split_temporal(spark, sf_dir):
    """SPL-2: cases ordered by start time (ties by id); 70 / 15 / 15."""
    from caseflow.operators.splits import split_cases
    return split_cases(testlogs.customer_log(spark, sf_dir), temporal=True)


def _bucket_query(spark, sf_dir, bucketer):
    from caseflow.operators.bucketing import bucketize
    b, _ = bucketize(model_frame(spark, sf_dir), bucketer)
    return b.select("case_id", "prefix_len", "split", "bucket_id")


def q_bucket_none(spark, sf_dir):
    """BKT-1."""
    from caseflow.operators.bucketing import NoBucket
    return _bucket_query(spark, sf_dir, NoBucket())


def q_bucket_bins(spark, sf_dir):
    """BKT-2: bins of 5, max = train max prefix length."""
    from caseflow.operators.bucketing import PrefixLenBins
    return _bucket_query(spark, sf_dir, PrefixLenBins(bin_size=5))


def q_bucket_adaptive(spark, sf_dir):
    """BKT-3: edges from train median / max."""
    from caseflow.operators.bucketing import PrefixLenAdaptive
    return _bucket_query(spark, sf_dir, PrefixLenAdaptive())


def q_bucket_last_activity(spark, sf_dir):
    """BKT-4 on the fine-grained user-day log (some last activities unseen in train)."""
    from caseflow.operators.bucketing import LastActivity, bucketize
    from caseflow.operators.splits import attach_split, split_cases
    log = _fine_activity_log(spark, sf_dir)
    p = attach_split(prefixes.extract_prefixes(log, include_event_attributes=False), split_cases(log))
    b, _ = bucketize(p, LastActivity())
    return b.select("case_id", "prefix_len", "split", "bucket_id")


def q_bucket_cluster(spark, sf_dir):
    """BKT-5: KMeans bucket ids (rows-only: ids are arbitrary)."""
    from caseflow.operators.bucketing import ClusterBucketer
    return _bucket_query(spark, sf_dir, ClusterBucketer(n_clusters=3))


CAT_COLS = ["case__segment", "event_last__o_orderpriority"]


def _train(spark, sf_dir):
    return model_frame(spark, sf_dir).where(F.col("split") == "train")


def q_category_vocab(spark, sf_dir):
    """ENC-2: ≥ 50 train rows, top 20 per column."""
    from caseflow.operators.encoding import category_vocab
    return category_vocab(_train(spark, sf_dir), CAT_COLS, 50, 20)


def q_category_vocab_small(spark, sf_dir):
    """ENC-2 with a cap smaller than the alphabet (top 3, min 1)."""
    from caseflow.operators.encoding import category_vocab
    return category_vocab(_train(spark, sf_dir), CAT_COLS, 1, 3)


def q_onehot_long(spark, sf_dir):
    """ENC-3: slot per (prefix, column), unseen / null -> 0."""
    from caseflow.operators.encoding import category_vocab, onehot_long
    mf = model_frame(spark, sf_dir)
    vocab = category_vocab(mf.where(F.col("split") == "train"), CAT_COLS, 1, 3)
    return onehot_long(mf, vocab, CAT_COLS)


def q_last_state_long(spark, sf_dir):
    """ENC-5 long: prefix_len, numeric snapshot features (null -> 0), one-hot indicators."""
    from caseflow.operators.encoding import category_vocab, infer_feature_columns, last_state_long
    mf = model_frame(spark, sf_dir)
    num, cat = infer_feature_columns(mf)
    vocab = category_vocab(mf.where(F.col("split") == "train"), cat, 50, 20)
    return last_state_long(mf, vocab, num, cat).withColumn("value", round_half_up("value", 4))


def q_activity_counts(spark, sf_dir):
    """ENC-6 long: activity-slot counts per prefix (train vocabulary, UNK = 0)."""
    from caseflow.operators.encoding import activity_counts_long, activity_vocab
    log = _fine_activity_log(spark, sf_dir)
    from caseflow.operators.splits import attach_split, split_cases
    p = attach_split(prefixes.extract_prefixes(log, include_event_attributes=False), split_cases(log))
    return activity_counts_long(p, activity_vocab(p.where(F.col("split") == "train")))


def q_positional_activity(spark, sf_dir):
    """ENC-7 long: activity slot at each position up to the longest train prefix (padding = UNK)."""
    from caseflow.operators.encoding import activity_vocab, positional_activity_long
    mf = model_frame(spark, sf_dir)
    train = mf.where(F.col("split") == "train")
    longest = train.agg(F.max("prefix_len")).first()[0] or 1
    return positional_activity_long(mf, activity_vocab(train), longest)


def q_target_encoding(spark, sf_dir):
    """ENC-8: m-estimate encoding of priority on the remaining-time label (train)."""
    from caseflow.operators.encoding import target_encoding
    te = target_encoding(_train(spark, sf_dir), "event_last__o_orderpriority", "label_remaining_time_sec")
    return te.select("category", "n", round_half_up("encoding", 3).alias("encoding"))


def q_activity_target_encoding(spark, sf_dir):
    """ENC-9: activity encoding from exploded train prefixes."""
    from caseflow.operators.encoding import activity_target_encoding
    te = activity_target_encoding(_train(spark, sf_dir), "label_remaining_time_sec")
    return te.select("category", "n", round_half_up("encoding", 3).alias("encoding"))


def q_embedding_mean_last(spark, sf_dir):
    """ENC-10 long with a fixed lookup: activity slot s -> embeddings.vec_id = s - 1."""
    from caseflow.operators.encoding import activity_vectors, activity_vocab, embedding_mean_last_long
    mf = model_frame(spark, sf_dir)
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vec = activity_vectors(activity_vocab(mf.where(F.col("split") == "train")), emb)
    e = embedding_mean_last_long(mf, vec)
    return e.select("case_id", "prefix_len", "dim", round_half_up("mean_value", 5).alias("mean_value"),
                    round_half_up("last_value", 5).alias("last_value"))


def wide_case_table(spark, sf_dir):
    """Aggregated case table derived from orders: seconds per status (price / 100) and counts."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    g = o.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("started"), F.max("o_orderdate").alias("ended"),
        *[F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice") / 100.0)).alias(f"wf_{s}") for s in "OFP"],
        *[F.count_if(F.col("o_orderstatus") == s).alias(f"wfe_{s}") for s in "OFP"],
        F.max("o_orderpriority").alias("top_priority"))
    return g.withColumnRenamed("o_custkey", "id")


def q_aggregated_to_events(spark, sf_dir):
    """SRC-5: wide per-customer table -> events spread over each state's time."""
    from caseflow.sources.aggregated import aggregated_to_events
    ev = aggregated_to_events(wide_case_table(spark, sf_dir))
    return ev.select("case_id", "activity", ntz("timestamp").alias("timestamp"), "_event_index", "case:top_priority")


def q_load_qc(spark, sf_dir):
    """SRC-6: load QC of the user log."""
    from caseflow.plans.profile import load_qc
    q = load_qc(testlogs.user_log(spark, sf_dir))
    return q.select("n_rows", "n_columns", "n_cases", "n_ts_parse_failures", ntz("min_time").alias("min_time"),
                    ntz("max_time").alias("max_time"))


def q_parse_activities(spark, sf_dir):
    """SCL-9: activity lists given as JSON array / JSON scalar / ';' or ',' text; escapes and literals in JSON."""
    from caseflow.functions.scalar import parse_activities
    e = _events(spark, sf_dir)
    m = F.col("event_id") % 6
    text = (F.when(m == 0, F.concat(F.lit('["'), F.col("event_type"), F.lit('", "x"]')))
            .when(m == 1, F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
            .when(m == 2, F.concat(F.col("event_type"), F.lit("; y ;z")))
            .when(m == 4, F.concat(F.lit('"'), F.col("event_type"), F.lit('\\",z"')))
            .when(m == 5, F.concat(F.lit('[true, null, 7, "'), F.col("event_type"), F.lit('\\n,;"]')))
            .otherwise(F.concat(F.col("event_type"), F.lit(", ,w"))))
    return e.select("event_id", F.concat_ws(">", parse_activities(text)).alias("activities"))


QUERIES.update({
    "end_override": q_end_override,
    "next_attribute_labels": q_next_attribute_labels,
    "prefix_time_features": q_prefix_time_features,
    "prefix_calendar": q_prefix_calendar,
    "prefix_case_attrs": q_prefix_case_attrs,
    "prefix_event_attrs": q_prefix_event_attrs,
    "prefix_event_attrs_last": q_prefix_event_attrs_last,
    "running_case_prefix": q_running_case_prefix,
    "split_random": q_split_random,
    "split_temporal": q_split_temporal,
    "bucket_none": q_bucket_none,
    "bucket_bins": q_bucket_bins,
    "bucket_adaptive": q_bucket_adaptive,
    "bucket_last_activity": q_bucket_last_activity,
    "bucket_cluster": q_bucket_cluster,
    "category_vocab": q_category_vocab,
    "category_vocab_small": q_category_vocab_small,
    "onehot_long": q_onehot_long,
    "last_state_long": q_last_state_long,
    "activity_counts": q_activity_counts,
    "positional_activity": q_positional_activity,
    "target_encoding": q_target_encoding,
    "activity_target_encoding": q_activity_target_encoding,
    "embedding_mean_last": q_embedding_mean_last,
    "aggregated_to_events": q_aggregated_to_events,
    "load_qc": q_load_qc,
    "parse_activities": q_parse_activities,
})


# ---------------------------------------------------------------- profiling (AGG-*)
from caseflow.plans import profile as prof  # noqa: E402


def _r(df: DataFrame, cols: dict) -> DataFrame:
    """Round the named double columns half-up."""
    return df.withColumns({c: round_half_up(c, d) for c, d in cols.items()})


def q_trace_length_stats(spark, sf_dir):
    s = prof.trace_length_stats(testlogs.customer_log(spark, sf_dir))
    return _r(s, {"len_median": 4, "len_mean": 4, "len_p95": 4}).withColumns(
        {"min_time": ntz("min_time"), "max_time": ntz("max_time")})


def q_case_duration_stats(spark, sf_dir):
    s = prof.case_duration_stats(testlogs.line_log(spark, sf_dir))
    return _r(s, {c: 4 for c in ["dur_min_days", "dur_median_days", "dur_mean_days", "dur_p95_days", "dur_max_days"]})


def q_activity_frequency(spark, sf_dir):
    return prof.activity_frequency(_fine_activity_log(spark, sf_dir))


def q_consecutive_dup_count(spark, sf_dir):
    return prof.consecutive_duplicate_count(testlogs.user_log(spark, sf_dir))


def q_missing_values(spark, sf_dir):
    return _r(prof.missing_values(_holey_customer_log(spark, sf_dir)), {"pct_missing": 4})


def q_variant_stats(spark, sf_dir):
    return prof.variant_stats(testlogs.user_day_log(spark, sf_dir))


def q_top_variants(spark, sf_dir):
    return _r(prof.top_variants(testlogs.user_day_log(spark, sf_dir), 10), {"pct": 4})


def q_column_profile(spark, sf_dir):
    p = prof.column_profile(_holey_customer_log(spark, sf_dir))
    return _r(p, {"pct_null": 4, "pct_blank": 4}).withColumn("sample_values", F.concat_ws("|", "sample_values"))


def q_outcome_candidates(spark, sf_dir):
    return prof.outcome_candidates(_holey_customer_log(spark, sf_dir))


def q_event_attribute_candidates(spark, sf_dir):
    return prof.event_attribute_candidates(_holey_customer_log(spark, sf_dir))


def q_activity_counts_pct(spark, sf_dir):
    return _r(prof.activity_counts_pct(_fine_activity_log(spark, sf_dir), 30), {"pct": 4})


def q_duration_stats(spark, sf_dir):
    return _r(prof.duration_stats(testlogs.line_log(spark, sf_dir)), {"p25_days": 4, "p75_days": 4, "p90_days": 4})


def q_duration_histogram(spark, sf_dir):
    return prof.duration_histogram(testlogs.line_log(spark, sf_dir))


def q_case_length_histogram(spark, sf_dir):
    return prof.case_length_histogram(testlogs.customer_log(spark, sf_dir))


def q_auto_max_prefix_len(spark, sf_dir):
    return prof.auto_max_prefix_len(testlogs.customer_log(spark, sf_dir))


def q_missing_cell_rate(spark, sf_dir):
    return _r(prof.missing_cell_rate(_holey_customer_log(spark, sf_dir)), {"missing_rate": 6})


def q_events_per_month(spark, sf_dir):
    return prof.events_per_month(testlogs.customer_log(spark, sf_dir))


def q_lifecycle_values(spark, sf_dir):
    return prof.lifecycle_values(_lifecycle_log(spark, sf_dir))


def q_avg_case_duration(spark, sf_dir):
    return _r(prof.avg_case_duration_days(testlogs.customer_log(spark, sf_dir)), {"avg_case_duration_days": 4})


def q_label_qc_numeric(spark, sf_dir):
    q = prof.label_qc(model_frame(spark, sf_dir), "label_remaining_time_sec", True)
    return _r(q, {c: 3 for c in ["min", "max", "q5", "q9", "q95", "q99", "q999"]})


def q_label_qc_classes(spark, sf_dir):
    return prof.label_qc(model_frame(spark, sf_dir), "label_next_activity", False)


def q_outcome_distribution(spark, sf_dir):
    log = testlogs.customer_log(spark, sf_dir)
    return labels.outcome_distribution(labels.case_table(log, outcome_col="o_orderpriority"))


def q_bucket_size_stats(spark, sf_dir):
    """AGG-21: number of buckets, min / median / max size (adaptive buckets)."""
    from caseflow.operators.bucketing import PrefixLenAdaptive, bucket_sizes, bucketize
    b, _ = bucketize(model_frame(spark, sf_dir), PrefixLenAdaptive())
    s = bucket_sizes(b)
    return s.agg(F.count(F.lit(1)).alias("n_buckets"), F.min("n_rows").alias("min_size"),
                 F.percentile(F.col("n_rows").cast("double"), F.lit(0.5)).alias("median_size"),
                 F.max("n_rows").alias("max_size"))


# ---------------------------------------------------------------- train-fitted filters, metrics, exemplars
from caseflow.operators import metrics as met  # noqa: E402
from caseflow.operators import models as mdl  # noqa: E402
from caseflow.operators import sampling as smp  # noqa: E402
from caseflow.functions.scalar import attach_scalars


def q_iqr_outliers(spark, sf_dir):
    """FLT-13: IQR filter on train remaining times."""
    f = smp.filter_iqr_outliers(model_frame(spark, sf_dir))
    return f.select("case_id", "prefix_len", "split")


def q_rare_classes(spark, sf_dir):
    """FLT-14 on next-priority labels (min 700 train rows)."""
    log = customer_case_log(spark, sf_dir)
    from caseflow.operators.splits import attach_split, split_cases
    p = attach_split(prefixes.extract_prefixes(log, next_event_attr_cols=["o_orderpriority"]), split_cases(log))
    f = smp.filter_rare_classes(p, "label_next_o_orderpriority", 700)
    return f.select("case_id", "prefix_len", "split", "label_next_o_orderpriority")


def q_small_buckets(spark, sf_dir):
    """FLT-15: bins buckets (size 2) with fewer than 400 rows removed."""
    from caseflow.operators.bucketing import PrefixLenBins, bucketize
    b, _ = bucketize(model_frame(spark, sf_dir), PrefixLenBins(bin_size=2), min_bucket_size=400)
    return b.select("case_id", "prefix_len", "bucket_id")


def q_bucket_eligibility(spark, sf_dir):
    """FLT-16: per adaptive bucket: train / val sizes, classes, eligibility (min 300)."""
    from caseflow.operators.bucketing import PrefixLenAdaptive, bucketize
    b, _ = bucketize(model_frame(spark, sf_dir), PrefixLenAdaptive())
    return smp.bucket_eligibility(b, 300, True, "label_next_activity")


def regression_predictions(spark, sf_dir):
    from caseflow.operators.bucketing import PrefixLenAdaptive, bucketize
    b, _ = bucketize(model_frame(spark, sf_dir), PrefixLenAdaptive())
    fit = mdl.mean_by_last_activity(b.where(F.col("split") == "train"))
    return mdl.predict_mean_by_last_activity(b.where(F.col("split") != "train"), fit)


def classification_predictions(spark, sf_dir):
    from caseflow.operators.bucketing import PrefixLenAdaptive, bucketize
    b, _ = bucketize(model_frame(spark, sf_dir), PrefixLenAdaptive())
    fit = mdl.majority_next_by_last_activity(b.where(F.col("split") == "train"))
    return mdl.predict_majority(b.where(F.col("split") != "train"), fit)


def q_f1_macro_micro(spark, sf_dir):
    """MET-1 on majority-next-activity predictions (val + test)."""
    return _r(met.f1_scores(classification_predictions(spark, sf_dir)), {"f1_macro": 6, "f1_micro": 6, "accuracy": 6})


def q_confusion(spark, sf_dir):
    """MET-7."""
    return met.confusion(classification_predictions(spark, sf_dir))


def q_per_class_f1(spark, sf_dir):
    """MET-8."""
    s = met.per_class_scores(classification_predictions(spark, sf_dir))
    return _r(s.drop("tp", "predicted"), {"precision": 6, "recall": 6, "f1": 6})


def q_binary_f1(spark, sf_dir):
    """MET-2 (F1 for positive class 'F')."""
    return _r(met.binary_f1(classification_predictions(spark, sf_dir), "F"), {"f1_binary": 6})


def q_mae_medae(spark, sf_dir):
    """MET-3 on target-encoding predictions of remaining time."""
    e = met.regression_errors(regression_predictions(spark, sf_dir))
    return _r(e, {"mae_sec": 2, "medae_sec": 2, "mae_days": 6, "medae_days": 6})


def q_per_bucket_metrics(spark, sf_dir):
    """MET-4 (regression, per adaptive bucket and split)."""
    e = met.regression_errors(regression_predictions(spark, sf_dir), group=["bucket_id", "split"])
    return _r(e, {"mae_sec": 2, "medae_sec": 2, "mae_days": 6, "medae_days": 6})


def q_per_bucket_classification(spark, sf_dir):
    """MET-4 (classification)."""
    return _r(met.per_bucket_classification(classification_predictions(spark, sf_dir)), {"f1_macro": 6, "accuracy": 6})


def q_weighted_score(spark, sf_dir):
    """MET-5 / MET-6: bucket-size weighted MAE equals the pooled MAE."""
    e = met.regression_errors(regression_predictions(spark, sf_dir), group=["bucket_id"])
    return _r(met.weighted_score(e, "mae_sec"), {"weighted_score": 2})


def q_error_by_prefix_len(spark, sf_dir):
    """MET-9."""
    return _r(met.error_by_prefix_len(regression_predictions(spark, sf_dir)), {"mean_abs_error": 2, "std_abs_error": 2})


def q_accuracy_by_prefix_len(spark, sf_dir):
    """MET-10."""
    return _r(met.accuracy_by_prefix_len(classification_predictions(spark, sf_dir)), {"accuracy": 6})


def q_error_histogram(spark, sf_dir):
    """MET-11: 50-bin residual histogram."""
    return _r(met.error_histogram(regression_predictions(spark, sf_dir)), {"bin_min": 2, "bin_max": 2})


def q_class_weights(spark, sf_dir):
    """MOD-3 on train next-activity labels."""
    return _r(met.class_weights(_train(spark, sf_dir), "label_next_activity"), {"weight": 6})


def q_worst_predictions(spark, sf_dir):
    """SRT-3: 10 largest absolute errors."""
    w = smp.worst_predictions(regression_predictions(spark, sf_dir), 10)
    return _r(w.select("case_id", "prefix_len", "y_true", "y_pred", "abs_error"),
              {"y_true": 2, "y_pred": 2, "abs_error": 2})


def q_quantile_exemplars(spark, sf_dir):
    """SRT-4: val rows nearest to the label quantiles .5 / .9 / .99."""
    v = model_frame(spark, sf_dir).where(F.col("split") == "val")
    e = smp.quantile_exemplars(v, "label_remaining_time_sec")
    return _r(e.select("quantile", "q_value", "case_id", "prefix_len", "label_remaining_time_sec"),
              {"q_value": 2, "label_remaining_time_sec": 2})


def q_nearest_bucket_model(spark, sf_dir):
    """JON-8: buckets without a model use the model of the nearest bucket id (ties: smaller id)."""
    from caseflow.plans.scoring import nearest_model
    from caseflow.operators.bucketing import PrefixLenBins, bucketize
    b, _ = bucketize(model_frame(spark, sf_dir), PrefixLenBins(bin_size=2))
    elig = smp.bucket_eligibility(b, 300, False, "label_remaining_time_sec")
    models = elig.where("eligible").select(F.col("bucket_id").alias("model_bucket"))
    buckets = b.select("bucket_id").distinct()
    return nearest_model(buckets, models)


QUERIES.update({
    "trace_length_stats": q_trace_length_stats,
    "case_duration_stats": q_case_duration_stats,
    "activity_frequency": q_activity_frequency,
    "consecutive_dup_count": q_consecutive_dup_count,
    "missing_values": q_missing_values,
    "variant_stats": q_variant_stats,
    "top_variants": q_top_variants,
    "column_profile": q_column_profile,
    "outcome_candidates": q_outcome_candidates,
    "event_attribute_candidates": q_event_attribute_candidates,
    "activity_counts_pct": q_activity_counts_pct,
    "duration_stats": q_duration_stats,
    "duration_histogram": q_duration_histogram,
    "case_length_histogram": q_case_length_histogram,
    "auto_max_prefix_len": q_auto_max_prefix_len,
    "missing_cell_rate": q_missing_cell_rate,
    "events_per_month": q_events_per_month,
    "lifecycle_values": q_lifecycle_values,
    "avg_case_duration": q_avg_case_duration,
    "label_qc_numeric": q_label_qc_numeric,
    "label_qc_classes": q_label_qc_classes,
    "outcome_distribution": q_outcome_distribution,
    "bucket_size_stats": q_bucket_size_stats,
    "iqr_outliers": q_iqr_outliers,
    "rare_classes": q_rare_classes,
    "small_buckets": q_small_buckets,
    "bucket_eligibility": q_bucket_eligibility,
    "f1_macro_micro": q_f1_macro_micro,
    "confusion": q_confusion,
    "per_class_f1": q_per_class_f1,
    "binary_f1": q_binary_f1,
    "mae_medae": q_mae_medae,
    "per_bucket_metrics": q_per_bucket_metrics,
    "per_bucket_classification": q_per_bucket_classification,
    "weighted_score": q_weighted_score,
    "error_by_prefix_len": q_error_by_prefix_len,
    "accuracy_by_prefix_len": q_accuracy_by_prefix_len,
    "error_histogram": q_error_histogram,
    "class_weights": q_class_weights,
    "worst_predictions": q_worst_predictions,
    "quantile_exemplars": q_quantile_exemplars,
    "nearest_bucket_model": q_nearest_bucket_model,
})


# ---------------------------------------------------------------- sources round trips, ablation, ML (rows-only)
import uuid  # noqa: E402

from caseflow.functions.scalar import small_side  # noqa: E402
from caseflow.session import materialize  # noqa: E402


def _scratch(spark, name: str) -> str:
    from caseflow.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex[:8]}"


def q_running_case_prefix_long(spark, sf_dir):
    """INF-1 on long cases (49-86 events): state at the latest event, all activities."""
    p = prefixes.running_case_prefixes(testlogs.user_log(spark, sf_dir), include_event_attributes=False)
    return p.select("case_id", "prefix_len", F.concat_ws(">", "prefix_activities").alias("prefix_path"),
                    round_half_up("feat_elapsed_time_sec", 3).alias("feat_elapsed_time_sec"),
                    round_half_up("feat_time_since_last_event_sec", 3).alias("feat_time_since_last_event_sec"))


def q_ablation_row_counts(spark, sf_dir):
    """EXP-7 / AGG-23: events / cases / prefix rows after each of the 17 cumulative stages, observed as they flow (line log)."""
    from caseflow.plans.ablation import ablation_row_counts
    return ablation_row_counts(testlogs.line_log(spark, sf_dir), since="1995-01-01")


def q_ablation_scores(spark, sf_dir):
    """EXP-7: counts, val MAE of a linear probe and its changes after each of 17 cumulative stages (customer log; rows-only)."""
    from caseflow.plans.ablation import ablation_scores
    return ablation_scores(customer_case_log(spark, sf_dir), since="1995-01-01")


def q_csv_source(spark, sf_dir):
    """SRC-2 + PRJ-1: the customer log written as CSV by Spark and read back as an event log."""
    from caseflow.sources.readers import read_csv_log
    path = _scratch(spark, "csv")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    (o.select(F.col("o_custkey").alias("CaseID"), F.col("o_orderstatus").alias("Activity"),
              F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("Timestamp"), "o_orderkey", "o_orderpriority")
     .write.option("header", True).csv(path))
    raw = read_csv_log(spark, path, schema="CaseID long, Activity string, Timestamp string, o_orderkey long, o_orderpriority string")
    log = schema.clean_events(schema.normalize_schema(raw))
    return log.select("case_id", "activity", ntz("timestamp").alias("timestamp"), "o_orderkey", "o_orderpriority")


def q_xes_source(spark, sf_dir):
    """SRC-3: the user log written as XES (trace / event elements) by Spark's XML writer, read back."""
    from caseflow.sources.readers import read_xes_log
    path = _scratch(spark, "xes")
    log = testlogs.user_log(spark, sf_dir)
    attr = lambda k, v: F.struct(F.lit(k).alias("_key"), v.alias("_value"))
    # cost is an int in even events and a float in odd ones
    odd, none = F.col("_event_index") % 2 != 0, F.array().cast("array<struct<_key:string,_value:string>>")
    cost = lambda more: F.array(attr("cost", (F.col("_event_index") + F.lit(more)).cast("string")))
    ev = log.select("case_id", F.struct(
        F.array(attr("concept:name", F.col("activity"))).alias("string"),
        F.array(attr("time:timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))).alias("date"),
        F.concat(F.array(attr("value", F.col("value").cast("string"))), F.when(odd, cost(0.5)).otherwise(none)).alias("float"),
        F.concat(F.array(attr("event_id", F.col("_event_index").cast("string"))),
                 F.when(odd, none).otherwise(cost(0))).alias("int"),
        F.struct(F.col("timestamp"), F.col("_event_index")).alias("_o")).alias("e"))
    traces = ev.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(F.col("e._o").alias("o"), F.col("e").alias("e"))))
                                       .alias("evs"))
    traces.select(F.array(attr("concept:name", F.col("case_id"))).alias("string"),
                  F.transform("evs", lambda x: x["e"].dropFields("_o")).alias("event")) \
        .write.format("xml").option("rootTag", "log").option("rowTag", "trace").save(path)
    raw = read_xes_log(spark, path)
    n = schema.normalize_schema(raw)
    return n.select("case_id", "activity", ntz("timestamp").alias("timestamp"), "event_id", "cost",
                    round_half_up("value", 4).alias("value"))


def q_linear_probe(spark, sf_dir):
    """MOD-1 / MOD-4: last_state encoding + scaled ridge-style linear regression, val predictions."""
    from caseflow.operators.encoding import fit_encoder
    mf = model_frame(spark, sf_dir)
    enc = fit_encoder("last_state", mf.where("split = 'train'"))
    data = enc.transform(mf)
    task = mdl.default_task_specs()["remaining_time"]
    _, pred = mdl.fit_predict(data.where("split = 'train'"), data.where("split = 'val'"), task, "linear")
    return pred.select("case_id", "prefix_len", "y_true", "y_pred")


def q_tree_probe(spark, sf_dir):
    """MOD-2 / MOD-3: aggregation encoding + weighted random forest on next activity, val predictions."""
    from caseflow.operators.encoding import fit_encoder, label_vocabulary
    mf = model_frame(spark, sf_dir)
    tr = mf.where("split = 'train'")
    lv = label_vocabulary(tr, "label_next_activity")
    enc = fit_encoder("aggregation", tr, label_col="label_next_activity", label_is_numeric=False, label_vocab=lv)
    data = enc.transform(mf)
    task = mdl.default_task_specs()["next_activity"]
    _, pred = mdl.fit_predict(data.where("split = 'train'"), data.where("split = 'val'"), task, "tree")
    return pred.select("case_id", "prefix_len", "y_true", "y_pred")


def q_feature_importance(spark, sf_dir):
    """MET-13: ranked importances of a random-forest remaining-time model (index_latest_payload encoding)."""
    from caseflow.operators.encoding import fit_encoder
    mf = model_frame(spark, sf_dir)
    enc = fit_encoder("index_latest_payload", mf.where("split = 'train'"))
    data = enc.transform(mf)
    task = mdl.default_task_specs()["remaining_time"]
    model, _ = mdl.fit_predict(data.where("split = 'train'"), data.where("split = 'val'"), task, "tree")
    imp = mdl.feature_importances(model, enc.feature_cols)
    return spark.createDataFrame([(n, float(v), i + 1) for i, (n, v) in enumerate(imp)],
                                 "feature string, importance double, rank int")


def q_tuned_model(spark, sf_dir):
    """MOD-5: a grid over penalties and forest depths, judged on held-out cases; the winner and its score."""
    from caseflow.operators.encoding import fit_encoder
    mf = model_frame(spark, sf_dir, activities=False)
    enc = fit_encoder("last_state", mf.where("split = 'train'"))
    data = enc.transform(mf.where("split = 'train'"))
    task = mdl.default_task_specs()["remaining_time"]
    _, score, kind, setting = mdl.tuned_model(data, task)
    return spark.createDataFrame([(task.name, kind, str(setting), float(score))],
                                 "task string, estimator string, setting string, val_mae double")


def q_strategy_search(spark, sf_dir):
    """EXP-1: bucketers x encoders with a linear probe on remaining time (rows-only)."""
    from caseflow.plans.strategy import strategy_search
    task = mdl.default_task_specs()["remaining_time"]
    return strategy_search(model_frame(spark, sf_dir), task, ["no_bucket", "prefix_len_bins"],
                           ["last_state", "aggregation"], kind="linear", min_bucket_samples=300).drop("metrics")


def q_strategy_search_per_bucket(spark, sf_dir):
    """EXP-4 / MOD-6: per-bucket models for eligible adaptive buckets (rows-only)."""
    from caseflow.plans.strategy import strategy_search
    task = mdl.default_task_specs()["remaining_time"]
    return strategy_search(model_frame(spark, sf_dir), task, ["prefix_len_adaptive"], ["last_state"],
                           kind="linear", min_bucket_samples=300).drop("metrics")


def q_strategy_grid(spark, sf_dir):
    """EXP-1: all five bucketers x four encoders, every strategy fitted with one-pass linear models of log1p remaining time (rows-only)."""
    from caseflow.operators.encoding import ENCODERS
    from caseflow.plans.strategy import strategy_search
    task = mdl.default_task_specs()["remaining_time"]
    bucketers = ["no_bucket", "prefix_len_bins", "prefix_len_adaptive", "last_activity", "cluster"]
    return strategy_search(model_frame(spark, sf_dir), task, bucketers, ENCODERS, kind="ridge", min_bucket_samples=300,
                           target_log1p=True).drop("metrics")


def q_strategy_lookup(spark, sf_dir):
    """EXP-1 / EXP-4 / MET-5: the search with a learner that is a lookup table, one for each eligible bucket."""
    from caseflow.plans.strategy import lookup_strategies
    task = mdl.default_task_specs()["remaining_time"]
    out = lookup_strategies(model_frame(spark, sf_dir), task, ["no_bucket", "prefix_len_bins", "prefix_len_adaptive"], 300)
    return _r(out, {"primary_score": 6})


def q_batch_scoring(spark, sf_dir):
    """INF-2..4: fit on train prefixes, score every customer case at its latest event (rows-only)."""
    from caseflow.operators.bucketing import PrefixLenBins
    from caseflow.operators.encoding import fit_encoder
    from caseflow.plans.scoring import score_running_cases
    from caseflow.plans.strategy import eligible_buckets
    mf = model_frame(spark, sf_dir)
    tr = mf.where("split = 'train'")
    bk = PrefixLenBins(bin_size=10).fit(tr)
    enc = fit_encoder("last_state", tr)
    bucketed = bk.assign(mf)
    task = mdl.default_task_specs()["remaining_time"]
    models, _ = mdl.train_per_bucket(enc.transform(bucketed), eligible_buckets(bucketed, task, 300), task, "linear",
                                     target_log1p=True)
    return score_running_cases(customer_case_log(spark, sf_dir), bk, enc, models, task, target_log1p=True)


def _state_columns(df):
    """A running case's state as plain columns."""
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("activity_counts")),
                                      lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ">")
    return df.select("case_id", "prefix_len", "last_activity", counts.alias("activity_counts"),
                     F.concat_ws(">", "prefix_activities").alias("first_activities"), ntz("prefix_end_time").alias("prefix_end_time"),
                     round_half_up("feat_elapsed_time_sec", 3).alias("feat_elapsed_time_sec"),
                     round_half_up("feat_time_since_last_event_sec", 3).alias("feat_time_since_last_event_sec"),
                     *[c for c in df.columns if c in ("prop_k", "predicted_remaining_sec")])


def q_running_case_state(spark, sf_dir):
    """INF-1: state of each user's case at its latest event, of bounded size (counts, first 12 activities, last attribute)."""
    state = prefixes.running_case_state(testlogs.user_log(spark, sf_dir), positions=12)
    return _state_columns(state.withColumnRenamed("event_last__prop_k", "prop_k"))


def q_stream_scoring(spark, sf_dir):
    """STR-1: the events as a stream of several batches; state of each case kept across them, scored by the
    smoothed mean remaining time of its last activity (learned from the batch prefixes), written epoch by epoch."""
    from caseflow.functions.scalar import attach_scalars
    from caseflow.streaming.running_cases import STATE_STORE, latest_state, running_case_stream, score_stream
    log = testlogs.user_log(spark, sf_dir)
    means = materialize(mdl.mean_by_last_activity(prefixes.extract_prefixes(log, include_event_attributes=False)))
    source, out = _scratch(spark, "stream-source"), _scratch(spark, "stream-out")
    log.repartitionByRange(6, "timestamp", "_event_index").write.parquet(source)

    def score(cases):
        known = attach_scalars(cases.join(small_side(means.select(F.col("_la").alias("last_activity"), "_enc")), "last_activity", "left"),
                               means.agg(F.first("_gm").alias("_gm")))
        return known.withColumn("predicted_remaining_sec", F.coalesce("_enc", "_gm")).drop("_enc", "_gm")

    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = score_stream(running_case_stream(stream, 12, last_values=["prop_k"]), out, _scratch(spark, "stream-ckpt"), score)
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    finally:
        spark.conf.set(STATE_STORE[0], before) if before else spark.conf.unset(STATE_STORE[0])
    latest = latest_state(spark, out).withColumn("prop_k", F.col("attributes")["prop_k"].cast("bigint"))
    return _state_columns(latest.withColumn("predicted_remaining_sec", round_half_up("predicted_remaining_sec", 3)))


def q_bucket_regression(spark, sf_dir):
    """MOD-1 / MOD-4 / MOD-6: a linear model of remaining time for each adaptive bucket, all fitted in one pass
    (elapsed time and prefix length, no penalty); val predictions."""
    from pyspark.ml.feature import VectorAssembler

    from caseflow.operators.bucketing import PrefixLenAdaptive, bucketize
    from caseflow.operators.least_squares import fit_buckets, predict_buckets
    b, _ = bucketize(model_frame(spark, sf_dir), PrefixLenAdaptive())
    data = VectorAssembler(inputCols=["feat_elapsed_time_sec", "prefix_len"], outputCol="features").transform(b) \
        .withColumn("label", F.col("label_remaining_time_sec"))
    pred = predict_buckets(data.where("split = 'val'"), fit_buckets(data.where("split = 'train'"), alpha=0.0))
    return _r(pred.select("case_id", "prefix_len", "bucket_id", "model_bucket", "y_true", "y_pred"), {"y_true": 2, "y_pred": 0})


def q_budgeted_search(spark, sf_dir):
    """MOD-5 / UDF-5: successive halving over penalties and forest depths on growing samples of train cases; every trial."""
    from caseflow.operators.encoding import fit_encoder
    from caseflow.plans.budget import budgeted_search
    train = model_frame(spark, sf_dir).where("split = 'train'")
    data = fit_encoder("last_state", train).transform(train).select("case_id", "prefix_len", "features", "label")
    task = mdl.default_task_specs()["remaining_time"]
    return budgeted_search(data, task, max_fits=20, max_seconds=3600, target_log1p=True).trials.drop("seconds")


def q_staged_gains(spark, sf_dir):
    """EXP-10: gain of the best lookup strategy over no buckets, and of a search that also fits small buckets over it."""
    from caseflow.plans.strategy import lookup_strategies, staged_gains
    task, mf = mdl.default_task_specs()["remaining_time"], model_frame(spark, sf_dir)
    bucketers = ["no_bucket", "prefix_len_bins", "prefix_len_adaptive"]
    scores = lambda least: _r(lookup_strategies(mf, task, bucketers, least), {"primary_score": 6}).select(
        F.lit(task.name).alias("task"), F.lit(task.primary_metric).alias("primary_metric"), "bucketing",
        F.lit("last_state").alias("encoding"), "primary_score")
    searched = scores(50).groupBy("task").agg(F.min("primary_score").alias("search_score"))
    return _r(staged_gains(scores(300), searched), {"gain_strategy_pct": 4, "gain_search_pct": 4})


QUERIES.update({
    "staged_gains": q_staged_gains,
    "budgeted_search": q_budgeted_search,
    "running_case_state": q_running_case_state,
    "bucket_regression": q_bucket_regression,
})


QUERIES.update({
    "running_case_prefix_long": q_running_case_prefix_long,
    "ablation_row_counts": q_ablation_row_counts,
    "ablation_scores": q_ablation_scores,
    "csv_source": q_csv_source,
    "xes_source": q_xes_source,
    "linear_probe": q_linear_probe,
    "tree_probe": q_tree_probe,
    "feature_importance": q_feature_importance,
    "tuned_model": q_tuned_model,
    "strategy_search": q_strategy_search,
    "strategy_grid": q_strategy_grid,
    "strategy_lookup": q_strategy_lookup,
    "strategy_search_per_bucket": q_strategy_search_per_bucket,
    "batch_scoring": q_batch_scoring,
    "stream_scoring": q_stream_scoring,
})


# ---------------------------------------------------------------- remaining surfaces: detection, exemplars, sinks, scalars

def q_column_autodetect(spark, sf_dir):
    """PRJ-3: names guessed from the schema (substring and case-insensitive fallbacks), then renamed."""
    e = _events(spark, sf_dir)
    raw = e.select(F.col("user_id").alias("customer_trace_ref"), F.col("event_type").alias("EVENT_TYPE"),
                   F.col("ts").alias("Created_At"), "event_id", "value")
    m = schema.detect_columns(raw.columns, "csv")
    n = schema.normalize_schema(raw, mapping=m)
    return _out(n.withColumn("case_id", F.col("case_id").cast("string")), ["case_id", "activity", "timestamp", "event_id"])


def q_test_quantile_exemplars(spark, sf_dir):
    """SRT-5: distinct test rows nearest to the 7 label quantiles of the test split."""
    t = regression_predictions(spark, sf_dir).where(F.col("split") == "test")
    e = smp.quantile_exemplars(t, "y_true", (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
    return _r(e.select("case_id", "prefix_len", "y_true", "y_pred").distinct(), {"y_true": 2, "y_pred": 2})


def q_test_report(spark, sf_dir):
    """SNK-6: the test report written to the shared folder (metrics as JSON, examples as CSV); the examples read back."""
    from caseflow.sources.sinks import write_test_report
    test = regression_predictions(spark, sf_dir).where(F.col("split") == "test")
    path = _scratch(spark, "test-report")
    write_test_report(path, met.regression_errors(test), q_test_quantile_exemplars(spark, sf_dir),
                      met.regression_errors(test, group=["bucket_id"]))
    return spark.read.schema("case_id string, prefix_len int, y_true double, y_pred double") \
        .option("header", True).csv(f"{path}/examples")


def q_classification_exemplars(spark, sf_dir):
    """SRT-6: up to 10 wrong and the rest right predictions, in a seeded hash order."""
    return smp.classification_exemplars(classification_predictions(spark, sf_dir), 20) \
        .select("case_id", "prefix_len", "y_true", "y_pred")


def q_bucket_exemplars(spark, sf_dir):
    """SRT-7: per adaptive bucket, the prediction whose error is closest to the bucket's median error."""
    p = regression_predictions(spark, sf_dir).select("case_id", "prefix_len", "bucket_id", "y_true", "y_pred")
    e = smp.per_bucket_exemplar(p, "median")
    return _r(e.select("bucket_id", "case_id", "prefix_len", "y_true", "y_pred"), {"y_true": 2, "y_pred": 2})


def q_sample_prefixes(spark, sf_dir):
    """SRT-8: 10 % Bernoulli sample of the prefix frame, drawn by a seeded hash of the key."""
    return smp.sample_prefixes(model_frame(spark, sf_dir), 0.1, 42).select("case_id", "prefix_len", "split")


def q_qc_report_json(spark, sf_dir):
    """SNK-1: a QC report written as JSON to the shared folder and read back with its schema."""
    from caseflow.sources.sinks import write_report
    rep = q_trace_length_stats(spark, sf_dir)
    path = _scratch(spark, "qc-json")
    write_report(rep, path)
    return spark.read.schema(rep.schema).json(path)


def q_prefix_preview(spark, sf_dir):
    """SNK-2: first 100 prefix rows by key, the activity list as JSON text (the limit is the feature)."""
    from caseflow.sources.sinks import to_preview
    p = prefixes.extract_prefixes(clean_line_log(spark, sf_dir), include_event_attributes=False, add_time_features=False)
    pv = to_preview(p.select("case_id", "prefix_len", "prefix_activities", ntz("prefix_end_time").alias("prefix_end_time"),
                             "label_next_activity"), 100, ["case_id", "prefix_len"])
    return pv


def _texts_of_orders(spark, sf_dir):
    """Snapshot columns of four kinds: a date as text, a day and month first, many values, few values."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").cast("string").alias("case_id"), F.lit(1).alias("prefix_len"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_last__day"),
                    F.date_format("o_orderdate", "dd.MM.yyyy").alias("event_last__day_first"),
                    F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")).alias("case__customer"),
                    F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("event_last__priority"),
                    F.col("o_orderstatus").alias("event_last__status"))


TEXT_COLS = ["event_last__day", "event_last__day_first", "case__customer", "event_last__priority", "event_last__status"]


def q_date_like(spark, sf_dir):
    """SCL-11: which columns an embedding skips as dates or for their many values."""
    from caseflow.operators.encoding import column_facts
    return column_facts(_texts_of_orders(spark, sf_dir), TEXT_COLS)


def q_embedding_values(spark, sf_dir):
    """ENC-10: hashed 3-gram vectors of all values of all text columns."""
    from caseflow.operators.encoding import unpivot_categories, value_vectors
    values = unpivot_categories(_texts_of_orders(spark, sf_dir), TEXT_COLS).where("value is not null") \
        .select("column", "value").distinct()
    return value_vectors(values).withColumn("weight", round_half_up("weight", 6))


def q_encoder_vectors(spark, sf_dir):
    """ENC-5/6/7/13: the non-zero entries of three encoders' vectors, added up by feature and prefix length."""
    from caseflow.operators.encoding import fit_encoder
    from caseflow.operators.sparse import entries_long
    mf = model_frame(spark, sf_dir)
    out = None
    for name, options in (("last_state", {}), ("aggregation", {}),
                          ("index_latest_payload", {"categorical_encoding": "onehot", "activity_encoding": "onehot_per_position"})):
        enc = fit_encoder(name, mf.where("split = 'train'"), **options)
        part = entries_long(enc.transform(mf), enc.feature_cols, ["prefix_len"]).withColumn("encoding", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return (out.groupBy("encoding", "feature", "prefix_len")
            .agg(F.count(F.lit(1)).alias("n_entries"), round_half_up(F.sum("value"), 2).alias("total")))


def q_encoded_preview(spark, sf_dir):
    """SNK-4: top-5 non-zero features by |value| for the first 20 encoded rows."""
    from caseflow.operators.encoding import fit_encoder
    from caseflow.sources.sinks import encoded_preview
    mf = model_frame(spark, sf_dir)
    enc = fit_encoder("last_state", mf.where("split = 'train'"))
    preview = encoded_preview(enc.transform(mf).orderBy("case_id", "prefix_len"), enc.feature_cols, 5, 20)
    return preview.withColumn("value", round_half_up("value", 4))


def q_scalar_functions(spark, sf_dir):
    """SCL-1/2/5/13/14: log1p of clipped values, clamped expm1, days, relative gain, NaN -> null."""
    from caseflow.functions.scalar import expm1_clamped, json_safe, log1p_nonneg, relative_gain_pct, seconds_to_days
    e = _events(spark, sf_dir)
    v = F.col("value")
    nan_or_v = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(v)
    return e.select("event_id",
                    round_half_up(log1p_nonneg(v - 50.0), 6).alias("log1p_clip"),
                    round_half_up(expm1_clamped(v / 100.0 - 0.5), 6).alias("expm1_clamp"),
                    round_half_up(seconds_to_days(v * 1000.0), 6).alias("days"),
                    round_half_up(relative_gain_pct(v, F.lit(50.0), F.col("event_id") % 2 == 0), 6).alias("gain_pct"),
                    json_safe(nan_or_v).alias("json_value"))


def q_roc_auc(spark, sf_dir):
    """MET-2 (AUC): predicted remaining time as the score for 'remaining above the median'."""
    p = regression_predictions(spark, sf_dir)
    med = p.agg(F.percentile("y_true", F.lit(0.5)).alias("_m"))
    lab = attach_scalars(p, med).where("y_true is not null").select(
        (F.col("y_true") > F.col("_m")).cast("int").alias("label"), round_half_up("y_pred", 3).alias("score"))
    return _r(met.roc_auc(lab, "label", "score"), {"roc_auc": 9})


def q_strategy_report(spark, sf_dir):
    """SNK-5 / EXP-3 / EXP-10: flattened strategy table, best per task, % gain over the baseline."""
    from caseflow.plans.strategy import best_per_task, gain_pivot, strategy_search
    from caseflow.session import materialize
    from caseflow.sources.sinks import flatten_strategy_report
    task = mdl.default_task_specs()["remaining_time"]
    res = materialize(strategy_search(model_frame(spark, sf_dir), task, ["no_bucket", "prefix_len_adaptive"],
                                      ["last_state", "index_latest_payload"], kind="linear"))
    flat = flatten_strategy_report(res)
    best = best_per_task(res).select("task", F.col("bucketing").alias("best_bucketing"),
                                     F.col("encoding").alias("best_encoding"))
    gains = gain_pivot(res)
    return flat.join(best, "task").join(gains, ["task", "bucketing"])


QUERIES.update({
    "column_autodetect": q_column_autodetect,
    "test_quantile_exemplars": q_test_quantile_exemplars,
    "test_report": q_test_report,
    "classification_exemplars": q_classification_exemplars,
    "bucket_exemplars": q_bucket_exemplars,
    "sample_prefixes": q_sample_prefixes,
    "qc_report_json": q_qc_report_json,
    "prefix_preview": q_prefix_preview,
    "date_like": q_date_like,
    "embedding_values": q_embedding_values,
    "encoder_vectors": q_encoder_vectors,
    "encoded_preview": q_encoded_preview,
    "scalar_functions": q_scalar_functions,
    "roc_auc": q_roc_auc,
    "strategy_report": q_strategy_report,
})


def q_train_remaining_time(spark, sf_dir):
    """§3.1 end to end on the customer log: clean, label, prefix, split, IQR filter, strategy search,
    final model on train+val, test MAE (rows-only)."""
    from caseflow.plans.training import RunConfig, train_task
    out = train_task(customer_case_log(spark, sf_dir), RunConfig(task="remaining_time", min_bucket_samples=300))
    b = out["best"]
    return out["test_metrics"].select(F.lit(b["bucketing"]).alias("bucketing"), F.lit(b["encoding"]).alias("encoding"),
                                      "mae_days", "medae_days", "n")


def q_train_next_activity(spark, sf_dir):
    """§3.1 for next activity on the user-day log with a rare-class filter (rows-only)."""
    from caseflow.plans.training import RunConfig, train_task
    cfg = RunConfig(task="next_activity", min_class_samples=10, bucketers=["no_bucket"], encodings=["aggregation"],
                    kind="tree")
    out = train_task(testlogs.user_day_log(spark, sf_dir), cfg)
    return out["test_metrics"]


QUERIES.update({
    "train_remaining_time": q_train_remaining_time,
    "train_next_activity": q_train_next_activity,
})


def task_frame(spark, sf_dir):
    """The modelling frame with an outcome (does the customer's last order have a high priority)."""
    from caseflow.operators.splits import attach_split, split_cases
    log = customer_case_log(spark, sf_dir)
    cases = labels.case_table(log, outcome_col="o_orderpriority", outcome_values="1-URGENT,2-HIGH")
    return materialize(attach_split(prefixes.extract_prefixes(log, cases), split_cases(log)))


def q_compare_tasks(spark, sf_dir):
    """EXP-2: three tasks x five bucketers x four encoders, each with one-pass linear models (rows-only)."""
    from caseflow.operators.encoding import ENCODERS
    from caseflow.plans.strategy import compare_tasks
    specs = mdl.default_task_specs()
    return compare_tasks(task_frame(spark, sf_dir), [specs[t] for t in ("next_activity", "remaining_time", "outcome")],
                         ["no_bucket", "prefix_len_bins", "prefix_len_adaptive", "last_activity", "cluster"], ENCODERS,
                         min_bucket_samples=300).drop("metrics")


def q_encoder_per_bucket(spark, sf_dir):
    """EXP-6: per adaptive bucket, the encoder whose own model of the bucket has the lowest val MAE (rows-only)."""
    from caseflow.operators.encoding import ENCODERS
    from caseflow.plans.strategy import encoder_choice_per_bucket
    task = mdl.default_task_specs()["remaining_time"]
    return encoder_choice_per_bucket(model_frame(spark, sf_dir), task, "prefix_len_adaptive", ENCODERS, 300, target_log1p=True)


def q_resumable_results(spark, sf_dir):
    """EXP-9 / EXP-11: per-(log, task) results appended to a table twice; keyed rows are not repeated."""
    from caseflow.sources.sinks import append_results
    path = _scratch(spark, "results")
    e = met.regression_errors(regression_predictions(spark, sf_dir))
    rows = e.select(F.lit("customer_log").alias("log"), F.lit("remaining_time").alias("task"),
                    round_half_up("mae_days", 6).alias("mae_days"), "n")
    append_results(rows, path, ["log", "task"])
    append_results(rows, path, ["log", "task"])  # resume: nothing new
    return spark.read.parquet(path)


def q_bundle_roundtrip(spark, sf_dir):
    """SNK-7 / SRC-7: a per-bucket model bundle saved to the shared folder; running cases scored from it alone."""
    from caseflow.operators.bucketing import PrefixLenBins
    from caseflow.operators.encoding import fit_encoder
    from caseflow.plans.scoring import score_with_bundle
    from caseflow.plans.strategy import eligible_buckets
    from caseflow.sources.sinks import save_bundle
    mf = model_frame(spark, sf_dir)
    tr = mf.where("split = 'train'")
    bk = PrefixLenBins(bin_size=15).fit(tr)
    enc = fit_encoder("index_latest_payload", tr)
    task = mdl.default_task_specs()["remaining_time"]
    bucketed = bk.assign(mf)
    models, _ = mdl.train_per_bucket(enc.transform(bucketed), eligible_buckets(bucketed, task, 300), task, "linear",
                                     target_log1p=True)
    path = _scratch(spark, "bundle")
    save_bundle(path, models, {"task": task.name, "bucketing": bk.name, "encoding": enc.name, "target_log1p": True},
                enc, bk)
    return score_with_bundle(customer_case_log(spark, sf_dir), path)


def q_log1p_target_probe(spark, sf_dir):
    """MOD-7: linear probe on the log1p target, predictions back-transformed with expm1 and clamped (rows-only)."""
    from caseflow.operators.encoding import fit_encoder
    mf = model_frame(spark, sf_dir)
    enc = fit_encoder("last_state", mf.where("split = 'train'"))
    data = enc.transform(mf)
    task = mdl.default_task_specs()["remaining_time"]
    _, pred = mdl.fit_predict(data.where("split = 'train'"), data.where("split = 'val'"), task, "linear",
                              target_log1p=True)
    return pred.select("case_id", "prefix_len", "y_true", "y_pred")


QUERIES.update({
    "compare_tasks": q_compare_tasks,
    "encoder_per_bucket": q_encoder_per_bucket,
    "resumable_results": q_resumable_results,
    "bundle_roundtrip": q_bundle_roundtrip,
    "log1p_target_probe": q_log1p_target_probe,
})


def q_parquet_source(spark, sf_dir):
    """SRC-4 + PRJ-1: the events file read as a parquet log with custom candidate names."""
    from caseflow.sources.readers import read_parquet_log
    raw = read_parquet_log(spark, f"{sf_dir}/events.parquet")
    n = schema.clean_events(schema.normalize_schema(raw, case_candidates=["user_id"], act_candidates=["event_type"],
                                                    ts_candidates=["ts"]))
    return n.select("case_id", "activity", ntz("timestamp").alias("timestamp"), "event_id", "value")


def q_schema_qc(spark, sf_dir):
    """PRJ-2: chosen columns, semantic columns present, rows and unparsable times of a raw log."""
    e = _events(spark, sf_dir)
    raw = e.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("Activity"),
                   F.when(F.col("event_id") % 10 == 0, F.lit("not a time")).otherwise(F.col("ts").cast("string"))
                   .alias("time"), F.col("event_id").cast("string").alias("EventID"))
    return schema.schema_qc(raw)


def q_aggregated_qc(spark, sf_dir):
    """AGG-24: events generated from the aggregated table and events per case."""
    from caseflow.plans.profile import step_counts
    from caseflow.sources.aggregated import aggregated_to_events
    s = step_counts(aggregated_to_events(wide_case_table(spark, sf_dir)))
    return s.select("n_events", "n_cases", round_half_up("avg_events_per_case", 6).alias("avg_events_per_case"))


def q_embedding_pca(spark, sf_dir):
    """ENC-10 / ENC-11: embedding encoder with the 64-dim table vectors compressed to 8 dims by PCA (rows-only)."""
    from caseflow.operators.encoding import activity_vectors, activity_vocab, fit_encoder
    mf = model_frame(spark, sf_dir)
    tr = mf.where("split = 'train'")
    vec = activity_vectors(activity_vocab(tr), spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    enc = fit_encoder("embedding", tr, vectors=vec, compress_dim=8)
    from pyspark.ml.functions import vector_to_array
    return enc.transform(mf).select("case_id", "prefix_len", F.size(vector_to_array("features")).alias("feature_dim"))


QUERIES.update({
    "parquet_source": q_parquet_source,
    "schema_qc": q_schema_qc,
    "aggregated_qc": q_aggregated_qc,
    "embedding_pca": q_embedding_pca,
})


def q_case_quantile_exemplars(spark, sf_dir):
    """SRT-4 (reference semantics): one row per case, greedy nearest to the .5 / .9 / .99 label quantiles."""
    v = model_frame(spark, sf_dir).where(F.col("split") == "val")
    e = smp.case_quantile_exemplars(v, "label_remaining_time_sec", 3)
    return _r(e.select("_pick", "case_id", "prefix_len", "label_remaining_time_sec").withColumnRenamed("_pick", "pick"),
              {"label_remaining_time_sec": 2})


def q_case_exemplars_fill(spark, sf_dir):
    """SRT-4 with random fill to 8 examples (in a seeded hash order)."""
    v = model_frame(spark, sf_dir).where(F.col("split") == "val")
    return smp.case_quantile_exemplars(v, "label_remaining_time_sec", 8).select(F.col("_pick").alias("pick"), "case_id", "prefix_len")


QUERIES.update({
    "case_quantile_exemplars": q_case_quantile_exemplars,
    "case_exemplars_fill": q_case_exemplars_fill,
})


def q_test_exemplars_fill(spark, sf_dir):
    """SRT-5: rows nearest to the label quantiles of the test split, filled up to 20 in a seeded hash order."""
    t = regression_predictions(spark, sf_dir).where(F.col("split") == "test")
    e = smp.filled_quantile_exemplars(t.select("case_id", "prefix_len", "y_true", "y_pred"), "y_true", 20)
    return _r(e, {"y_true": 2, "y_pred": 2})


QUERIES["test_exemplars_fill"] = q_test_exemplars_fill
