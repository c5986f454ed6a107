"""Scoring of running cases (INF-1..4, JON-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators.least_squares import predict_buckets
from caseflow.operators.models import predict_routed
from caseflow.operators.prefixes import running_case_prefixes, running_case_state


def nearest_model(buckets: DataFrame, models: DataFrame, bucket_col: str = "bucket_id",
                  model_col: str = "model_bucket") -> DataFrame:
    """JON-8: for each bucket, the model bucket with the smallest |id difference| (ties: smaller id).

    An as-of style scan, not a product: bucket and model ids are unioned and
    sorted; each bucket takes the nearest model at or below and at or above it.
    Both inputs are bounded by the bucket count, so the unpartitioned window
    runs over a tiny table.
    """
    b = buckets.select(F.col(bucket_col).cast("long").alias("_id"), F.lit(None).cast("long").alias("_m"))
    m = models.select(F.col(model_col).cast("long").alias("_id"), F.col(model_col).cast("long").alias("_m"))
    w = Window.orderBy("_id", F.desc_nulls_last("_m"))
    u = b.unionByName(m).withColumns({
        "_below": F.last("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_above": F.first("_m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    }).where(F.col("_m").isNull())
    below_d, above_d = F.col("_id") - F.col("_below"), F.col("_above") - F.col("_id")
    pick = (F.when(F.col("_below").isNull(), F.col("_above")).when(F.col("_above").isNull(), F.col("_below"))
            .when(below_d <= above_d, F.col("_below")).otherwise(F.col("_above")))
    return u.select(F.col("_id").cast("int").alias(bucket_col), pick.cast("int").alias(model_col)).distinct()


def score_running_cases(events: DataFrame, bucketer, encoder, models: dict, task, target_log1p: bool = False,
                        label_vocab: list[str] | None = None) -> DataFrame:
    """INF-2 / INF-3 / INF-4: all open cases at once -> one prediction per case.

    events -> state per case, of bounded size -> bucket -> encode -> model of the bucket
    (nearest fallback) -> back-transform.  ``models`` is a table of one-pass
    models (``least_squares.fit_buckets``; all rows in one pass) or a dict of Spark ML models by
    bucket (one lazy plan for each, unioned).  Durations come in seconds and days; classes by name, with
    ``probability`` where the models have one.  (The cluster bucketer was fitted on lists of
    activities and still gets the whole list of each case.)
    """
    cls = task.task_type == "classification"
    pre = (running_case_prefixes(events).withColumn("last_activity", F.element_at("prefix_activities", -1))
           if bucketer.name == "cluster" else running_case_state(events, encoder.state.get("max_len") or 1))
    enc = encoder.transform(bucketer.assign(pre)).withColumn("label", F.lit(None).cast("double"))
    if isinstance(models, DataFrame):
        out = predict_buckets(enc, models, len(label_vocab or []) if cls else 0, target_log1p)
    else:
        out = predict_routed(enc, models, task, target_log1p)
    more = [F.array_max("probabilities").alias("probability")] if "probabilities" in out.columns else []
    more += [] if cls else [(F.col("y_pred") / 86400.0).alias("prediction_days")]
    res = out.select("case_id", F.col("prefix_len").alias("num_events"), "last_activity", "bucket_id", "model_bucket",
                     F.col("y_pred").alias("prediction"), *more)
    if cls and label_vocab is not None:
        names = F.array(*[F.lit(v) for v in label_vocab])
        res = res.withColumn("prediction", F.coalesce(F.get(names, F.col("prediction").cast("int") - 1), F.lit("__UNK__")))
    return res


def score_with_bundle(events: DataFrame, path: str) -> DataFrame:
    """INF-2: running cases scored by a saved bundle alone."""
    from caseflow.operators.models import default_task_specs
    from caseflow.sources.sinks import load_bundle
    b = load_bundle(path)
    task = default_task_specs()[b["meta"]["task"]]
    return score_running_cases(events, b["bucketer"], b["encoder"], b["models"], task, b["meta"]["target_log1p"],
                               b["meta"]["label_vocab"])


def score_uploaded_log(raw: DataFrame, path: str, fmt: str = "csv") -> DataFrame:
    """INF-4: a raw log with columns of any usual name, scored case by case with a saved bundle.

    One row for each case: num_events, last_activity, bucket_id, prediction, ``error``.  A case with a
    time that cannot be read, or without an activity, has an error and no prediction.
    """
    from caseflow.operators.schema import ACT, CASE, TS, detect_columns, normalize_schema
    found = detect_columns(raw.columns, fmt)
    if None in found.values():
        raise ValueError(f"cannot detect the columns {[k for k, v in found.items() if v is None]}; found {raw.columns}")
    log = normalize_schema(raw, mapping=found).withColumn(CASE, F.col(CASE).cast("string"))
    if "_event_index" not in log.columns:
        log = log.withColumn("_event_index", F.monotonically_increasing_id())
    log = log.where(F.col(CASE).isNotNull())
    state = log.groupBy(CASE).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.count_if(F.col(TS).isNull()) > 0, "a timestamp cannot be read")
        .when(F.count_if(F.col(ACT).isNull()) > 0, "an activity is missing").alias("error"))
    scored = score_with_bundle(log, path).drop("num_events")
    return (state.join(scored, CASE, "left")
            .select(CASE, F.col("n").alias("num_events"), "last_activity", "bucket_id",
                    F.when(F.col("error").isNull(), F.col("prediction")).alias("prediction"), "error"))
