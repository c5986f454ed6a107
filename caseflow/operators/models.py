"""Models: lookup baselines (SQL-reproducible) and Spark ML probes (MOD-1..7, MET-13).

Learners are Spark ML estimators; data stays a DataFrame with a ``features``
vector (see ``encoding.fit_encoder``).  Per-bucket training loops over eligible
buckets only; the bucket count is bounded by the bucketer (≤ edges / activity
alphabet / k), never by the data.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.scalar import expm1_clamped, log1p_nonneg, small_side
from caseflow.operators.schema import CASE
from caseflow.functions.scalar import attach_scalars

KEY = [CASE, "prefix_len"]


# ---------------------------------------------------------------- lookup baselines

def last_activity_col(prefix_col: str = "prefix_activities"):
    return F.element_at(prefix_col, -1)


def mean_by_last_activity(train: DataFrame, label_col: str = "label_remaining_time_sec", smoothing: float = 1.0) -> DataFrame:
    """Regression baseline fit: smoothed train mean of the label per last activity (ENC-8 on it)."""
    y = F.col(label_col).try_cast("double")
    t = train.where(y.isNotNull()).select(last_activity_col().alias("_la"), y.alias("_y"))
    g = t.agg(F.avg("_y").alias("_gm"))
    per = t.groupBy("_la").agg(F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("_m"))
    return attach_scalars(per, g).select(
        "_la", ((F.col("_n") * F.col("_m") + F.lit(smoothing) * F.col("_gm")) / (F.col("_n") + F.lit(smoothing))).alias("_enc"),
        "_gm")


def predict_mean_by_last_activity(df: DataFrame, fitted: DataFrame, label_col: str = "label_remaining_time_sec") -> DataFrame:
    gm = fitted.agg(F.first("_gm").alias("_g"))
    j = attach_scalars(df.withColumn("_la", last_activity_col())
                       .join(small_side(fitted.select("_la", "_enc")), "_la", "left"), gm)
    return j.withColumn("y_true", F.col(label_col).try_cast("double")) \
        .withColumn("y_pred", F.coalesce(F.col("_enc"), F.col("_g"))).drop("_la", "_enc", "_g")


def majority_next_by_last_activity(train: DataFrame, label_col: str = "label_next_activity") -> DataFrame:
    """Classification baseline fit: most frequent label per last activity (ties by name) + global."""
    c = train.groupBy(last_activity_col().alias("_la"), F.col(label_col).alias("_lab")).agg(F.count(F.lit(1)).alias("_c"))
    best = (c.withColumn("_r", F.row_number().over(Window.partitionBy("_la").orderBy(F.desc("_c"), F.asc("_lab"))))
            .where("_r = 1").select("_la", "_lab"))
    glob = (c.groupBy("_lab").agg(F.sum("_c").alias("_c")).orderBy(F.desc("_c"), F.asc("_lab")).limit(1)
            .select(F.col("_lab").alias("_glob")))
    return attach_scalars(best, glob)


def predict_majority(df: DataFrame, fitted: DataFrame, label_col: str = "label_next_activity") -> DataFrame:
    glob = fitted.agg(F.first("_glob").alias("_g"))
    j = attach_scalars(df.withColumn("_la", last_activity_col())
                       .join(small_side(fitted.select("_la", "_lab")), "_la", "left"), glob)
    return j.withColumn("y_true", F.col(label_col).cast("string")) \
        .withColumn("y_pred", F.coalesce(F.col("_lab"), F.col("_g"))).drop("_la", "_lab", "_g")


# ---------------------------------------------------------------- Spark ML probes

@dataclass(frozen=True)
class TaskSpec:
    """UDF-6: task name, kind and label column."""
    name: str
    task_type: str  # "classification" | "regression"
    label_col: str
    primary_metric: str = "f1_macro"

    @property
    def higher_is_better(self) -> bool:
        return self.primary_metric not in ("mae_days", "mae_sec", "medae_days")


def default_task_specs(outcome_col: str = "label_outcome") -> dict[str, TaskSpec]:
    # Names, label columns and metrics of the tasks.
    return {
        "next_activity": TaskSpec("next_activity", "classification", "label_next_activity", "f1_macro"),
        "remaining_time": TaskSpec("remaining_time", "regression", "label_remaining_time_sec", "mae_days"),
        "outcome": TaskSpec("outcome", "classification", outcome_col, "f1_macro"),
    }


def next_attribute_task(attr: str) -> TaskSpec:
    from caseflow.functions.scalar import safe_attr_name
    return TaskSpec(f"next_{safe_attr_name(attr)}", "classification", f"label_next_{safe_attr_name(attr)}", "f1_macro")


def balanced_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """MOD-3 as a weight column: N / (K * n_class) joined back (class table is tiny)."""
    c = train.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = c.agg(F.sum("_nc").alias("_N"), F.count(F.lit(1)).alias("_K"))
    w = attach_scalars(c, tot).select(label, (F.col("_N") / (F.col("_K") * F.col("_nc"))).alias("weight"))
    return train.join(small_side(w), label)


def make_estimator(kind: str, task: TaskSpec, n_classes: int = 2, seed: int = 42, penalty: float = 0.0):
    """MOD-1 (linear) / MOD-2 (tree: random forest; ``gbt``: boosted trees) on ``features``.

    ``penalty`` is Spark's ``regParam`` of the linear learners (see :func:`ridge_penalty`).
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier, GBTClassifier
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    if kind == "linear":
        scaler = StandardScaler(inputCol="features", outputCol="_scaled", withMean=False, withStd=True)
        if task.task_type == "classification":
            est = LogisticRegression(featuresCol="_scaled", labelCol="label", weightCol="weight", maxIter=100,
                                     regParam=penalty)
        else:
            est = LinearRegression(featuresCol="_scaled", labelCol="label", regParam=penalty, elasticNetParam=0.0)
        return Pipeline(stages=[scaler, est])
    if kind == "gbt":
        # boosted trees: closest to the reference's LightGBM probe, but Spark fits one tree per job
        if task.task_type == "classification" and n_classes <= 2:
            return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=100, maxDepth=5,
                                 stepSize=0.1, seed=seed)
        if task.task_type == "regression":
            return GBTRegressor(featuresCol="features", labelCol="label", maxIter=100, maxDepth=5, stepSize=0.1, seed=seed)
    # default tree probe: 100 trees grown level by level together (one pass per level, not per tree); each row's node is
    # kept, so that a pass does not walk down all trees again (the forests are the same)
    if task.task_type == "classification":
        return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=100,
                                      maxDepth=8, seed=seed, cacheNodeIds=True)
    return RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=100, maxDepth=8, seed=seed,
                                 cacheNodeIds=True)


def ridge_penalty(train: DataFrame, task: TaskSpec, alpha: float = 1.0) -> float:
    """``regParam`` that equals a penalty of ``alpha`` * |w|^2 on the summed loss.

    Spark divides the loss by the number of rows and a linear regression's label
    by its spread, so the penalty is alpha / n, times the label's spread for a regression.
    """
    r = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("spread")).first()
    return alpha / max(1, r["n"]) * (1.0 if task.task_type == "classification" else float(r["spread"] or 1.0))


def fit_predict(train: DataFrame, score: DataFrame, task: TaskSpec, kind: str = "tree", target_log1p: bool = False,
                seed: int = 42):
    """MOD-4 / MOD-7: fit on train, predict the scoring frame; returns (model, predictions).

    Predictions carry ``y_true`` / ``y_pred`` in label space (class id or seconds).
    """
    # trees read their rows some four times before they keep their own form of them: encoded once, without other columns
    kept = train.select("features", "label").persist(StorageLevel.DISK_ONLY) if kind != "linear" else None
    tr = train if kept is None else kept
    try:
        if task.task_type == "classification":
            tr = balanced_weights(tr)
            n_classes = tr.select("label").distinct().count() if kind == "gbt" else 0  # only boosted trees ask for it
        else:
            n_classes = 0
            if target_log1p:
                tr = tr.withColumn("label", log1p_nonneg("label", null_as_zero=False))
        est = make_estimator(kind, task, n_classes, seed, ridge_penalty(tr, task) if kind == "linear" else 0.0)
        model = est.fit(tr)
    finally:
        if kept is not None:
            kept.unpersist()
    return model, predict(model, score, task, target_log1p)


def predict(model, score: DataFrame, task: TaskSpec, target_log1p: bool = False) -> DataFrame:
    """Apply a fitted model: ``y_true`` / ``y_pred`` in label space, with the log undone and durations clamped at 0."""
    out = model.transform(score).withColumnRenamed("prediction", "y_pred").withColumn("y_true", F.col("label"))
    if task.task_type != "regression":
        return out
    return out.withColumn("y_pred", expm1_clamped("y_pred") if target_log1p else F.greatest("y_pred", F.lit(0.0)))


def predict_routed(data: DataFrame, models: dict, task: TaskSpec, target_log1p: bool = False,
                   bucket_col: str = "bucket_id") -> DataFrame:
    """Score every row with its bucket's model, or with that of the nearest bucket that has one (MET-12).

    The bucket ids with a model are known, so the way is an expression; the loop
    is over the models, at most one for each bucket.
    """
    ids = sorted(models)
    of = F.array(*[F.lit(int(i)) for i in ids])
    near = F.array_min(F.transform(of, lambda m: F.struct(F.abs(m - F.col(bucket_col)).alias("d"), m.alias("m"))))
    routed = data.withColumn("model_bucket", F.coalesce(near["m"], F.lit(int(ids[0]))))
    out = None
    for i in ids:
        part = predict(models[i], routed.where(F.col("model_bucket") == i), task, target_log1p)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def tuned_model(train: DataFrame, task: TaskSpec, grid: dict | None = None, folds: int = 5, seed: int = 42):
    """MOD-5 re-aimed: the best of a grid of learners, chosen on held-out cases (no AutoML service).

    ``grid`` maps a learner kind to a list of parameter settings (default: three
    penalties, two forest depths).  Rows of one case never lie on both sides: the
    fold is a hash of the case id.  Returns (model, score, kind, setting).
    """
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    cls = task.task_type == "classification"
    grid = grid or {"linear": [{"alpha": a} for a in (0.1, 1.0, 10.0)], "tree": [{"maxDepth": d} for d in (4, 8)]}
    fold = F.pmod(F.xxhash64("case_id", F.lit(seed)), F.lit(folds))
    # every fit and score reads them again: kept without the prefixes and attributes that no learner reads
    fit, held = (train.where(side).select("features", "label").persist() for side in (fold > 0, fold == 0))
    weighted = balanced_weights(fit) if cls else fit
    n_classes = fit.select("label").distinct().count() if cls and "gbt" in grid else 0
    ev = (MulticlassClassificationEvaluator(metricName="f1", labelCol="label") if cls
          else RegressionEvaluator(metricName="mae", labelCol="label"))
    tried = []
    for kind, settings in grid.items():
        for setting in settings:
            penalty = ridge_penalty(fit, task, setting.get("alpha", 1.0)) if kind == "linear" else 0.0
            est = make_estimator(kind, task, n_classes, seed, penalty)
            for name, value in setting.items():
                if name != "alpha":
                    est = est.copy({est.getParam(name): value})
            model = est.fit(weighted)
            tried.append((model, ev.evaluate(model.transform(held)), kind, setting))
    fit.unpersist()
    held.unpersist()
    return (max if cls else min)(tried, key=lambda t: t[1])


def feature_importances(model, feature_names: list[str]) -> list[tuple[str, float]]:
    """MET-13: tree importances or |coefficients|, ranked (a small driver-side list)."""
    m = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(m, "featureImportances"):
        vals = list(m.featureImportances.toArray())
    elif hasattr(m, "coefficients"):
        vals = [abs(x) for x in m.coefficients.toArray()]
    elif hasattr(m, "coefficientMatrix"):
        arr = m.coefficientMatrix.toArray()
        vals = [float(sum(abs(r[j]) for r in arr)) for j in range(arr.shape[1])]
    else:
        return []
    tot = sum(vals) or 1.0
    return sorted(((n, v / tot) for n, v in zip(feature_names, vals)), key=lambda x: -x[1])


def train_per_bucket(encoded: DataFrame, eligible: list[int], task: TaskSpec, kind: str = "tree",
                     bucket_col: str = "bucket_id", split_col: str = "split", seed: int = 42,
                     target_log1p: bool = False):
    """MOD-6: one model per eligible bucket, each fitted on that bucket's train rows.

    Without an eligible bucket one model is fitted on all train rows, under id 0.
    ``encoded`` should be cached by the caller: each bucket's fit scans it.
    Returns {bucket_id: model} and the union of val predictions.
    """
    models, preds = {}, None
    for b in eligible or [0]:
        part = encoded.where(F.col(bucket_col) == b) if eligible else encoded
        models[b], p = fit_predict(part.where(F.col(split_col) == "train"), part.where(F.col(split_col) == "val"), task,
                                   kind, seed=seed, target_log1p=target_log1p)
        preds = p if preds is None else preds.unionByName(p, allowMissingColumns=True)
    return models, preds


def timed(fn, *a, **kw):
    t0 = time.time()
    r = fn(*a, **kw)
    return r, time.time() - t0
