"""Strategy search over bucketers x encoders (EXP-1..6, EXP-10).

The driver loop runs over a fixed, small grid (≤ 5 bucketers x 4 encoders);
every step inside is a distributed Spark job.  Each encoder is fitted once on
train rows and reused across bucketers (encoders do not read ``bucket_id``).
"""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions.scalar import attach_scalars
from caseflow.operators import metrics as met
from caseflow.operators.bucketing import make_bucketer
from caseflow.operators.encoding import build_encoder, fit_encoder, label_vocabulary
from caseflow.operators.least_squares import Target, class_weights, fit_buckets, fit_targets, predict_buckets, predict_targets
from caseflow.operators.models import TaskSpec, fit_predict, train_per_bucket
from caseflow.operators.sampling import bucket_eligibility
from caseflow.session import materialize

STRATEGY_SCHEMA = T.StructType([
    T.StructField("task", T.StringType()), T.StructField("bucketing", T.StringType()),
    T.StructField("encoding", T.StringType()), T.StructField("mode", T.StringType()),
    T.StructField("primary_metric", T.StringType()), T.StructField("primary_score", T.DoubleType()),
    T.StructField("time_s", T.DoubleType()), T.StructField("feature_dim", T.IntegerType()),
    T.StructField("n_models", T.IntegerType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
])


#: Bytes of vectors that one partition of an encoded frame holds at most, as if all were dense.
PARTITION_BYTES = 64 << 20


def dealt(encode, rows: DataFrame, feature_dim: int) -> DataFrame:
    """``encode(rows)`` in partitions of bounded size: a file split of narrow rows is many times as large once encoded."""
    n = -(-rows.count() * feature_dim * 8 // PARTITION_BYTES)
    return encode(rows.repartition(n, "case_id", "prefix_len") if n > rows.rdd.getNumPartitions() else rows)


def settled(pred: DataFrame) -> DataFrame:
    """The columns that scores read, computed once: metrics pass over them several times, and a model is dear to apply."""
    return materialize(pred.select(*[c for c in ("bucket_id", "y_true", "y_pred") if c in pred.columns]))


def score_predictions(pred: DataFrame, task: TaskSpec) -> dict:
    """Val metrics of one strategy as a small dict (one aggregate job)."""
    if task.task_type == "classification":
        p = pred.select(F.col("y_true").cast("string").alias("y_true"), F.col("y_pred").cast("string").alias("y_pred"))
        r = met.f1_scores(p).first()
        return {"f1_macro": float(r["f1_macro"] or 0.0), "f1_micro": float(r["f1_micro"] or 0.0),
                "accuracy": float(r["accuracy"] or 0.0)}
    r = met.regression_errors(pred).first()
    return {"mae_days": float(r["mae_days"] or 0.0), "medae_days": float(r["medae_days"] or 0.0),
            "mae_sec": float(r["mae_sec"] or 0.0)}


def primary_score(pred: DataFrame, task: TaskSpec) -> float:
    """The task's primary metric alone: a mean error needs neither the medians beside it nor a copy of the predictions."""
    if task.primary_metric in ("mae_days", "mae_sec"):
        return float(pred.agg(_mean_errors()[task.primary_metric]).first()[0] or 0.0)
    return score_predictions(settled(pred), task)[task.primary_metric]


def _mean_errors() -> dict:
    error = F.avg(F.abs(F.col("y_pred").cast("double") - F.col("y_true").cast("double")))
    return {"mae_sec": error, "mae_days": error / 86400.0}


def mode_of(bucketing: str) -> str:
    """One model over all rows without buckets, else one model for each eligible bucket."""
    return "global" if bucketing == "no_bucket" else "per_bucket"


def per_bucket_scores(pred: DataFrame, task: TaskSpec) -> DataFrame:
    """(bucket_id, score, n) of val predictions by the task's primary metric."""
    if task.task_type == "classification":
        scores = met.per_bucket_classification(pred)
    elif task.primary_metric in ("mae_days", "mae_sec"):
        # means need no order: the medians beside them would sort all values
        error = F.avg(F.abs(F.col("y_pred").cast("double") - F.col("y_true").cast("double")))
        scores = pred.groupBy("bucket_id").agg(error.alias("mae_sec"), F.count(F.lit(1)).alias("n")) \
            .withColumn("mae_days", F.col("mae_sec") / 86400.0)
    else:
        scores = met.regression_errors(pred, group=["bucket_id"])
    return scores.select("bucket_id", F.col(task.primary_metric).alias("score"), "n")


def eligible_buckets(bucketed: DataFrame, task: TaskSpec, min_samples: int, skip_single_class: bool = True) -> list[int]:
    """Buckets with enough train and val rows (and two train classes); at most one id for each bucket."""
    el = bucket_eligibility(bucketed, min_samples, task.task_type == "classification" and skip_single_class,
                            task.label_col)
    return [r[0] for r in el.where("eligible").select("bucket_id").orderBy("bucket_id").collect()]


def strategy_search(frame: DataFrame, task: TaskSpec, bucketers: list[str], encodings: list[str],
                    kind: str = "linear", min_bucket_samples: int = 1000, skip_single_class: bool = True,
                    seed: int = 42, target_log1p: bool = False) -> DataFrame:
    """EXP-1 / EXP-4 / EXP-5: one result row for each (bucketer, encoder) that was fitted.

    Without buckets one model is fitted and scored on all val rows; any other
    bucketer gets one model for each eligible bucket, and its score is the mean
    of the buckets' scores weighted by their val rows.  A bucketer without an
    eligible bucket is not fitted and has no row.

    ``frame`` holds prefixes with a ``split`` column.  Returns a DataFrame with a
    ``rank`` column (1 = best; ties keep grid order, i.e. a strictly better
    score is needed to win).
    """
    if kind == "ridge":
        return ridge_search(frame, [task], bucketers, encodings, min_bucket_samples, skip_single_class, target_log1p)
    train = frame.where(F.col("split") == "train")
    cls = task.task_type == "classification"
    lv = label_vocabulary(train, task.label_col) if cls else None
    encoders = {e: fit_encoder(e, train, label_col=task.label_col, label_is_numeric=not cls, label_vocab=lv)
                for e in encodings}
    bucketed = bucketed_by_all(frame, train, bucketers)
    ids = eligible_of_all(bucketed, task, bucketers, min_bucket_samples, skip_single_class)
    rows = []
    for ename in encodings:
        encoded = dealt(encoders[ename].transform, bucketed, encoders[ename].feature_dim).select(
            "case_id", "prefix_len", "split", "features", "label", *[f"_bucket_{b}" for b in bucketers]).persist()
        for bname in bucketers:
            mode, t0 = mode_of(bname), time.time()
            if mode == "per_bucket" and not ids[bname]:
                continue
            order = bucketers.index(bname) * len(encodings) + encodings.index(ename)
            data = encoded.withColumn("bucket_id", F.col(f"_bucket_{bname}"))
            if mode == "per_bucket":
                _, pred = train_per_bucket(data, ids[bname], task, kind, seed=seed, target_log1p=target_log1p)
            else:
                _, pred = fit_predict(data.where("split = 'train'"), data.where("split = 'val'"), task, kind,
                                      seed=seed, target_log1p=target_log1p)
            pred = settled(pred)
            m = score_predictions(pred, task)
            if mode == "per_bucket":
                m[task.primary_metric] = float(met.weighted_score(per_bucket_scores(pred, task), "score").first()[0] or 0.0)
            rows.append((order, task.name, bname, ename, mode, task.primary_metric, m[task.primary_metric],
                         time.time() - t0, encoders[ename].feature_dim, max(1, len(ids[bname])), m))
        encoded.unpersist()
    return ranked(frame.sparkSession, rows, task)


def bucketed_by_all(frame: DataFrame, train: DataFrame, bucketers: list[str]) -> DataFrame:
    """The train and val rows with every bucketer's ids beside each other, so that a frame is encoded once for each encoder."""
    out = frame
    for bname in bucketers:
        out = make_bucketer(bname).fit(train).assign(out, f"_bucket_{bname}")
    return materialize(out.where(F.col("split").isin("train", "val")))


def eligible_of_all(bucketed: DataFrame, task: TaskSpec, bucketers: list[str], min_samples: int,
                    skip_single_class: bool) -> dict[str, list[int]]:
    """The eligible buckets of each bucketer that makes a model for each of them."""
    of = lambda b: bucketed.withColumn("bucket_id", F.col(f"_bucket_{b}"))
    return {b: eligible_buckets(of(b), task, min_samples, skip_single_class) if mode_of(b) == "per_bucket" else []
            for b in bucketers}


def ranked(spark, rows: list[tuple], task: TaskSpec) -> DataFrame:
    """The strategies of one task with their ``rank``; each row begins with its place in the grid."""
    schema = T.StructType([T.StructField("_order", T.IntegerType())] + STRATEGY_SCHEMA.fields)
    res = spark.createDataFrame(rows, schema)
    direction = F.desc_nulls_last("primary_score") if task.higher_is_better else F.asc_nulls_last("primary_score")
    # strategy table: ≤ 20 rows, so an unpartitioned window is fine here
    return res.withColumn("rank", F.row_number().over(Window.orderBy(direction, "_order"))).drop("_order")


def ridge_predictions(data: DataFrame, ids: list[int], n_classes: int, target_log1p: bool) -> tuple[DataFrame, DataFrame]:
    """Models of the buckets ``ids`` (none: one of all rows, under id 0), fitted in one pass, and their val predictions."""
    own = F.col("bucket_id").isin(*ids) if ids else F.lit(True)
    data = data.where(own) if ids else data.withColumn("bucket_id", F.lit(0))
    models = fit_buckets(data.where("split = 'train'"), n_classes, target_log1p=target_log1p)
    return models, predict_buckets(data.where("split = 'val'"), models, n_classes, target_log1p)


#: Room for the bucket ids of one bucketer among those of all.
ROOM = 1 << 20


def bucket_places(ids: dict[str, list[int]]):
    """The buckets in which a row counts, over all bucketers (an array): those of the k-th lie from k * ROOM."""
    place = lambda k, b: F.when(F.col(f"_bucket_{b}").isin(*ids[b]), F.col(f"_bucket_{b}") + k * ROOM)
    return F.array_compact(F.array(*[place(k, b) if mode_of(b) == "per_bucket" else F.lit(k * ROOM) for k, b in enumerate(ids)
                                     if mode_of(b) == "global" or ids[b]]))


def ridge_grid(encoded: DataFrame, ids: dict[str, list[int]], task: TaskSpec, n_classes: int,
               target_log1p: bool) -> dict[str, float]:
    """Val scores of all bucketers on one encoded frame, the models of all their buckets fitted in one pass."""
    data = encoded.select("split", "features", "label", bucket_places(ids).alias("places"))
    return ridge_grids(data, [(task, ids, Target("label", "places", n_classes, target_log1p))])[0]


def ridge_grids(data: DataFrame, searches: list[tuple[TaskSpec, dict[str, list[int]], Target]], centre: list[float] | None = None,
                weights: dict | None = None) -> list[dict[str, float]]:
    """Val scores of all bucketers for each task (with its eligible buckets and its columns), all models fitted in one pass.

    Each row counts once for each bucketer that has a model for its bucket; a
    bucketer's score is that of its buckets weighted by their val rows.
    """
    targets = [t for _, _, t in searches]
    models = fit_targets(data.where("split = 'train'"), targets, centre=centre, weights=weights)
    # every task's scores read the predictions: encoded and scored once, without the features
    pred = materialize(predict_targets(data.where("split = 'val'"), models, targets))
    out = []
    for i, (task, ids, _) in enumerate(searches):
        names, scores = list(ids), per_bucket_scores(pred.where(F.col("target") == i), task)
        total = scores.groupBy(F.floor(F.col("bucket_id") / ROOM).alias("k")).agg(
            (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("score")).collect()  # a row for each bucketer
        out.append({names[r["k"]]: float(r["score"] or 0.0) for r in total})
    return out


def ridge_search(frame: DataFrame, tasks: list[TaskSpec], bucketers: list[str], encodings: list[str],
                 min_bucket_samples: int = 1000, skip_single_class: bool = True, target_log1p: bool = False) -> DataFrame:
    """:func:`strategy_search` with one-pass linear models, for several tasks on one frame.

    Buckets and vocabularies do not depend on the task, nor do features but for
    target encodings: rows are put into buckets once, and encoded once for all
    tasks whose features are the same.  ``target_log1p`` is for the regressions.
    """
    train = frame.where(F.col("split") == "train")
    cls = [t.task_type == "classification" for t in tasks]
    lv = [label_vocabulary(train, t.label_col) if c else None for t, c in zip(tasks, cls)]
    bucketed = bucketed_by_all(frame, train, bucketers)
    ids = [eligible_of_all(bucketed, t, bucketers, min_bucket_samples, skip_single_class) for t in tasks]
    targets = [Target(f"_label_{i}", f"_places_{i}", len(v) if c else 0, target_log1p and not c) for i, (c, v) in enumerate(zip(cls, lv))]
    places = bucketed.withColumns({t.buckets: bucket_places(of) for t, of in zip(targets, ids)})
    rows, weights = [[] for _ in tasks], None
    for ename in encodings:
        groups: dict = {}
        for i in range(len(tasks)):
            groups.setdefault(i if ename == "index_latest_payload" and not cls[i] else "shared", []).append(i)
        for group in groups.values():
            first, t0 = group[0], time.time()
            encoder = fit_encoder(ename, train, label_col=tasks[first].label_col, label_is_numeric=not cls[first], label_vocab=lv[first])
            of_task = {i: build_encoder({**encoder.state, "label_col": tasks[i].label_col, "label_is_numeric": not cls[i],
                                         "label_vocab": lv[i]}, encoder.tables) for i in range(len(tasks))}
            labelled = places.withColumns({targets[i].label: e.label_expr for i, e in of_task.items()})
            if weights is None:  # labels and buckets are the same for every encoder
                weights = class_weights(labelled.where("split = 'train'"), targets)
            data = replace(encoder, label_expr=None).transform(labelled)
            at = {i: k for k, i in enumerate(group)}
            scores = ridge_grids(data, [(tasks[i], ids[i], targets[i]) for i in group], encoder.centre(train),
                                 {(at[t], b, y): w for (t, b, y), w in weights.items() if t in at})
            spent = (time.time() - t0) / max(1, sum(map(len, scores)))
            for i, of_bucketer in zip(group, scores):
                task = tasks[i]
                for bname in bucketers:
                    mode = mode_of(bname)
                    if mode == "per_bucket" and not ids[i][bname]:
                        continue
                    order, score = bucketers.index(bname) * len(encodings) + encodings.index(ename), of_bucketer[bname]
                    rows[i].append((order, task.name, bname, ename, mode, task.primary_metric, score, spent, encoder.feature_dim,
                                    max(1, len(ids[i][bname])), {task.primary_metric: score}))
    out = None
    for task, of_task in zip(tasks, rows):
        part = ranked(frame.sparkSession, of_task, task)
        out = part if out is None else out.unionByName(part)
    return out


def compare_tasks(frame: DataFrame, tasks: list[TaskSpec], bucketers: list[str], encodings: list[str],
                  kind: str = "ridge", min_bucket_samples: int = 1000) -> DataFrame:
    """EXP-2: the whole grid for every task, one long table with the best strategy of each task first."""
    if kind == "ridge":
        return ridge_search(frame, tasks, bucketers, encodings, min_bucket_samples, target_log1p=True)
    out = None
    for task in tasks:
        part = strategy_search(frame, task, bucketers, encodings, kind, min_bucket_samples,
                               target_log1p=task.task_type == "regression")
        out = part if out is None else out.unionByName(part)
    return out


def encoder_choice_per_bucket(frame: DataFrame, task: TaskSpec, bucketer: str, encodings: list[str],
                              min_bucket_samples: int = 1000, target_log1p: bool = False) -> DataFrame:
    """EXP-6: for each eligible bucket, the encoder whose own model of that bucket scores best on its val rows.

    Every (encoder, bucket) pair has a model, those of one encoder fitted in one
    pass.  Columns: bucket_id, encoding, score, n, ``weighted_score`` (of all buckets' choices).
    """
    train, cls = frame.where("split = 'train'"), task.task_type == "classification"
    lv = label_vocabulary(train, task.label_col) if cls else None
    bucketed = materialize(make_bucketer(bucketer).fit(train).assign(frame).where("split in ('train', 'val')"))
    ids = eligible_buckets(bucketed, task, min_bucket_samples)
    scores = None
    for e in encodings:
        encoder = fit_encoder(e, train, label_col=task.label_col, label_is_numeric=not cls, label_vocab=lv)
        # encoded once: the fit reads it twice and the scores once
        data = dealt(encoder.transform, bucketed, encoder.feature_dim).select("split", "features", "label", "bucket_id").persist()
        _, pred = ridge_predictions(data, ids, len(lv) if cls else 0, target_log1p)
        part = materialize(per_bucket_scores(pred, task).withColumn("encoding", F.lit(e)))
        data.unpersist()
        scores = part if scores is None else scores.unionByName(part)
    best = best_encoder_per_bucket(scores, task.higher_is_better)
    total = best.agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("weighted_score"))
    return attach_scalars(best, total)


def lookup_strategies(frame: DataFrame, task: TaskSpec, bucketers: list[str], min_bucket_samples: int = 1000) -> DataFrame:
    """The search with a learner that needs no fitting by iteration: the smoothed train mean of the label
    for each last activity, one table for each eligible bucket (regression tasks).

    One row for each bucketer with an eligible bucket: bucketing, mode, n_models, primary_score, n_val.
    """
    from caseflow.operators.models import last_activity_col
    train = frame.where(F.col("split") == "train")
    y = F.col(task.label_col).try_cast("double")
    out = None
    for bname in bucketers:
        rows = make_bucketer(bname).fit(train).assign(frame).where(y.isNotNull()) \
            .select("bucket_id", "split", last_activity_col().alias("la"), y.alias("y_true"))
        sizes = rows.groupBy("bucket_id").agg(F.count_if(F.col("split") == "train").alias("n_train"),
                                              F.count_if(F.col("split") == "val").alias("n_val"))
        if mode_of(bname) == "per_bucket":
            sizes = sizes.where((F.col("n_train") >= min_bucket_samples) & (F.col("n_val") >= min_bucket_samples))
        mean = rows.where("split = 'train'").groupBy("bucket_id").agg(F.avg("y_true").alias("gm"))
        by_act = rows.where("split = 'train'").groupBy("bucket_id", "la").agg(F.sum("y_true").alias("s"),
                                                                              F.count(F.lit(1)).alias("c"))
        scored = (rows.where("split = 'val'").join(sizes.select("bucket_id"), "bucket_id").join(mean, "bucket_id")
                  .join(by_act, ["bucket_id", "la"], "left")
                  .withColumn("y_pred", F.coalesce((F.col("s") + F.col("gm")) / (F.col("c") + 1), F.col("gm"))))
        score = scored.groupBy("bucket_id").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("score"),
                                                F.count(F.lit(1)).alias("n"))
        row = score.agg(F.count(F.lit(1)).alias("n_models"), F.sum("n").alias("n_val"),
                        (F.try_divide(F.sum(F.col("score") * F.col("n")), F.sum("n")) / 86400.0).alias("primary_score")) \
            .where("n_models > 0").select(F.lit(bname).alias("bucketing"), F.lit(mode_of(bname)).alias("mode"),
                                          "n_models", "n_val", "primary_score")
        out = row if out is None else out.unionByName(row)
    return out


def best_per_task(results: DataFrame) -> DataFrame:
    """EXP-3: best strategy per task by the task's metric direction."""
    key = F.when(F.col("primary_metric").isin("mae_days", "mae_sec", "medae_days"), -F.col("primary_score")) \
        .otherwise(F.col("primary_score"))
    w = Window.partitionBy("task").orderBy(F.desc_nulls_last(key), F.asc("bucketing"), F.asc("encoding"))
    return results.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def best_encoder_per_bucket(per_bucket_scores: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """EXP-6: per bucket, the encoder with the best score (max_by / min_by), and the size-weighted total."""
    pick = F.max_by if higher_is_better else F.min_by
    best = per_bucket_scores.groupBy("bucket_id").agg(
        pick("encoding", F.struct("score", "encoding")).alias("encoding"),
        (F.max("score") if higher_is_better else F.min("score")).alias("score"), F.first("n").alias("n"))
    return best


def gain_pivot(results: DataFrame, baseline_bucketing: str = "no_bucket", baseline_encoding: str = "last_state") -> DataFrame:
    """EXP-10: % gain of every strategy over the baseline strategy of its task, pivoted by encoder."""
    base = results.where((F.col("bucketing") == baseline_bucketing) & (F.col("encoding") == baseline_encoding)) \
        .select("task", F.col("primary_score").alias("_base"))
    from caseflow.functions.scalar import relative_gain_pct
    hib = ~F.col("primary_metric").isin("mae_days", "mae_sec", "medae_days")
    g = results.join(F.broadcast(base), "task").withColumn("gain_pct", relative_gain_pct(F.col("primary_score"), F.col("_base"), hib))
    return g.groupBy("task", "bucketing").pivot("encoding").agg(F.first("gain_pct"))


def staged_gains(results: DataFrame, searched: DataFrame, baseline_bucketing: str = "no_bucket",
                 baseline_encoding: str = "last_state") -> DataFrame:
    """EXP-10: for each task, the gain in % of its best strategy over the baseline one, and of a search over that best strategy.

    ``results`` holds task, primary_metric, bucketing, encoding, primary_score;
    ``searched`` task and ``search_score``.  Both are a few rows a task.  A task
    without a baseline, a score or a search has no row; a gain over a score of 0 is 0.
    """
    from caseflow.functions.scalar import relative_gain_pct
    lower = F.first("primary_metric").isin("mae_days", "mae_sec", "medae_days")
    is_base = (F.col("bucketing") == baseline_bucketing) & (F.col("encoding") == baseline_encoding)
    stages = results.groupBy("task").agg(
        F.max(F.when(is_base, F.col("primary_score"))).alias("baseline_score"),
        F.when(lower, F.min("primary_score")).otherwise(F.max("primary_score")).alias("best_score"),
        (~lower).alias("_up")).join(searched.select("task", "search_score"), "task") \
        .where("baseline_score is not null and best_score is not null and search_score is not null")
    gain = lambda to, of: F.coalesce(relative_gain_pct(F.col(to), F.col(of), F.col("_up")), F.lit(0.0))
    return stages.select("task", "baseline_score", "best_score", "search_score",
                         gain("best_score", "baseline_score").alias("gain_strategy_pct"),
                         gain("search_score", "best_score").alias("gain_search_pct"))
