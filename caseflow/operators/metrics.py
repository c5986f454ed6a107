"""Evaluation metrics as aggregates over a predictions frame (MET-1..11, MOD-3).

Predictions frame: ``case_id, prefix_len, [bucket_id], [split], y_true, y_pred``.
Everything is a groupBy; the confusion table is bounded by classes².
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from caseflow.functions.running import running_totals
from caseflow.functions.scalar import attach_scalars


def confusion(pred: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """MET-7 long form: (y_true, y_pred, n)."""
    return pred.groupBy(F.col(y).cast("string").alias("y_true"), F.col(p).cast("string").alias("y_pred")) \
        .agg(F.count(F.lit(1)).alias("n"))


def _label_counts(c: DataFrame, group: list[str] = ()) -> DataFrame:
    """``tp``, ``sup`` and ``prd`` of each label of a confusion table, true or predicted; null labels and groups count nothing.

    The table is read once: its predictions may be as dear as a model.
    """
    n, none = F.col("n"), F.lit(0).cast("bigint")
    side = lambda label, tp, sup, prd: F.struct(F.col(label).alias("label"), tp.alias("tp"), sup.alias("sup"), prd.alias("prd"))
    hit = F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(none)
    known = F.col("label").isNotNull()
    for g in group:
        known = known & F.col(g).isNotNull()
    return (c.select(*group, F.explode(F.array(side("y_true", hit, n, none), side("y_pred", none, none, n))).alias("_l"))
            .select(*group, "_l.*").groupBy(*group, "label")
            .agg(*[F.sum(F.when(known, F.col(x)).otherwise(none)).alias(x) for x in ("tp", "sup", "prd")]))


def per_class_scores(pred: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """MET-8: precision, recall, F1, support per class; labels = union of true and predicted (SET-4).

    Undefined ratios are 0 (sklearn's zero_division behaviour)."""
    j = _label_counts(confusion(pred, y, p)).select("label", "tp", F.col("sup").alias("support"), F.col("prd").alias("predicted"))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return j.select("label", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                    F.col("support").cast("bigint").alias("support"), "tp", "predicted")


def f1_scores(pred: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """MET-1: one row (f1_macro, f1_micro, accuracy, n)."""
    s = per_class_scores(pred, y, p)
    return s.agg(F.avg("f1").alias("f1_macro"),
                 F.try_divide(2.0 * F.sum("tp"), F.sum("support") + F.sum("predicted")).alias("f1_micro"),
                 F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"),
                 F.sum("support").cast("bigint").alias("n"))


def binary_f1(pred: DataFrame, positive: str, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """MET-2 (f1 part) for a chosen positive class."""
    s = per_class_scores(pred, y, p).where(F.col("label") == F.lit(positive))
    return s.select(F.col("f1").alias("f1_binary"))


def roc_auc(pred: DataFrame, label_col: str, score_col: str) -> DataFrame:
    """MET-2 (AUC part), exact: one row ``roc_auc``, the share of (positive, negative) pairs that the score
    orders rightly, ties counting half (null without one of the classes).

    Rows are counted by score; a distributed running total gives the negatives below each.
    """
    counts = (pred.groupBy(F.col(score_col).cast("double").alias("score"))
              .agg(F.count_if(F.col(label_col) == 1).alias("pos"), F.count_if(F.col(label_col) == 0).alias("neg")))
    below = running_totals(counts, ["score"], "neg")
    twice = F.col("pos").cast("decimal(38,0)") * (2 * F.col("before") + F.col("neg"))
    return below.agg(F.try_divide(F.sum(twice).cast("double"),
                                  2.0 * F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def regression_errors(pred: DataFrame, y: str = "y_true", p: str = "y_pred", group: list[str] | None = None) -> DataFrame:
    """MET-3 / MET-4 / MET-6: MAE and median AE in seconds and days (optionally per group).

    Medians are exact; large inputs / groups use the distributed exact quantile.
    """
    e = F.abs(F.col(p).cast("double") - F.col(y).cast("double"))
    if group:
        from caseflow.functions.quantiles import exact_quantiles_by
        errs = pred.select(*group, e.alias("_e"))
        base = errs.groupBy(*group).agg(F.avg("_e").alias("mae_sec"), F.count(F.lit(1)).alias("n"))
        med = exact_quantiles_by(errs, group, "_e", [0.5]).withColumnRenamed("q0", "medae_sec")
        # group keys are bucket / split ids: null-safe join keeps a null group
        g = base.join(med, [base[c].eqNullSafe(med[c]) for c in group], "left") \
            .select(*[base[c] for c in group], "mae_sec", "medae_sec", "n")
    else:
        from caseflow.functions.quantiles import exact_quantiles
        errs = pred.select(e.alias("_e"))
        base = errs.agg(F.avg("_e").alias("mae_sec"), F.count(F.lit(1)).alias("n"))
        g = attach_scalars(base, exact_quantiles(errs, "_e", [0.5])).select(
            "mae_sec", F.col("q0").alias("medae_sec"), "n")
    return g.withColumn("mae_days", F.col("mae_sec") / 86400.0).withColumn("medae_days", F.col("medae_sec") / 86400.0)


def per_bucket_classification(pred: DataFrame, bucket_col: str = "bucket_id", y: str = "y_true",
                              p: str = "y_pred") -> DataFrame:
    """MET-4 (classification): accuracy and macro F1 per bucket."""
    c = pred.groupBy(bucket_col, F.col(y).cast("string").alias("y_true"), F.col(p).cast("string").alias("y_pred")) \
        .agg(F.count(F.lit(1)).alias("n"))
    j = _label_counts(c, [bucket_col])
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("sup") + F.col("prd")), F.lit(0.0))
    return j.groupBy(bucket_col).agg(F.avg(f1).alias("f1_macro"),
                                     F.try_divide(F.sum("tp").cast("double"), F.sum("sup")).alias("accuracy"),
                                     F.sum("sup").cast("bigint").alias("n"))


def weighted_score(per_bucket: DataFrame, score_col: str, n_col: str = "n") -> DataFrame:
    """MET-5: size-weighted mean of a per-bucket score."""
    return per_bucket.agg(F.try_divide(F.sum(F.col(score_col) * F.col(n_col)), F.sum(n_col)).alias("weighted_score"))


def error_by_prefix_len(pred: DataFrame, min_n: int = 5, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """MET-9: absolute error mean / sample std per prefix length, lengths with ≥ min_n rows."""
    e = F.abs(F.col(p) - F.col(y))
    return (pred.groupBy("prefix_len").agg(F.avg(e).alias("mean_abs_error"), F.stddev_samp(e).alias("std_abs_error"),
                                           F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_n))


def accuracy_by_prefix_len(pred: DataFrame, min_n: int = 5, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """MET-10."""
    return (pred.groupBy("prefix_len").agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"),
                                           F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_n))


def error_histogram(pred: DataFrame, bins: int = 50, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """MET-11: equal-width histogram of signed errors (top edge folded into the last bin)."""
    r = F.col(p) - F.col(y)
    rng = pred.agg(F.min(r).alias("_lo"), F.max(r).alias("_hi"))
    j = attach_scalars(pred.select(r.alias("residual")), rng)
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(
        F.least(F.lit(bins), F.width_bucket(F.col("residual"), F.col("_lo"), F.col("_hi"), F.lit(bins))))
    return j.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"),
                                                      F.min("residual").alias("bin_min"),
                                                      F.max("residual").alias("bin_max"))


def class_weights(train: DataFrame, label_col: str) -> DataFrame:
    """MOD-3: balanced weights ``N / (K * n_class)`` (class table is tiny)."""
    c = train.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_class"))
    tot = c.agg(F.sum("n_class").alias("_N"), F.count(F.lit(1)).alias("_K"))
    return attach_scalars(c, tot).select(
        label_col, "n_class", (F.col("_N") / (F.col("_K") * F.col("n_class"))).alias("weight"))
