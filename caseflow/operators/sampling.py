"""Train-fitted filters on prefixes and exemplar selection (FLT-13..16, SRT-2..8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators.schema import CASE
from caseflow.functions.scalar import attach_scalars, small_side


def iqr_bounds(prefixes: DataFrame, label_col: str = "label_remaining_time_sec", multiplier: float = 1.5,
               split_col: str = "split") -> DataFrame:
    """FLT-13 fit: one row (q1, q3, lo, hi) from train labels (linear percentiles)."""
    from caseflow.functions.quantiles import exact_quantiles
    y = F.col(label_col).try_cast("double")
    train = prefixes.where((F.col(split_col) == "train") & y.isNotNull()).select(y.alias("_y"))
    q = exact_quantiles(train, "_y", [0.25, 0.75]).select(F.col("q0").alias("q1"), F.col("q1").alias("q3"))
    return q.select("q1", "q3", (F.col("q1") - F.lit(multiplier) * (F.col("q3") - F.col("q1"))).alias("lo"),
                    (F.col("q3") + F.lit(multiplier) * (F.col("q3") - F.col("q1"))).alias("hi"))


def filter_iqr_outliers(prefixes: DataFrame, label_col: str = "label_remaining_time_sec", multiplier: float = 1.5,
                        split_col: str = "split") -> DataFrame:
    """FLT-13: drop train rows whose label is outside [Q1 - m*IQR, Q3 + m*IQR].

    Val/test rows and null labels are kept; an empty train set leaves all rows
    (the bounds row is null).  Bounds are a 1-row broadcast.
    """
    b = iqr_bounds(prefixes, label_col, multiplier, split_col)
    y = F.col(label_col).try_cast("double")
    j = attach_scalars(prefixes, b.select("lo", "hi"))
    keep = ((F.col(split_col) != "train") | y.isNull() | F.col("lo").isNull()
            | ((y >= F.col("lo")) & (y <= F.col("hi"))))
    return j.where(keep).drop("lo", "hi")


def filter_rare_classes(prefixes: DataFrame, label_col: str = "label_next_activity", min_class_samples: int = 10,
                        split_col: str = "split") -> DataFrame:
    """FLT-14: if train has a class below ``min_class_samples`` rows, keep only the
    train classes at or above it, in every split; otherwise a no-op (A-8).

    Class counts are vocabulary-sized, so broadcast.
    """
    counts = (prefixes.where(F.col(split_col) == "train").groupBy(label_col)
              .agg(F.count(F.lit(1)).alias("_cnt")))
    flag = counts.agg(F.max((F.col("_cnt") < min_class_samples).cast("int")).alias("_has_rare"))
    kept = counts.where(F.col("_cnt") >= min_class_samples).select(F.col(label_col).alias("_kc"))
    j = (attach_scalars(prefixes, flag)
         .join(small_side(kept), F.col(label_col) == F.col("_kc"), "left"))
    keep = (F.coalesce(F.col("_has_rare"), F.lit(0)) == 0) | F.col("_kc").isNotNull()
    return j.where(keep).drop("_has_rare", "_kc")


def filter_small_buckets(df: DataFrame, min_bucket_size: int, bucket_col: str = "bucket_id") -> DataFrame:
    """FLT-15: drop buckets with fewer than ``min_bucket_size`` rows (bucket table is tiny)."""
    sizes = df.groupBy(bucket_col).agg(F.count(F.lit(1)).alias("_bs")).where(F.col("_bs") >= min_bucket_size)
    return df.join(small_side(sizes.select(bucket_col)), bucket_col, "left_semi")


def bucket_eligibility(df: DataFrame, min_samples: int, classification: bool, label_col: str,
                       bucket_col: str = "bucket_id", split_col: str = "split") -> DataFrame:
    """FLT-16: per bucket train/val sizes, train classes and eligibility flag."""
    g = df.groupBy(bucket_col).agg(
        F.count_if(F.col(split_col) == "train").alias("n_train"),
        F.count_if(F.col(split_col) == "val").alias("n_val"),
        F.count_distinct(F.when(F.col(split_col) == "train", F.col(label_col))).alias("n_train_classes"))
    ok = (F.col("n_train") >= min_samples) & (F.col("n_val") >= min_samples)
    if classification:
        ok = ok & (F.col("n_train_classes") >= 2)
    return g.withColumn("eligible", ok)


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """SRT-2/3: ``orderBy(...).limit(n)`` (a TakeOrderedAndProject: per-task top-n, then merge)."""
    return df.orderBy(*order).limit(n)


def worst_predictions(pred: DataFrame, n: int = 10, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """SRT-3: n largest absolute errors (ties by case_id, prefix_len)."""
    e = F.abs(F.col(y) - F.col(p))
    return top_n(pred.withColumn("abs_error", e), [F.desc("abs_error"), F.asc(CASE), F.asc("prefix_len")], n)


def quantile_exemplars(df: DataFrame, label_col: str, quantiles=(0.5, 0.9, 0.99)) -> DataFrame:
    """SRT-4/5: for each quantile q of the label, the row nearest to it (ties by key).

    The quantile values are one row of scalars; a single aggregate then keeps,
    per quantile, the row with the smallest distance (``min_by``), so the work
    is one pass over the rows, not rows x quantiles.
    """
    from caseflow.functions.quantiles import exact_quantiles
    y = F.col(label_col).cast("double")
    qv = exact_quantiles(df.select(y.alias("_y")), "_y", list(quantiles))
    j = attach_scalars(df.where(y.isNotNull()), qv)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = j.agg(*[F.min_by(row, F.struct(F.abs(y - F.col(f"q{i}")), F.col(CASE), F.col("prefix_len"))).alias(f"r{i}")
                   for i in range(len(quantiles))],
                 *[F.first(f"q{i}").alias(f"v{i}") for i in range(len(quantiles))])
    long = best.select(F.explode(F.array(*[
        F.struct(F.lit(float(q)).alias("quantile"), F.col(f"v{i}").alias("q_value"), F.col(f"r{i}").alias("_r"))
        for i, q in enumerate(quantiles)])).alias("_e"))
    return long.select("_e.quantile", "_e.q_value", "_e._r.*")


def _pick_order(seed: int):
    """A seeded hash of the row key: an arbitrary order that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(CASE), F.col("prefix_len").cast("string")))


def filled_quantile_exemplars(df: DataFrame, label_col: str, n: int = 20,
                              quantiles=(0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99), seed: int = 42) -> DataFrame:
    """SRT-5: the different rows nearest to the label quantiles, filled up to ``n`` with other labelled rows in a seeded hash order.

    ``pick`` says which: ``quantile`` or ``fill``.
    """
    near = quantile_exemplars(df, label_col, quantiles).select(*df.columns).dropDuplicates([CASE, "prefix_len"])
    rest = df.where(F.col(label_col).try_cast("double").isNotNull()).join(near.select(CASE, "prefix_len"), [CASE, "prefix_len"], "left_anti")
    order = [_pick_order(seed), F.col(CASE), F.col("prefix_len")]
    # n rows at most, so the unpartitioned window is tiny
    fill = rest.orderBy(*order).limit(n).withColumn("_rn", F.row_number().over(Window.orderBy(*order)))
    fill = attach_scalars(fill, near.agg(F.count(F.lit(1)).alias("_nq"))).where(F.col("_rn") <= n - F.col("_nq"))
    return near.withColumn("pick", F.lit("quantile")).unionByName(fill.select(*df.columns, F.lit("fill").alias("pick")))


def classification_exemplars(pred: DataFrame, n: int = 20, y: str = "y_true", p: str = "y_pred",
                             seed: int = 42) -> DataFrame:
    """SRT-6: up to n/2 wrong predictions, the rest right; a seeded hash gives the pick order."""
    key = _pick_order(seed)
    wrong = (F.col(y) != F.col(p)).cast("int")
    r = pred.withColumn("_wrong", wrong).withColumn("_h", key)
    # per-class-of-correctness top-n by hash: row_number with a tiny limit (WindowGroupLimit)
    w = Window.partitionBy("_wrong").orderBy("_h", CASE, "prefix_len")
    picked = r.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    n_wrong = picked.agg(F.least(F.lit(n // 2), F.count_if(F.col("_wrong") == 1)).alias("_nw"))
    j = attach_scalars(picked, n_wrong)
    sel = ((F.col("_wrong") == 1) & (F.col("_rn") <= F.col("_nw"))) | \
          ((F.col("_wrong") == 0) & (F.col("_rn") <= F.lit(n) - F.col("_nw")))
    return j.where(sel).drop("_wrong", "_h", "_rn", "_nw")


def per_bucket_exemplar(pred: DataFrame, policy: str = "median", bucket_col: str = "bucket_id",
                        y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """SRT-7: one exemplar per bucket: closest to the bucket median error, the worst, or wrong-first."""
    if policy == "wrong_first":
        score = F.struct((F.col(y) == F.col(p)).cast("int"), F.col(CASE), F.col("prefix_len"))
    else:
        err = F.abs(F.col(y) - F.col(p))
        if policy == "worst":
            score = F.struct(-err, F.col(CASE), F.col("prefix_len"))
        else:
            from caseflow.functions.quantiles import exact_quantiles_by
            med = exact_quantiles_by(pred.withColumn("_ae", F.abs(F.col(y) - F.col(p))), [bucket_col], "_ae", [0.5]) \
                .withColumnRenamed("q0", "_med")
            pred = pred.join(small_side(med), bucket_col)
            score = F.struct(F.abs(err - F.col("_med")), F.col(CASE), F.col("prefix_len"))
    cols = [c for c in pred.columns if c != "_med"]
    return (pred.groupBy(bucket_col).agg(F.min_by(F.struct(*[F.col(c) for c in cols if c != bucket_col]), score).alias("_r"))
            .select(bucket_col, "_r.*"))


def sample_prefixes(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """SRT-8: Bernoulli sample by a seeded hash of the key, the same rows whatever the partitions (the limit is the feature)."""
    draw = F.conv(F.substring(_pick_order(seed), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return df.where(draw < float(fraction))


def case_quantile_exemplars(df: DataFrame, label_col: str, n_examples: int = 3, seed: int = 42) -> DataFrame:
    """SRT-4: one representative row per case (its longest prefix); for the label
    quantiles .5 (.9, .99 when n allows) pick, in turn, the representative nearest
    to the quantile among cases not picked yet (ties by case_id); fill up to
    ``n_examples`` with other cases in a seeded hash order.

    Each pick is one O(rows) ``min_by`` aggregate over the case representatives;
    earlier picks (≤ 3 rows) are excluded with an anti join.
    """
    from caseflow.functions.quantiles import exact_quantiles
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    reps = (df.groupBy(CASE).agg(F.max_by(row, F.col("prefix_len")).alias("_r")).select("_r.*")
            .where(F.col(label_col).try_cast("double").isNotNull()))
    qs = [0.5] + ([0.9] if n_examples >= 2 else []) + ([0.99] if n_examples >= 3 else [])
    qv = exact_quantiles(reps.select(F.col(label_col).cast("double").alias("_y")), "_y", qs)
    y = F.col(label_col).cast("double")
    picked = None
    for i, q in enumerate(qs):
        cand = reps if picked is None else reps.join(picked.select(CASE), CASE, "left_anti")
        best = attach_scalars(cand, qv.select(F.col(f"q{i}").alias("_q"))).agg(
            F.min_by(F.struct(*[F.col(f"`{c}`") for c in reps.columns]),
                     F.struct(F.abs(y - F.col("_q")), F.col(CASE))).alias("_b")).select("_b.*").where(F.col(CASE).isNotNull())
        best = best.withColumn("_pick", F.lit(i + 1))
        picked = best if picked is None else picked.unionByName(best)
    if picked is None:
        return reps.limit(0).withColumn("_pick", F.lit(0))
    fill_n = n_examples - len(qs)
    if fill_n > 0:
        rest = reps.join(picked.select(CASE), CASE, "left_anti")
        fill = (rest.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(CASE))), F.col(CASE)).limit(fill_n)
                .withColumn("_pick", F.lit(len(qs) + 1)))
        picked = picked.unionByName(fill)
    return picked
