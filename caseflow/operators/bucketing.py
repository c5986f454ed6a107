"""Bucketers (BKT-1..6): ``fit(train) -> model``, ``model.assign(df) -> df + bucket_id``.

Fitted state is tiny and bounded (≤ 6 edges, one max, an activity vocabulary),
so it is held on the driver and applied as column expressions or a broadcast
join; fitting never sees val/test rows (SPL-3).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from caseflow.functions.scalar import attach_scalars, small_side


def _int_col(c: str) -> Column:
    return F.col(c).cast("int")


@dataclass
class NoBucket:
    """BKT-1: everything in bucket 0."""
    name: str = "no_bucket"

    def fit(self, train: DataFrame) -> "NoBucket":
        return self

    def assign(self, df: DataFrame, bucket_col: str = "bucket_id") -> DataFrame:
        return df.withColumn(bucket_col, F.lit(0).cast("int"))


@dataclass
class PrefixLenBins:
    """BKT-2: ``(clip(k, 1, max) - 1) div bin_size + 1``; max learned on train (A-18) or given."""
    bin_size: int = 5
    max_len: int | None = None
    clamp_lower: int = 1
    prefix_len_col: str = "prefix_len"
    name: str = "prefix_len_bins"
    max_: int | None = None

    def fit(self, train: DataFrame) -> "PrefixLenBins":
        self.max_ = int(self.max_len) if self.max_len is not None else \
            int(train.agg(F.max(self.prefix_len_col)).first()[0] or self.clamp_lower)
        return self

    def expr(self) -> Column:
        k = F.least(F.greatest(_int_col(self.prefix_len_col), F.lit(self.clamp_lower)), F.lit(self.max_))
        return ((k - 1).cast("int") / F.lit(self.bin_size)).cast("int") + 1

    def assign(self, df: DataFrame, bucket_col: str = "bucket_id") -> DataFrame:
        return df.withColumn(bucket_col, self.expr().cast("int"))


def adaptive_edges(median: int, maximum: int, factors=(0.2, 0.6, 1.0, 1.5, 2.0), clamp_lower: int = 1,
                   min_bucket_width: int = 1, max_len: int | None = None) -> list[int]:
    """Edges from the train median and max of prefix length (BKT-3).

    The wanted edges are the factors of the median and the maximum, in order; with
    a least width w, edge i is the running maximum of wanted[j] - j * w, plus i * w.
    """
    middle = max(clamp_lower, int(median))
    top = min([max(middle, int(maximum)), *([] if max_len is None else [int(max_len)])])
    wanted = np.unique(np.maximum(clamp_lower, np.append(np.ceil(np.multiply(factors, middle)), top)))
    wanted = wanted if wanted[-1] == top else np.append(wanted, top)
    widths = min_bucket_width * np.arange(len(wanted))
    least = clamp_lower - 1 + min_bucket_width
    return (np.maximum.accumulate(np.maximum(wanted - widths, least)) + widths).astype(int).tolist()


@dataclass
class PrefixLenAdaptive:
    """BKT-3: bucket = position of the first edge >= clipped prefix length (1-based)."""
    factors: tuple = (0.2, 0.6, 1.0, 1.5, 2.0)
    clamp_lower: int = 1
    min_bucket_width: int = 1
    max_len: int | None = None
    prefix_len_col: str = "prefix_len"
    name: str = "prefix_len_adaptive"
    edges_: list = field(default_factory=list)

    def fit(self, train: DataFrame) -> "PrefixLenAdaptive":
        # exact median (linear interpolation) then int(), as the reference does
        r = train.agg(F.percentile(F.col(self.prefix_len_col).cast("double"), F.lit(0.5)).alias("m"),
                      F.max(self.prefix_len_col).alias("x")).first()
        self.edges_ = adaptive_edges(int(r["m"]), int(r["x"]), self.factors, self.clamp_lower,
                                     self.min_bucket_width, self.max_len)
        return self

    def expr(self) -> Column:
        k = F.least(F.greatest(_int_col(self.prefix_len_col), F.lit(self.clamp_lower)), F.lit(self.edges_[-1]))
        e = F
        for i, edge in enumerate(self.edges_):
            e = e.when(k <= F.lit(edge), F.lit(i + 1))
        return e.otherwise(F.lit(len(self.edges_)))

    def assign(self, df: DataFrame, bucket_col: str = "bucket_id") -> DataFrame:
        return df.withColumn(bucket_col, self.expr().cast("int"))


@dataclass
class LastActivity:
    """BKT-4: sorted train last activities -> 1..n; unseen -> n+1.

    The vocabulary is a DataFrame (bounded by the number of activities) ranked
    with a small window and broadcast-joined; nothing is collected.
    """
    prefix_col: str = "prefix_activities"
    name: str = "last_activity"
    vocab_: DataFrame | None = None

    def fit(self, train: DataFrame) -> "LastActivity":
        acts = train.select(F.element_at(self.prefix_col, -1).alias("_last_act")).where("_last_act IS NOT NULL").distinct()
        self.vocab_ = acts.withColumn("_bid", F.row_number().over(Window.orderBy("_last_act")))
        return self

    def assign(self, df: DataFrame, bucket_col: str = "bucket_id") -> DataFrame:
        unseen = self.vocab_.agg((F.count(F.lit(1)) + 1).alias("_unseen_id"))
        last = F.col("last_activity") if "last_activity" in df.columns else F.element_at(self.prefix_col, -1)
        j = attach_scalars(df.withColumn("_last_act", last)
                           .join(small_side(self.vocab_.select("_last_act", "_bid")), "_last_act", "left"), unseen)
        return j.withColumn(bucket_col, F.coalesce(F.col("_bid"), F.col("_unseen_id")).cast("int")) \
                .drop("_last_act", "_bid", "_unseen_id")


@dataclass
class ClusterBucketer:
    """BKT-5: KMeans on activity counts + prefix length; bucket = cluster + 1.

    Spark ML ``CountVectorizer`` (vocab fitted on train) + ``VectorAssembler`` +
    ``KMeans(seed)``; k is clamped to the train row count.
    """
    n_clusters: int = 3
    seed: int = 42
    prefix_col: str = "prefix_activities"
    prefix_len_col: str = "prefix_len"
    name: str = "cluster"
    model_: object = None

    def fit(self, train: DataFrame) -> "ClusterBucketer":
        from pyspark.ml import Pipeline
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import CountVectorizer, VectorAssembler

        n = train.limit(self.n_clusters).count()
        k = max(1, min(self.n_clusters, n))
        stages = [CountVectorizer(inputCol=self.prefix_col, outputCol="_cb_counts", minDF=1.0),
                  VectorAssembler(inputCols=["_cb_counts", "_cb_len"], outputCol="_cb_x")]
        if k >= 2:
            stages.append(KMeans(k=k, seed=self.seed, featuresCol="_cb_x", predictionCol="_cb_cluster"))
        self.model_ = Pipeline(stages=stages).fit(train.withColumn("_cb_len", F.col(self.prefix_len_col).cast("double")))
        self._k = k
        return self

    def assign(self, df: DataFrame, bucket_col: str = "bucket_id") -> DataFrame:
        out = self.model_.transform(df.withColumn("_cb_len", F.col(self.prefix_len_col).cast("double")))
        bid = (F.col("_cb_cluster") + 1) if self._k >= 2 else F.lit(1)
        return out.withColumn(bucket_col, bid.cast("int")).drop("_cb_counts", "_cb_len", "_cb_x", "_cb_cluster")


BUCKETERS = {
    "no_bucket": NoBucket,
    "prefix_len_bins": PrefixLenBins,
    "prefix_len_adaptive": PrefixLenAdaptive,
    "last_activity": LastActivity,
    "cluster": ClusterBucketer,
}


def make_bucketer(name: str, **kw):
    return BUCKETERS[name](**kw)


def bucketize(prefixes: DataFrame, bucketer, split_col: str = "split", min_bucket_size: int | None = None,
              bucket_col: str = "bucket_id") -> tuple[DataFrame, object]:
    """BKT-6: fit on train rows, assign all rows, optional bucket-size filter (FLT-15)."""
    train = prefixes.where(F.col(split_col) == "train") if split_col in prefixes.columns else prefixes
    model = bucketer.fit(train)
    out = model.assign(prefixes, bucket_col)
    if min_bucket_size:
        from caseflow.operators.sampling import filter_small_buckets
        out = filter_small_buckets(out, min_bucket_size, bucket_col)
    return out, model


def bucket_sizes(df: DataFrame, bucket_col: str = "bucket_id") -> DataFrame:
    """AGG-21 base: rows per bucket."""
    return df.groupBy(bucket_col).agg(F.count(F.lit(1)).alias("n_rows"))


def bucketer_state(bucketer) -> dict:
    """The plain values of a fitted bucketer (tables and models are saved beside them)."""
    return {k: v for k, v in vars(bucketer).items() if not k.endswith(("vocab_", "model_"))}


def save_bucketer(bucketer, path: str) -> dict:
    """Write what a fitted bucketer holds as a table or model; returns its plain state."""
    if isinstance(bucketer, LastActivity):
        bucketer.vocab_.write.mode("overwrite").parquet(f"{path}/vocab")
    if isinstance(bucketer, ClusterBucketer):
        bucketer.model_.write().overwrite().save(f"{path}/model")
    return bucketer_state(bucketer)


def load_bucketer(spark, state: dict, path: str):
    """The bucketer that :func:`save_bucketer` saved."""
    from pyspark.ml import PipelineModel
    bucketer = BUCKETERS[state["name"]]()
    for k, v in state.items():
        setattr(bucketer, k, v)
    if isinstance(bucketer, LastActivity):
        bucketer.vocab_ = spark.read.parquet(f"{path}/vocab")
    if isinstance(bucketer, ClusterBucketer):
        bucketer.model_ = PipelineModel.load(f"{path}/model")
    return bucketer
