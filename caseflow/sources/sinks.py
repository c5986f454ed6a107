"""Sinks: QC reports, previews, result tables, model bundles (SNK-1..7, SRC-7, EXP-9, EXP-11)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sorted_for_sink(df: DataFrame, n_partitions: int | None = None, ties=("_event_index",)) -> DataFrame:
    """SRT-1: rows grouped by case and ordered by (timestamp, ties) inside each output file.

    Order is only materialised where a file is written: a hash repartition on
    ``case_id`` plus a per-partition sort, never a global sort.
    """
    keys = ["timestamp"] + [t for t in ties if t in df.columns]
    r = df.repartition(n_partitions, "case_id") if n_partitions else df.repartition("case_id")
    return r.sortWithinPartitions("case_id", *keys)


def write_report(df: DataFrame, path: str) -> None:
    """SNK-1: a (small) metrics frame as JSON lines, one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def to_preview(df: DataFrame, n: int = 100, order: list | None = None) -> DataFrame:
    """SNK-2/3: first n rows by key; arrays and maps become JSON text for CSV."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        elif type(f.dataType).__name__ == "VectorUDT":
            from pyspark.ml.functions import vector_to_array
            c = F.to_json(vector_to_array(c))
        cols.append(c.alias(f.name))
    out = df.select(*cols)
    return out.orderBy(*(order or ["case_id", "prefix_len"])).limit(n) if order is not False else out.limit(n)


def write_preview(df: DataFrame, path: str, n: int = 100, fmt: str = "csv", order=None) -> None:
    p = to_preview(df, n, order)
    w = p.coalesce(1).write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def encoded_preview(encoded: DataFrame, feature_names: list[str], k: int = 5, n: int = 20) -> DataFrame:
    """SNK-4: per row, its top-k non-zero features by |value|, the number of them and the feature dim."""
    from pyspark.sql import Window

    from caseflow.operators.sparse import entries
    base = encoded.limit(n).select("case_id", "prefix_len", entries("features").alias("_e"))
    names = F.array(*[F.lit(x) for x in feature_names])
    ex = base.select("case_id", "prefix_len", F.lit(len(feature_names)).alias("feature_dim"),
                     F.size("_e").alias("nonzero"), F.explode("_e").alias("_v")) \
        .select("case_id", "prefix_len", "feature_dim", "nonzero", F.col("_v.index").alias("i"), "_v.value")
    w = Window.partitionBy("case_id", "prefix_len").orderBy(F.desc(F.abs("value")), "i")
    return (ex.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
            .withColumn("feature", F.get(names, F.col("i"))).drop("_r"))


def flatten_strategy_report(results: DataFrame) -> DataFrame:
    """SNK-5: metrics map flattened to ``metric__<name>`` columns, sorted by rank."""
    keys = [r[0] for r in results.select(F.explode(F.map_keys("metrics"))).distinct().orderBy(1).collect()]  # ≤ metric names
    return results.select("*", *[F.col("metrics")[k].alias(f"metric__{k}") for k in keys]).drop("metrics").orderBy("rank")


def append_results(df: DataFrame, path: str, keys: list[str] | None = None) -> DataFrame:
    """EXP-9 / EXP-11: append rows to a parquet table; with ``keys``, rows already present are skipped (resume)."""
    spark = df.sparkSession
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
    if keys and there:
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    df.write.mode("append").parquet(path)
    return df


def write_test_report(path: str, metrics: DataFrame, examples: DataFrame, per_bucket: DataFrame | None = None) -> None:
    """SNK-6: test metrics (JSON, one row, and per bucket if given) and example predictions (CSV) under ``path``."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    if per_bucket is not None:
        per_bucket.coalesce(1).write.mode("overwrite").json(f"{path}/per_bucket")
    examples.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/examples")


def save_bundle(path: str, models: dict, meta: dict, encoder, bucketer) -> None:
    """SNK-7: everything that scoring needs, written with Spark to the shared folder.

    One Spark ML directory per model (or the table of one-pass models), the encoder's vocabularies and target tables, the bucketer's
    state, and JSON metadata (task, strategy, ``target_log1p``, label vocabulary).
    """
    from caseflow.operators.bucketing import save_bucketer
    spark = SparkSession.getActiveSession()
    one_pass = isinstance(models, DataFrame)
    if one_pass:
        models.write.mode("overwrite").parquet(f"{path}/models")
    for b, m in () if one_pass else models.items():
        m.write().overwrite().save(f"{path}/model_{b}")
    for i, table in enumerate(encoder.tables.values()):
        table.write.mode("overwrite").parquet(f"{path}/encoder_{i}")
    whole = {"target_log1p": False, "label_vocab": None, **meta, "model_buckets": None if one_pass else sorted(models),
             "encoder": encoder.state, "encoder_tables": list(encoder.tables),
             "bucketer": save_bucketer(bucketer, f"{path}/bucketer")}
    spark.createDataFrame([(json.dumps(whole),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


REQUIRED_META = ("task", "bucketing", "encoding", "model_buckets", "encoder", "bucketer", "target_log1p")


def load_bundle(path: str) -> dict:
    """SRC-7: ``meta``, ``models``, ``encoder``, ``bucketer`` of a saved bundle, with a required-key check."""
    from pyspark.ml import PipelineModel

    from caseflow.operators.bucketing import load_bucketer
    from caseflow.operators.encoding import build_encoder
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    missing = [k for k in REQUIRED_META if k not in meta]
    if missing:
        raise ValueError(f"bundle metadata misses {missing}")
    tables = {c: spark.read.parquet(f"{path}/encoder_{i}") for i, c in enumerate(meta["encoder_tables"])}
    models = (spark.read.parquet(f"{path}/models") if meta["model_buckets"] is None
              else {int(b): PipelineModel.load(f"{path}/model_{b}") for b in meta["model_buckets"]})
    return {"meta": meta, "models": models,
            "encoder": build_encoder(meta["encoder"], tables),
            "bucketer": load_bucketer(spark, meta["bucketer"], f"{path}/bucketer")}
