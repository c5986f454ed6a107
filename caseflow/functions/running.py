"""Running totals over a whole table without a single task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseflow.session import materialize


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def running_totals(df: DataFrame, order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """Add ``row_no`` (from 0), ``before`` (sum of ``value`` over earlier rows) and ``total`` in the given order.

    Rows are range-partitioned on ``order`` and written once, so that every
    later step sees the same partitions; each partition yields one total, the
    running sum over these few totals gives its offset, and the rows add their
    own running sum inside the partition.  No step sees more than one partition's
    rows: the offsets table has one row for each partition (``parts`` at most),
    which is the bound of its broadcast.  Rows that tie on all of ``order`` are
    ordered arbitrarily among themselves.
    """
    parts = parts or shuffle_partitions(df.sparkSession)
    placed = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))
               .select("_part",
                       F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows0"),
                       F.coalesce(F.sum("_v").over(earlier), F.lit(0)).alias("_sum0"),
                       F.sum("_v").over(every).alias("total")))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn("row_no", (F.col("_rows0") + F.row_number().over(inside) - 1).cast("long"))
            .withColumn("before", F.col("_sum0") - F.col(value)
                        + F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
            .drop("_part", "_rows0", "_sum0"))
