"""Distributed global rank (1..n over a total order) without a single-partition window.

``orderBy`` range-partitions the rows; inside each partition
``monotonically_increasing_id`` already counts rows in order.  Per-partition
counts (one row per partition) give the offsets.  Partition id and position are
stored with the rows in a table written to the cluster's checkpoint folder, so
both uses see the same values and lineage is cut (safe under executor loss).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.session import materialize


def global_rank(df: DataFrame, order: list[Column | str], name: str = "_rank") -> DataFrame:
    s = materialize(df.orderBy(*order)
                    .withColumn("_gr_pid", F.spark_partition_id())
                    .withColumn("_gr_mid", F.monotonically_increasing_id()), "table")
    counts = s.groupBy("_gr_pid").agg(F.count(F.lit(1)).alias("_gr_c"))
    # one row per partition: an unpartitioned window over it is bounded by the partition count
    offs = counts.withColumn("_gr_off", F.coalesce(
        F.sum("_gr_c").over(Window.orderBy("_gr_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.col("_gr_mid") - F.shiftleft(F.col("_gr_pid").cast("bigint"), 33)
    return (s.join(F.broadcast(offs.select("_gr_pid", "_gr_off")), "_gr_pid")
            .withColumn(name, (F.col("_gr_off") + local + 1).cast("bigint"))
            .drop("_gr_pid", "_gr_mid", "_gr_off"))
