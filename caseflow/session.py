"""Spark session defaults for event-log work."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the engine relies on.  UTC is required: all time arithmetic is done
# on epoch microseconds and calendar features must not depend on the host zone.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Extra settings for large clusters: AQE sizes shuffle partitions at run time
# from this target, splits skewed join partitions, and files are read in
# splits of the same size.
CLUSTER_CONF = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
}


#: Drops the shuffle files of a query at its end instead of whenever the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_partitions_for(input_bytes: int, target_bytes: int = 256 << 20, floor: int = 200) -> int:
    """Initial shuffle partition count for an input size: ~one target-sized partition
    per 256 MB of input (AQE coalesces down at run time, so erring high is cheap)."""
    return max(floor, -(-int(input_bytes) // target_bytes))


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "caseflow", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    On a cluster call it without ``master``; the launcher decides.  Tests pass
    ``local[*]`` and a small ``shuffle_partitions``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the cluster.

    The cluster names it in ``spark.checkpoint.dir``; only a local session, whose
    driver and executors are one machine, gets a fresh scratch folder if it is unset.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="caseflow-ckpt-", dir=os.environ.get("CASEFLOW_SCRATCH", "/tmp"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


#: Tables that this process has materialised and not dropped.
_tables: list[str] = []


def drop_tables(spark: SparkSession) -> int:
    """Delete the tables that :func:`materialize` wrote in this process; call it when their results are written.

    Frames that still read them fail afterwards.  Returns how many there were.
    """
    n = len(_tables)
    while _tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs started inside send rows to Python workers in batches of some ``most`` bytes, however long the rows are."""
    before = spark.conf.get(ARROW_BATCH_BYTES)
    spark.conf.set(ARROW_BATCH_BYTES, str(most))
    try:
        yield
    finally:
        spark.conf.set(ARROW_BATCH_BYTES, before)


def materialize(df, how: str = "table", by: str | None = None, parts: int = 0):
    """Compute ``df`` once for several consumers.

    ``table``: written as parquet under the shared checkpoint folder and read
    back (lineage cut, columnar re-reads with column pruning); with ``by``, in ``parts`` buckets of that
    column, so that joins, groups and windows on it shuffle nothing; ``checkpoint``:
    Spark's reliable RDD checkpoint in the same folder; ``persist``: executor
    storage, recomputed from lineage if lost.
    """
    if how == "table":
        import uuid
        spark = df.sparkSession
        path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
        _tables.append(path)
        before = spark.conf.get(SHUFFLE_CLEANUP, "false")
        spark.conf.set(SHUFFLE_CLEANUP, "true")  # the table replaces the shuffle files of this write
        try:
            if by:
                # buckets are known to the catalog only; the frame that is read keeps them when the name goes
                name = f"caseflow_{uuid.uuid4().hex}"
                df.write.format("parquet").bucketBy(parts, by).option("path", path).saveAsTable(name)
                table = spark.table(name)
                spark.sql(f"DROP TABLE {name}")
                return table
            df.write.parquet(path)
        finally:
            spark.conf.set(SHUFFLE_CLEANUP, before)
        return spark.read.schema(df.schema).parquet(path)
    if how == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if how == "persist":
        out = df.persist()
        out.count()
        return out
    return df
