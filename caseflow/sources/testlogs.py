"""Event-log views over the driver's test tables.

Each function reads whole parquet tables and returns a canonical event log
(``case_id, activity, timestamp, _event_index`` + attributes).  Timestamps in the
test files are ``timestamp_ntz``; they are cast to ``timestamp`` (session zone UTC).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: case = user_id, activity = event_type, ts = ts, index = event_id."""
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("case_id"),
        F.col("event_type").alias("activity"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_id").cast("bigint").alias("_event_index"),
        F.col("value"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("prop_k"),
    )


def user_day_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: case = ``<user_id>-<yyyy-MM-dd>`` (short cases)."""
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("case_id"),
        F.col("event_type").alias("activity"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_id").cast("bigint").alias("_event_index"),
        F.col("value"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("prop_k"),
    )


def line_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: case = l_orderkey, activity = returnflag||linestatus, ts = l_shipdate.

    The table has no single unique row key, so the event index is the rank of the
    line within its order by (linenumber, partkey, suppkey, quantity, price),
    computed with the skew-aware running count (a hot order is split in chunks).
    The plain path partitions by ``case_id`` so later per-case operators reuse it.
    """
    li = _read(spark, sf_dir, "lineitem")
    base = li.select(
        F.col("l_orderkey").cast("string").alias("case_id"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("activity"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    )
    from caseflow.operators.sequence import ordered_scan
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    ranked = ordered_scan(base.withColumn("_one", F.lit(1)), order, running_sum={"_event_index": "_one"})
    return ranked.select(
        "case_id", "activity", "timestamp", F.col("_event_index").cast("bigint").alias("_event_index"),
        "l_suppkey", "l_quantity",
    )


def customer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: case = o_custkey, activity = o_orderstatus, ts = o_orderdate, index = o_orderkey."""
    o = _read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").cast("string").alias("case_id"),
        F.col("o_orderstatus").alias("activity"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_orderkey").cast("bigint").alias("_event_index"),
        "o_orderpriority", "o_totalprice",
    )


# DuckDB twins of the views above, used by the oracle SQL.
USER_LOG_SQL = """
SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, ts AS "timestamp",
       CAST(event_id AS BIGINT) AS _event_index, value,
       TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS prop_k
FROM events
"""

USER_DAY_LOG_SQL = """
SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS case_id, event_type AS activity,
       ts AS "timestamp", CAST(event_id AS BIGINT) AS _event_index, value,
       TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS prop_k
FROM events
"""

LINE_LOG_SQL = """
SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l_returnflag || l_linestatus AS activity,
       l_shipdate AS "timestamp",
       CAST(row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS _event_index,
       l_suppkey, l_quantity
FROM lineitem
"""

CUSTOMER_LOG_SQL = """
SELECT CAST(o_custkey AS VARCHAR) AS case_id, o_orderstatus AS activity, o_orderdate AS "timestamp",
       CAST(o_orderkey AS BIGINT) AS _event_index, o_orderpriority, o_totalprice
FROM orders
"""
