"""File sources for event logs: CSV, parquet, XES (XML) and format detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def detect_format(path: str) -> str:
    """csv / parquet / xes by suffix (SRC-1); any ``.gz`` is taken as XES."""
    p = str(path).lower()
    if p.endswith(".csv"):
        return "csv"
    if p.endswith(".parquet") or p.endswith(".pq"):
        return "parquet"
    if p.endswith(".xes") or p.endswith(".gz"):
        return "xes"
    raise ValueError(f"unsupported event-log format: {path}")


def _with_file_index(df: DataFrame) -> DataFrame:
    # Source order, taken right at the scan: the id is a function of (input split,
    # row position), so a re-executed task produces the same values.
    return df.withColumn("_event_index", F.monotonically_increasing_id())


def read_csv_log(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8",
                 parse_dates: list[str] | None = None, schema: T.StructType | str | None = None,
                 timestamp_format: str | None = None) -> DataFrame:
    """Header CSV (SRC-2).  Pass ``schema`` on big inputs; inference costs a full pass."""
    r = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    if timestamp_format:
        r = r.option("timestampFormat", timestamp_format)
    df = _with_file_index(r.csv(path))
    for c in parse_dates or []:
        if c in df.columns:
            df = df.withColumn(c, F.try_to_timestamp(F.col(c).cast("string")))
    return df


def read_parquet_log(spark: SparkSession, path: str) -> DataFrame:
    """Parquet event log (SRC-4); ``timestamp_ntz`` columns become ``timestamp``."""
    df = spark.read.parquet(path)
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    if ntz:
        df = df.withColumns({c: F.col(c).cast("timestamp") for c in ntz})
    return _with_file_index(df)


# XES typed attribute tags and the Spark type each value becomes (fixed by the XES standard).
XES_TYPES = {"string": "string", "date": "timestamp", "int": "bigint", "float": "double",
             "boolean": "boolean", "id": "string"}

_ATTR = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()),
                                  T.StructField("_value", T.StringType())]))
_EVENT = T.StructType([T.StructField(tag, _ATTR) for tag in XES_TYPES])
XES_TRACE_SCHEMA = T.StructType([T.StructField(tag, _ATTR) for tag in XES_TYPES]
                                + [T.StructField("event", T.ArrayType(_EVENT))])


def _typed(value, tag: str):
    t = XES_TYPES[tag]
    if t == "timestamp":
        return F.try_to_timestamp(value)
    if t == "boolean":
        return F.lower(value) == F.lit("true")
    return value.try_cast(t) if t != "string" else value


def read_xes_log(spark: SparkSession, path: str) -> DataFrame:
    """XES log with Spark's XML reader (SRC-3): one row per event.

    Trace attributes become ``case:<key>`` columns, event attributes ``<key>``.
    Attribute tags are read as arrays of ``(_key, _value)`` so a tag that occurs
    once and one that repeats get the same type.  Nested XES lists are dropped.
    The set of attribute keys is schema metadata: a small distinct scan, not data.
    A key that occurs with several type tags becomes one column (double if all
    are numbers, else text); of a key that an element repeats, the last value counts.
    ``_event_index`` rises in file order.
    """
    raw = (spark.read.format("xml").option("rowTag", "trace")
           .schema(XES_TRACE_SCHEMA).load(path))

    def tagged(tag: str):
        # one-argument lambda: Spark passes (element, index) to two-argument ones
        return lambda a: F.struct(F.lit(tag).alias("tag"), a["_key"].alias("key"))

    def keys(level: str) -> list:
        cols = []
        for tag in XES_TYPES:
            src = F.col(tag) if level == "trace" else F.col(level)[tag]
            cols.append(F.transform(F.coalesce(src, F.array().cast(_ATTR)), tagged(tag)))
        return cols

    trace_keys = [(r["tag"], r["key"]) for r in raw.select(F.explode(F.flatten(F.array(*keys("trace"))))
                                                          .alias("k")).select("k.*").distinct().collect()]
    events = raw.select("*", F.posexplode("event").alias("_pos", "_ev"))
    event_keys = [(r["tag"], r["key"]) for r in events.select(F.explode(F.flatten(F.array(*keys("_ev"))))
                                                             .alias("k")).select("k.*").distinct().collect()]

    def value(level: str, tag: str, key: str):
        src = F.col(tag) if level == "trace" else F.col("_ev")[tag]
        named = F.filter(F.coalesce(src, F.array().cast(_ATTR)), lambda a: a["_key"] == F.lit(key))
        return F.try_element_at(named, F.lit(-1))["_value"]

    def column(level: str, key: str, tags: list[str]):
        if len(tags) == 1:
            return _typed(value(level, tags[0], key), tags[0])
        values = [value(level, t, key) for t in tags]
        if set(tags) <= {"int", "float"}:
            return F.coalesce(*[v.try_cast("double") for v in values])
        return F.coalesce(*values)

    def columns(level: str, found: list, prefix: str) -> list:
        tags: dict[str, list[str]] = {}
        for tag, key in sorted(found):
            tags.setdefault(key, []).append(tag)
        return [column(level, key, tags[key]).alias(prefix + key) for key in sorted(tags)]

    return (events.select(*columns("trace", trace_keys, "case:"), *columns("event", event_keys, ""))
            .withColumn("_event_index", F.monotonically_increasing_id()))


def read_log(spark: SparkSession, path: str, **kw) -> DataFrame:
    fmt = detect_format(path)
    if fmt == "csv":
        return read_csv_log(spark, path, **kw)
    if fmt == "parquet":
        return read_parquet_log(spark, path)
    return read_xes_log(spark, path)
