"""The chunked (hot-case) path of the ordered scans must equal the plain per-case window.

Small ``chunk_rows`` turns every multi-event case into a hot case split into
many chunks, which is the brute-force check for the skew path.
"""

from pyspark.sql import functions as F

from caseflow.operators import filters, schema
from caseflow.operators.lifecycle import with_occurrence
from caseflow.operators.sequence import ordered_scan
from caseflow.sources import testlogs

SF = "/root/testdata/sf0.001"


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_ordered_scan_chunked_equals_plain(spark):
    log = testlogs.user_log(spark, SF).withColumn("one", F.lit(1))
    kw = dict(lags={"p": "activity", "pt": "timestamp"}, running_max={"m": "value"}, running_sum={"s": "one"})
    assert same(ordered_scan(log, chunk_rows=None, **kw), ordered_scan(log, chunk_rows=3, **kw))
    kw2 = dict(lags={"p": "activity"}, running_max={"m": "timestamp"})
    assert same(ordered_scan(log, ["_event_index"], chunk_rows=None, **kw2),
                ordered_scan(log, ["_event_index"], chunk_rows=2, **kw2))


def test_ordered_scan_chunked_equals_plain_with_null_and_odd_keys(spark):
    i = F.col("_event_index")
    log = (testlogs.user_log(spark, SF).withColumn("one", F.when(i % 3 == 0, 1))
           .withColumn("timestamp", F.when(i % 7 != 0, F.col("timestamp")))
           .withColumn("real", F.when(i % 5 == 0, float("nan")).when(i % 5 == 1, float("-inf"))
                       .when(i % 5 != 2, F.col("value")))
           .withColumn("name", F.when(i % 4 != 0, F.col("activity"))))
    for first in ("timestamp", "real", "name"):
        kw = dict(order=[first, "_event_index"], lags={"p": "activity", "pt": "timestamp"}, running_max={"m": "value"},
                  running_sum={"s": "one"})
        assert same(ordered_scan(log, chunk_rows=None, **kw), ordered_scan(log, chunk_rows=3, **kw)), first
    plain, chunked = (filters.filter_consecutive_duplicates(log.drop("real"), n) for n in (None, 4))
    assert same(plain, chunked)


def test_operators_chunked_equal_plain(spark):
    log = testlogs.user_log(spark, SF)
    assert same(filters.filter_consecutive_duplicates(log, None), filters.filter_consecutive_duplicates(log, 4))
    assert same(schema.repair_timestamps(log, "forward_fill", None), schema.repair_timestamps(log, "forward_fill", 4))
    assert same(schema.repair_timestamps(log, "drop", None), schema.repair_timestamps(log, "drop", 4))
    lc = log.withColumn("lifecycle:transition", F.when(F.col("activity") == "view", "start").otherwise("complete"))
    assert same(with_occurrence(lc, chunk_rows=None), with_occurrence(lc, chunk_rows=3))
    day = testlogs.user_day_log(spark, SF)
    assert same(filters.filter_rare_variants(day, 2, None), filters.filter_rare_variants(day, 2, 1))


def test_variant_ids_match_variant_text(spark):
    day = testlogs.user_day_log(spark, SF)
    ids = filters.case_variant_ids(day).select("case_id", F.concat_ws(":", "n_events", "_vh1", "_vh2").alias("vid"))
    txt = filters.case_variants(day).select("case_id", "variant")
    j = ids.join(txt, "case_id")
    # the id <-> text relation is one-to-one
    assert j.groupBy("vid").agg(F.count_distinct("variant").alias("k")).where("k > 1").count() == 0
    assert j.groupBy("variant").agg(F.count_distinct("vid").alias("k")).where("k > 1").count() == 0


def test_distributed_quantiles_equal_percentile(spark):
    from caseflow.functions.quantiles import exact_quantiles
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    qs = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    a = exact_quantiles(df, "l_extendedprice", qs, small_rows=10 ** 9).first()
    b = exact_quantiles(df, "l_extendedprice", qs, small_rows=1).first()
    assert all(abs(a[i] - b[i]) < 1e-9 for i in range(len(qs)))


def test_grouped_distributed_quantiles_equal_percentile(spark):
    from caseflow.functions.quantiles import exact_quantiles_by
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    qs = [0.0, 0.5, 0.9, 1.0]
    a = {r["l_returnflag"]: r for r in exact_quantiles_by(df, ["l_returnflag"], "l_extendedprice", qs, 10 ** 9).collect()}
    b = {r["l_returnflag"]: r for r in exact_quantiles_by(df, ["l_returnflag"], "l_extendedprice", qs, 1).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert all(abs(a[k][f"q{i}"] - b[k][f"q{i}"]) < 1e-9 for i in range(len(qs)))


def test_grouped_quantiles_of_null_and_nan_groups(spark):
    """The large path keeps every group that the small path has, also null and NaN keys."""
    from caseflow.functions.quantiles import exact_quantiles_by
    rows = [(g, float(v)) for g in (None, 1.0, 2.0, float("nan")) for v in range(7)] + [(None, None)]
    df = spark.createDataFrame(rows, "g double, v double")
    small, large = (sorted(map(str, exact_quantiles_by(df, ["g"], "v", [0.1, 0.5, 0.9], n).collect())) for n in (10 ** 9, 1))
    assert small == large and len(small) == 4
