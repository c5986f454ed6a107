from pyspark.sql import functions as F

from caseflow.operators import labels, prefixes
from caseflow.operators.splits import split_cases


def test_prefix_rows_and_labels(make_log):
    rows = [("c1", "A", 0, 1), ("c1", "B", 10, 2), ("c1", "C", 30, 3), ("c2", "X", 0, 4)]
    p = prefixes.extract_prefixes(make_log(rows)).orderBy("prefix_len").collect()
    assert [r["prefix_len"] for r in p] == [1, 2]
    assert p[0]["prefix_activities"] == ["A"] and p[1]["prefix_activities"] == ["A", "B"]
    assert [r["label_next_activity"] for r in p] == ["B", "C"]
    assert [r["label_remaining_time_sec"] for r in p] == [30.0, 20.0]
    assert [r["feat_time_since_last_event_sec"] for r in p] == [0.0, 10.0]
    assert [r["feat_elapsed_time_sec"] for r in p] == [0.0, 10.0]


def test_ties_follow_index(make_log):
    rows = [("c", "C", 0, 3), ("c", "A", 0, 1), ("c", "B", 0, 2), ("c", "D", 1, 4)]
    p = prefixes.extract_prefixes(make_log(rows)).orderBy("prefix_len").collect()
    assert p[-1]["prefix_activities"] == ["A", "B", "C"]


def test_last_non_null_and_policies(make_log):
    rows = [("c", "A", 0, 1, None), ("c", "B", 1, 2, "3"), ("c", "C", 2, 3, None), ("c", "D", 3, 4, None)]
    log = make_log(rows, ["x"])
    lnn = [r["event_last__x"] for r in prefixes.extract_prefixes(log).orderBy("prefix_len").collect()]
    last = [r["event_last__x"] for r in prefixes.extract_prefixes(log, event_agg_policy="last").orderBy("prefix_len").collect()]
    assert lnn == [None, "3", "3"] and last == [None, "3", None]


def test_case_attributes_first_non_null(make_log):
    rows = [("c", "A", 0, 1, None), ("c", "B", 1, 2, "gold"), ("c", "C", 2, 3, "silver")]
    p = prefixes.extract_prefixes(make_log(rows, ["case:tier"])).collect()
    assert {r["case__tier"] for r in p} == {"gold"}


def test_prefix_count_invariant(make_log):
    rows = [(f"c{c}", "A", i, 100 * c + i) for c in range(1, 8) for i in range(c * 6)]
    log = make_log(rows)
    expected = sum(max(0, min(30, c * 6 - 1)) for c in range(1, 8))
    assert prefixes.extract_prefixes(log).count() == expected
    assert prefixes.extract_prefixes(log, max_prefix_len=3, min_prefix_len=2).count() == 7 * 2


def test_case_table_outcome_and_end(make_log):
    rows = [("c", "A", 0, 1, "ok", None), ("c", "B", 5, 2, None, "2024-01-02 00:00:00"), ("d", "A", 0, 3, "bad", None)]
    t = labels.case_table(make_log(rows, ["status", "case:endDate"]), outcome_col="status", outcome_values="ok")
    r = {x["case_id"]: x for x in t.collect()}
    assert r["c"]["label_outcome"] == "ok" and r["d"]["label_outcome"] == "Other"
    assert r["c"]["case_end_time"].day == 2


def test_running_case_uses_latest_event(make_log):
    rows = [("c", a, i * 10, i) for i, a in enumerate("ABCDE")]
    r = prefixes.running_case_prefixes(make_log(rows), max_prefix_len=3).first()
    assert r["prefix_len"] == 5 and r["prefix_activities"] == ["C", "D", "E"]
    long = make_log([("c", f"a{i}", i * 10, i) for i in range(40)])
    assert prefixes.running_case_prefixes(long).first()["prefix_activities"] == [f"a{i}" for i in range(40)]
    assert r["feat_elapsed_time_sec"] == 40.0 and r["feat_time_since_last_event_sec"] == 10.0


def test_split_no_leak_and_sizes(make_log):
    rows = [(f"c{i:03d}", "A", 0, i) for i in range(200)]
    s = split_cases(make_log(rows))
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 140, "val": 30, "test": 30}
    assert s.groupBy("case_id").count().where("count > 1").count() == 0
    t = split_cases(make_log(rows), temporal=True)
    assert t.where("split = 'train'").count() == 140


def test_remaining_time_non_negative(spark):
    from caseflow.sources import testlogs
    p = prefixes.extract_prefixes(testlogs.line_log(spark, "/root/testdata/sf0.001"))
    assert p.where(F.col("label_remaining_time_sec") < 0).count() == 0


def test_running_case_given_start(make_log, spark):
    import datetime as dt
    rows = [("c", "A", 100, 1), ("c", "B", 160, 2)]
    starts = spark.createDataFrame([("c", dt.datetime(2024, 1, 1))], "case_id string, case_start_time timestamp")
    r = prefixes.running_case_prefixes(make_log(rows), case_starts=starts).first()
    assert r["feat_elapsed_time_sec"] == 160.0
    r2 = prefixes.running_case_prefixes(make_log(rows)).first()
    assert r2["feat_elapsed_time_sec"] == 60.0
