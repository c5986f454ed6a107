from pyspark.sql import functions as F

from caseflow.operators import filters, schema
from caseflow.operators.lifecycle import lifecycle_collapse


def idx(df):
    return sorted(r["_event_index"] for r in df.select("_event_index").collect())


def test_dedup_keep_first_last_none(make_log):
    log = make_log([("c1", "A", 0, 1), ("c1", "A", 0, 2), ("c1", "B", 1, 3)])
    assert idx(filters.deduplicate_events(log)) == [1, 3]
    assert idx(filters.deduplicate_events(log, keep="last")) == [2, 3]
    assert idx(filters.deduplicate_events(log, keep="none")) == [3]
    s = filters.dedup_stats(log).first()
    assert (s["n_rows"], s["n_dropped"], s["n_dup_groups"], s["max_group_size"]) == (3, 1, 1, 2)


def test_dedup_nulls_are_equal(make_log):
    log = make_log([("c1", "A", 0, 1, None), ("c1", "A", 0, 2, None)], ["org:resource"])
    assert idx(filters.deduplicate_events(log)) == [1]


def test_consecutive_duplicates(make_log):
    rows = [("c1", a, i, i) for i, a in enumerate("AABBBC")] + [("c2", a, i, 10 + i) for i, a in enumerate("ABA")]
    out = filters.filter_consecutive_duplicates(make_log(rows))
    assert idx(out) == [0, 2, 5, 10, 11, 12]


def test_repair_timestamps(make_log):
    rows = [("c", "A", t, i) for i, t in enumerate([0, 5, 3, 4, 9])]
    log = make_log(rows)
    ff = schema.repair_timestamps(log, "forward_fill").orderBy("_event_index").collect()
    assert [(r["timestamp"] - ff[0]["timestamp"]).total_seconds() for r in ff] == [0, 5, 5, 5, 9]
    assert idx(schema.repair_timestamps(log, "drop")) == [0, 1, 3, 4]


def test_short_and_zero_duration(make_log):
    log = make_log([("one", "A", 0, 1), ("z", "A", 5, 2), ("z", "B", 5, 3), ("z", "C", 5, 4),
                    ("ok", "A", 0, 5), ("ok", "B", 9, 6)])
    assert sorted({r[0] for r in filters.filter_short_cases(log, 2).select("case_id").collect()}) == ["ok", "z"]
    assert sorted({r[0] for r in filters.filter_zero_duration_cases(log).select("case_id").collect()}) == ["ok"]


def test_normalize_activities(make_log):
    log = make_log([("c", " A ", 0, 1), ("c", "", 1, 2), ("c", None, 2, 3), ("c", "nan", 3, 4), ("c", "None", 4, 5)])
    out = [r[0] for r in schema.normalize_activities(log).orderBy("_event_index").select("activity").collect()]
    assert out == ["A", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_clean_events_drops_null_time_and_case(make_log):
    log = make_log([("c", "A", None, 1), (None, "A", 1, 2), ("c", None, 2, 3)])
    out = schema.clean_events(log).collect()
    assert [(r["_event_index"], r["activity"]) for r in out] == [(3, "UNKNOWN")]


def test_normalize_schema_picks_fewest_nulls(spark):
    df = spark.createDataFrame([(None, "1", "A", "2024-01-01 00:00:00"), ("x", "2", "B", "bad")],
                               "CaseID string, trace_id string, Activity string, time string")
    m = schema.pick_columns(df)
    assert m == {"case_id": "trace_id", "activity": "Activity", "timestamp": "time"}
    out = schema.normalize_schema(df).orderBy("case_id").collect()
    assert out[1]["timestamp"] is None and "CaseID" in df.columns


def test_impute(make_log):
    log = make_log([("c", "A", 0, 1, 1.0, "x"), ("c", "A", 1, 2, None, None), ("c", "A", 2, 3, 3.0, "y"),
                    ("c", "A", 3, 4, 10.0, "x")], ["num", "cat"], ["double", "string"])
    out = schema.impute_missing_attributes(log).where("_event_index = 2").first()
    assert out["num"] == 3.0 and out["cat"] == "x"


def test_infrequent_activities(make_log):
    # threshold = max(1, int(0.005 * 500)) = 2 cases
    rows = [(f"c{i}", "A", 0, i) for i in range(500)] + [("c0", "RARE", 1, 1000)]
    out = filters.filter_infrequent_activities(make_log(rows), 0.005)
    assert out.where("activity = 'RARE'").count() == 0 and out.count() == 500
    assert out.columns == ["case_id", "activity", "timestamp", "_event_index"]


def test_rare_variants(make_log):
    rows = []
    for i in range(5):
        rows += [(f"a{i}", "A", 0, 10 * i), (f"a{i}", "B", 1, 10 * i + 1)]
    rows += [("odd", "B", 0, 100), ("odd", "A", 1, 101)]
    out = filters.filter_rare_variants(make_log(rows), 5)
    assert out.where("case_id = 'odd'").count() == 0 and out.count() == 10


def test_lifecycle_collapse(make_log):
    rows = [("c", "A", 0, 1, "start"), ("c", "A", 1, 2, "complete"), ("c", "A", 2, 3, "start"),
            ("c", "A", 3, 4, "complete"), ("c", "B", 4, 5, "complete")]
    log = make_log(rows, ["lifecycle:transition"])
    occ = lifecycle_collapse(log, use_event_id=False).orderBy("_event_index").collect()
    assert [(r["activity"], r["_occurrence"], r["_event_index"]) for r in occ] == [("A", 1, 2), ("A", 2, 4), ("B", 3, 5)]
    with_id = log.withColumn("EventID", F.when(F.col("_event_index") <= 2, "e1").otherwise(None))
    out = lifecycle_collapse(with_id).collect()
    assert [r["_event_index"] for r in out] == [2]


def test_lifecycle_filters(make_log):
    log = make_log([("c", "A", 0, 1, " Start"), ("c", "A", 1, 2, "COMPLETE "), ("c", "B", 2, 3, None)],
                   ["lifecycle:transition"])
    assert idx(filters.lifecycle_keep(log, ["complete"])) == [2]
    assert idx(filters.lifecycle_drop(log, [" Start"])) == [2, 3]


def test_parse_activities_like_a_json_reader(spark):
    """Texts and their lists written out by hand: what a JSON reader gives, else split text."""
    from caseflow.functions.scalar import parse_activities
    cases = [('["a", "b"]', ["a", "b"]), ('"a\\"b,c"', ['"a\\"b,c"']), ("[true, false, null, 7]", ["True", "False", "None", "7"]),
             ('["tr\\u00fce", "x,y"]', ["trüe", "x,y"]), ("true", ["true"]), ("12.5", ["12.5"]), ("a, b ,", ["a", "b", ""]), ("a;b", ["a", "b"]),
             ('"a', ['"a']), ("", []), (None, []), ("[1, 2", ["[1", "2"]), ("[]", []), ('"x\\\\"', ['"x\\\\"']), (" a ", ["a"])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.a for r in df.select("i", parse_activities("t").alias("a")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]
