import pytest

from caseflow.operators.schema import detect_columns
from caseflow.sources.readers import detect_format
from caseflow.sources.sinks import sorted_for_sink


def test_detect_format():
    assert detect_format("a/log.CSV") == "csv"
    assert detect_format("x.parquet") == "parquet"
    assert detect_format("x.xes") == "xes" and detect_format("x.xes.gz") == "xes" and detect_format("y.gz") == "xes"
    with pytest.raises(ValueError):
        detect_format("x.json")


def test_detect_columns():
    m = detect_columns(["Process_Instance", "EVENT_TYPE", "Created_At", "v"])
    assert m == {"case_id": "Process_Instance", "timestamp": "Created_At", "activity": "EVENT_TYPE"}
    m = detect_columns(["CaseID", "Timestamp", "Activity"])
    assert m == {"case_id": "CaseID", "timestamp": "Timestamp", "activity": "Activity"}
    assert detect_columns(["case:concept:name", "time:timestamp", "concept:name"], "xes")["activity"] == "concept:name"


def test_sorted_for_sink(make_log):
    log = make_log([("b", "X", 5, 2), ("a", "Y", 9, 1), ("a", "Z", 1, 3), ("a", "W", 1, 0)])
    parts = sorted_for_sink(log, 1).rdd.glom().collect()
    rows = [(r["case_id"], r["_event_index"]) for p in parts for r in p]
    assert rows == [("a", 0), ("a", 3), ("a", 1), ("b", 2)]


def test_xes_keys_with_two_tags_or_repeated(spark, tmp_path):
    from caseflow.sources.readers import read_xes_log
    (tmp_path / "log.xes").write_text("""<log><trace><string key="concept:name" value="c"/><int key="x" value="1"/><string key="x" value="y"/>
<event><string key="concept:name" value="A"/><int key="cost" value="5"/></event>
<event><string key="concept:name" value="B"/><float key="cost" value="7.5"/><string key="note" value="1"/><string key="note" value="2"/></event>
</trace></log>""")
    rows = read_xes_log(spark, str(tmp_path / "log.xes")).orderBy("_event_index").collect()
    assert [(r["concept:name"], r["cost"], r["note"]) for r in rows] == [("A", 5.0, None), ("B", 7.5, "2")]
    assert [r["case:concept:name"] for r in rows] == ["c", "c"] and rows[0].__fields__.count("case:x") == 1
