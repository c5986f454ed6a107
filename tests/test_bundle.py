"""A saved bundle scores like the objects it was saved from."""

import pytest

from caseflow.operators import models as mdl
from caseflow.operators.bucketing import make_bucketer
from caseflow.operators.encoding import ENCODERS, fit_encoder
from caseflow.operators.prefixes import extract_prefixes
from caseflow.plans.scoring import score_running_cases, score_with_bundle
from caseflow.sources import testlogs
from caseflow.sources.sinks import append_results, save_bundle

SF = "/root/testdata/sf0.001"
PAIRS = list(zip(ENCODERS, ["prefix_len_bins", "last_activity", "cluster", "prefix_len_adaptive"]))


@pytest.mark.parametrize("encoding, bucketing", PAIRS)
def test_bundle_alone_gives_the_same_predictions(spark, tmp_path, encoding, bucketing):
    log = testlogs.user_log(spark, SF)
    frame = extract_prefixes(log, include_event_attributes=False).persist()
    task = mdl.default_task_specs()["remaining_time"]
    bucketer, encoder = make_bucketer(bucketing).fit(frame), fit_encoder(encoding, frame)
    data = encoder.transform(bucketer.assign(frame)).selectExpr("*", "'train' as split").persist()
    ids = [r[0] for r in data.select("bucket_id").distinct().orderBy("bucket_id").collect()][:2]
    models, _ = mdl.train_per_bucket(data, ids, task, "linear", target_log1p=True)
    save_bundle(str(tmp_path / "b"), models, {"task": task.name, "bucketing": bucketing, "encoding": encoding,
                                              "target_log1p": True}, encoder, bucketer)
    key = lambda r: (r.case_id, r.model_bucket, round(r.prediction, 3))
    mine = sorted(map(key, score_running_cases(log, bucketer, encoder, models, task, True).collect()))
    assert sorted(map(key, score_with_bundle(log, str(tmp_path / "b")).collect())) == mine
    assert len(mine) == log.select("case_id").distinct().count()


def test_append_results_resumes(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "log string, n int")
    append_results(rows, path, ["log"])
    append_results(rows.union(spark.createDataFrame([("c", 3)], "log string, n int")), path, ["log"])
    assert sorted(r.log for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_uploaded_log_with_errors(spark, tmp_path):
    from caseflow.plans.scoring import score_uploaded_log
    log = testlogs.user_log(spark, SF)
    frame = extract_prefixes(log, include_event_attributes=False).persist()
    task = mdl.default_task_specs()["remaining_time"]
    bucketer, encoder = make_bucketer("no_bucket").fit(frame), fit_encoder("last_state", frame)
    models, _ = mdl.train_per_bucket(encoder.transform(bucketer.assign(frame)).selectExpr("*", "'train' as split"), [],
                                     task, "linear")
    save_bundle(str(tmp_path / "b"), models, {"task": task.name, "bucketing": "no_bucket", "encoding": "last_state"},
                encoder, bucketer)
    raw = log.selectExpr("case_id as CaseID", "activity as Activity", "cast(timestamp as string) as `event_time`", "value",
                         "prop_k")
    bad = spark.createDataFrame([("zz", "A", "no time", 1.0, 1)], raw.schema)
    got = {r.case_id: r for r in score_uploaded_log(raw.union(bad), str(tmp_path / "b")).collect()}
    assert got["zz"].error and got["zz"].prediction is None
    assert all(r.prediction is not None and r.error is None for c, r in got.items() if c != "zz")


def test_parse_activities_like_text_and_json(spark):
    from caseflow.functions.scalar import parse_activities
    texts = {'["A", "B c"]': ["A", "B c"], '"A, B"': ['"A, B"'], "A, ,B": ["A", "", "B"], "A; B ;C": ["A", "B", "C"],
             "A;B,C": ["A;B", "C"], " A ": ["A"], "12": ["12"], "": [], "[broken": ["[broken"]}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: r.a for r in df.select("t", parse_activities("t").alias("a")).collect()}
    assert got == texts | {None: []}


@pytest.mark.parametrize("name", ["last_state", "aggregation", "index_latest_payload", "embedding"])
def test_encoders_of_bounded_state_equal_those_of_the_list(spark, make_log, name):
    """A running case's state encodes to the vector that its whole list of activities gives."""
    from pyspark.ml.functions import vector_to_array

    from caseflow.operators.encoding import fit_encoder
    from caseflow.operators.prefixes import extract_prefixes, running_case_prefixes, running_case_state
    rows = [(f"c{c}", "ABCD"[(c * k + k) % 4], 60 * k * (c + 1), 100 * c + k, float(c)) for c in range(12) for k in range(3 + c)]
    log = make_log(rows, ["cost"], ["double"])
    train = extract_prefixes(log.where("activity != 'D'"))  # D is unseen
    enc = fit_encoder(name, train, min_freq=1)
    of_list = enc.transform(running_case_prefixes(log))
    of_state = enc.transform(running_case_state(log, enc.state.get("max_len") or 1))
    a, b = ({r[0]: r[1] for r in d.select("case_id", vector_to_array("features")).collect()} for d in (of_list, of_state))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_one_pass_models_in_a_bundle(spark, make_log, tmp_path):
    from pyspark.sql import functions as F

    from caseflow.operators.bucketing import PrefixLenBins
    from caseflow.operators.encoding import fit_encoder, label_vocabulary
    from caseflow.operators.least_squares import fit_buckets
    from caseflow.operators.prefixes import extract_prefixes
    from caseflow.plans.scoring import score_with_bundle
    from caseflow.sources.sinks import save_bundle
    rows = [(f"c{c}", "ABCD"[(c + k) % 4], 3600 * k, 100 * c + k) for c in range(30) for k in range(4 + c % 5)]
    log = make_log(rows)
    pre = extract_prefixes(log)
    bk = PrefixLenBins(bin_size=3).fit(pre)
    lv = label_vocabulary(pre, "label_next_activity")
    enc = fit_encoder("last_state", pre, "label_next_activity", False, label_vocab=lv, min_freq=1)
    save_bundle(str(tmp_path / "c"), fit_buckets(enc.transform(bk.assign(pre)), len(lv)),
                {"task": "next_activity", "bucketing": bk.name, "encoding": enc.name, "label_vocab": lv}, enc, bk)
    got = score_with_bundle(log, str(tmp_path / "c")).collect()
    assert len(got) == 30 and {r.prediction for r in got} <= set(lv) and all(0 < r.probability <= 1 for r in got)
    enc = fit_encoder("aggregation", pre, min_freq=1)
    save_bundle(str(tmp_path / "r"), fit_buckets(enc.transform(bk.assign(pre)), target_log1p=True),
                {"task": "remaining_time", "bucketing": bk.name, "encoding": enc.name, "target_log1p": True}, enc, bk)
    out = score_with_bundle(log, str(tmp_path / "r"))
    assert out.count() == 30 and out.where(F.abs(F.col("prediction") / 86400 - F.col("prediction_days")) > 1e-9).count() == 0
