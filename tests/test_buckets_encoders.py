import pytest
from pyspark.sql import functions as F

from caseflow.operators import bucketing, encoding, sampling
from caseflow.sources.aggregated import aggregated_to_events


def test_bins(spark):
    df = spark.createDataFrame([(k, "train") for k in range(1, 13)], "prefix_len int, split string")
    b, _ = bucketing.bucketize(df, bucketing.PrefixLenBins(bin_size=5, max_len=10))
    counts = {r["bucket_id"]: r["count"] for r in b.groupBy("bucket_id").count().collect()}
    assert counts == {1: 5, 2: 7}


def test_adaptive_edges(spark):
    df = spark.createDataFrame([(k, "train") for k in range(1, 11)], "prefix_len int, split string")
    m = bucketing.PrefixLenAdaptive().fit(df)
    assert m.edges_ == [1, 3, 5, 8, 10]
    got = [r["bucket_id"] for r in m.assign(df).orderBy("prefix_len").collect()]
    assert got == [1, 2, 2, 3, 3, 4, 4, 4, 5, 5]


def test_last_activity_unseen(spark):
    tr = spark.createDataFrame([(["A", "B"], "train"), (["A"], "train"), (["Z"], "test")],
                               "prefix_activities array<string>, split string")
    b, _ = bucketing.bucketize(tr, bucketing.LastActivity())
    got = {tuple(r["prefix_activities"]): r["bucket_id"] for r in b.collect()}
    assert got == {("A", "B"): 2, ("A",): 1, ("Z",): 3}


def test_target_encoding(spark):
    df = spark.createDataFrame([("0", 1.0), ("0", 3.0), ("1", 10.0)], "cat string, y double")
    te = {r["category"]: round(r["encoding"], 4) for r in encoding.target_encoding(df, "cat", "y").collect()}
    assert te == {"0": 2.8889, "1": 7.3333}


def test_rare_classes(spark):
    rows = [("A", "train")] * 12 + [("B", "train")] * 3 + [("C", "test"), ("A", "test")]
    df = spark.createDataFrame(rows, "label string, split string")
    out = sampling.filter_rare_classes(df, "label", 10)
    assert sorted({r["label"] for r in out.collect()}) == ["A"]
    no_b = df.where("label <> 'B'")
    assert sorted({r["label"] for r in sampling.filter_rare_classes(no_b, "label", 10).collect()}) == ["A", "C"]


def test_aggregated_to_events(spark):
    df = spark.createDataFrame([("1", "2024-01-01 00:00:00", 60.0, 2, None, 30.0)],
                               "id string, started string, wf_open double, wfe_open int, wf_done double, wf_test double")
    ev = aggregated_to_events(df).orderBy("_event_index").collect()
    base = ev[0]["timestamp"]
    assert [(r["activity"], (r["timestamp"] - base).total_seconds()) for r in ev] == [("open", 0), ("open", 30), ("test", 60)]


def test_vocab_caps_and_onehot(spark):
    rows = [(f"c{i}", 1, "train", v) for i, v in enumerate(["a"] * 5 + ["b"] * 3 + ["c"] * 1)]
    df = spark.createDataFrame(rows, "case_id string, prefix_len int, split string, event_last__x string")
    v = encoding.category_vocab(df, ["event_last__x"], min_freq=2, max_categories=1).collect()
    assert [(r["value"], r["slot"]) for r in v] == [("a", 1)]


def test_fit_encoder_feature_vector(spark):
    rows = [("c1", 1, "train", ["A"], 10.0, "x"), ("c1", 2, "train", ["A", "B"], 5.0, "y"),
            ("c2", 1, "val", ["B"], 7.0, "x")]
    df = spark.createDataFrame(rows, "case_id string, prefix_len int, split string, prefix_activities array<string>, "
                                     "label_remaining_time_sec double, event_last__x string")
    for name in encoding.ENCODERS:
        enc = encoding.fit_encoder(name, df.where("split = 'train'"), min_freq=1, max_prefix_len=3,
                                   vectors=spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.0, 1.0])],
                                                                 "activity string, embedding array<double>"))
        out = enc.transform(df)
        assert out.count() == 3 and "features" in out.columns
        assert len(out.first()["features"]) == enc.feature_dim


def test_index_latest_payload_modes(spark):
    rows = [("c1", 1, "train", ["A"], 10.0, "x"), ("c1", 2, "train", ["A", "B"], 5.0, "y"),
            ("c2", 1, "val", ["B"], 7.0, "z")]
    df = spark.createDataFrame(rows, "case_id string, prefix_len int, split string, prefix_activities array<string>, "
                                     "label_remaining_time_sec double, event_last__x string")
    tr = df.where("split = 'train'")
    lab = encoding.fit_encoder("index_latest_payload", tr, min_freq=1, max_prefix_len=2, categorical_encoding="label",
                               activity_encoding="counts")
    out = {r["case_id"] + str(r["prefix_len"]): list(r["features"]) for r in lab.transform(df).collect()}
    # [prefix_len, label slot of x (x=1, y=2, unseen=0), UNK count, A count, B count]
    assert out["c12"] == [2.0, 2.0, 0.0, 1.0, 1.0] and out["c21"] == [1.0, 0.0, 0.0, 0.0, 1.0]
    tgt = encoding.fit_encoder("index_latest_payload", tr, min_freq=1, max_prefix_len=2)
    assert tgt.feature_dim == 1 + 1 + 2  # prefix_len, target-encoded x, two positions


def test_blocks_do_not_grow_the_plan(spark):
    """Ten thousand activities: the plan is as long as for ten, and the vectors stay sparse."""
    rows = [("c1", 2, ["a1", "a7"], 1.0), ("c2", 3, ["a3", "never", "a3"], 2.0), ("c3", 1, [None], 2.0)]
    df = spark.createDataFrame(rows, "case_id string, prefix_len int, prefix_activities array<string>, "
                                     "label_remaining_time_sec double")
    size = {}
    for n in (10, 10_000):
        state = {"name": "aggregation", "num_cols": [], "cat_cols": [], "categorical": "onehot", "vocab": {},
                 "label_col": "label_remaining_time_sec", "label_is_numeric": True, "label_vocab": None,
                 "activities": [f"a{i}" for i in range(n)]}
        counted = encoding.build_encoder(state | {"activity": "counts"}).transform(df)
        placed = encoding.build_encoder(state | {"activity": "onehot_per_position", "max_len": 3}).transform(df)
        size[n] = [len(x._jdf.queryExecution().optimizedPlan().toString()) for x in (counted, placed)]
    assert all(big < 1.2 * small for small, big in zip(size[10], size[10_000]))
    of = {r["case_id"]: r["features"] for r in counted.collect()}
    got = {c: dict(zip(v.indices.tolist(), v.values.tolist())) for c, v in of.items()}
    # prefix_len, unknown, a0, a1, ...
    assert got == {"c1": {0: 2.0, 3: 1.0, 9: 1.0}, "c2": {0: 3.0, 1: 1.0, 5: 2.0}, "c3": {0: 1.0, 1: 1.0}}
    of = {r["case_id"]: r["features"] for r in placed.collect()}
    got = {c: dict(zip(v.indices.tolist(), v.values.tolist())) for c, v in of.items()}
    unknown = 1 + 3 * 10_000  # the three positions' unknown slots come last
    assert got["c1"] == {0: 2.0, 1 + 1: 1.0, 1 + 10_000 + 7: 1.0, unknown + 2: 1.0}
    assert got["c2"] == {0: 3.0, 1 + 3: 1.0, 1 + 20_000 + 3: 1.0, unknown + 1: 1.0}
    assert got["c3"] == {0: 1.0, unknown: 1.0, unknown + 1: 1.0, unknown + 2: 1.0}


def test_state_and_list_give_one_vector(spark):
    """A running case's counts and the whole list of its activities are encoded alike."""
    rows = [("c1", 4, ["a", "b", "a", "new"], {"a": 2, "b": 1, "new": 1}, "new")]
    whole = spark.createDataFrame(rows, "case_id string, prefix_len int, prefix_activities array<string>, "
                                        "activity_counts map<string,int>, last_activity string")
    base = {"name": "x", "num_cols": [], "cat_cols": [], "categorical": "onehot", "vocab": {}, "label_col": "y",
            "label_is_numeric": True, "label_vocab": None}
    for more in ({"activity": "counts", "activities": ["a", "b", "c"]},
                 {"activity": "vectors", "vectors": {"a": [1.0, 0.0], "b": [0.0, 3.0]}}):
        enc = encoding.build_encoder(base | more)
        of_state = enc.transform(whole).first()["features"].toArray().tolist()
        of_list = enc.transform(whole.drop("activity_counts", "last_activity")).first()["features"].toArray().tolist()
        assert of_state == pytest.approx(of_list) and len(of_list) == enc.feature_dim


def test_entries_of_sparse_and_dense_vectors(spark):
    from pyspark.ml.linalg import Vectors
    from caseflow.operators.sparse import entries_long
    df = spark.createDataFrame([(1, Vectors.dense([0.0, 2.0])), (2, Vectors.sparse(2, {0: 5.0})), (3, Vectors.sparse(2, {}))],
                               ["k", "features"])
    got = {(r["k"], r["feature"], r["value"]) for r in entries_long(df, ["x", "y"], ["k"]).collect()}
    assert got == {(1, "y", 2.0), (2, "x", 5.0)}


def test_embedding_of_values_skips_dates(spark):
    rows = [("c1", 1, ["A"], 1.0, "red", "2015-03-01", "12:30:00Z"), ("c2", 1, ["B"], 2.0, "reds", "2015-04-01", "T08:00:00+01:00"),
            ("c3", 1, ["A"], 3.0, None, "unknown", None)] + [(f"d{k}", 1, ["A"], 1.0, "red", f"2016-01-{10 + k}", None) for k in range(8)]
    df = spark.createDataFrame(rows, "case_id string, prefix_len int, prefix_activities array<string>, label_remaining_time_sec double, "
                                     "event_last__color string, event_last__day string, event_last__time string")
    facts = {r["column"]: r["skipped"] for r in
             encoding.column_facts(df, ["event_last__color", "event_last__day", "event_last__time"]).collect()}
    assert facts == {"event_last__color": None, "event_last__day": "date_like", "event_last__time": "date_like"}
    assert encoding.column_facts(df, ["event_last__day"], most=1, share=1.0).first()["skipped"] == "many_values"
    lookup = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.0, 1.0])], "activity string, embedding array<double>")
    enc = encoding.fit_encoder("embedding", df, vectors=lookup, value_dim=8)
    assert list(enc.state["value_vectors"]) == ["event_last__color"] and enc.feature_dim == 1 + 2 * 2 + 8
    got = {r["case_id"]: r["features"].toArray() for r in enc.transform(df).collect()}
    known = enc.state["value_vectors"]["event_last__color"]
    assert got["c1"][5:].tolist() == known["red"] and sum(x * x for x in known["red"]) == pytest.approx(1.0)
    assert got["c3"][5:].tolist() == pytest.approx([(a + b) / 2 for a, b in zip(known["red"], known["reds"])])


def test_mean_and_last_vectors_are_added_up_where_the_prefix_is(spark):
    from caseflow.operators import encoding as enc
    rows = [("a", 1, ["x"]), ("a", 2, ["x", "y"]), ("b", 3, ["z", "x", "y"]), ("b", 4, ["y", "w", None, "x"]), ("d", 1, []),
            ("e", 1, ["x"]), ("e", 1, ["y", "y"])]
    df = spark.createDataFrame(rows, "case_id string, prefix_len int, prefix_activities array<string>").repartition(3)
    vectors = spark.createDataFrame([("x", [1.0, 4.0]), ("y", [3.0, -2.0]), ("y", [5.0, 0.0]), ("w", None)],
                                    "activity string, embedding array<double>")
    got = enc.embedding_mean_last_long(df, vectors)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("posexplode") == 1  # one row for each prefix moves, none for each activity
    assert plan.index("Generate") < plan.index("ArrowEvalPython")  # vectors are taken apart after the function, which runs once a prefix
    key = lambda r: (r.case_id, r.prefix_len, r.dim)
    want = {key(r): r for r in enc._mean_last_joined(df, vectors, "prefix_activities").collect()}
    assert len(want) == 10 and {key(r) for r in got.collect()} == set(want)
    for r in got.collect():
        assert r.mean_value == pytest.approx(want[key(r)].mean_value)
        if r.prefix_len in (1, 4) and r.case_id != "e":  # of several vectors of one activity any may be the last
            assert r.last_value == pytest.approx(want[key(r)].last_value)
