"""Learners read the encoded rows as seldom, and keep as little of them, as they can."""

import pytest
from pyspark.ml.linalg import Vectors

from caseflow.operators import models


@pytest.fixture
def encoded(spark):
    rows = [(f"c{i // 4}", i % 4 + 1, ["a long activity"] * 20, Vectors.dense([i % 7, i % 3]), float(i % 3)) for i in range(240)]
    return spark.createDataFrame(rows, ["case_id", "prefix_len", "prefix_activities", "features", "label"]).coalesce(1)


def test_tuned_model_keeps_features_and_labels_only(encoded, monkeypatch):
    kept, plain = [], type(encoded).persist
    monkeypatch.setattr(type(encoded), "persist", lambda df, *a: kept.append(df.columns) or plain(df, *a))
    for name, settings in (("remaining_time", {"linear": [{"alpha": 1.0}]}), ("next_activity", {"tree": [{"maxDepth": 2}]})):
        _, score, kind, _ = models.tuned_model(encoded, models.default_task_specs()[name], settings)
        assert kind in settings and score >= 0
    assert [c for c in kept if "features" in c] == [["features", "label"]] * 4


def test_classes_are_counted_for_boosted_trees_only(encoded, monkeypatch):
    counted, plain = [], type(encoded).distinct
    monkeypatch.setattr(type(encoded), "distinct", lambda df: counted.append(df.columns) or plain(df))
    task = models.default_task_specs()["next_activity"]
    _, pred = models.fit_predict(encoded, encoded, task, "tree")
    assert not counted
    right = pred.where("y_true = y_pred").count()
    assert right == 240  # the second feature is the label


def test_forest_reads_encoded_rows_once(spark, encoded):
    read = spark.sparkContext.accumulator(0)

    def counted(row):
        read.add(1)
        return row
    rows = spark.createDataFrame(encoded.rdd.map(counted), encoded.schema)
    for n, name in enumerate(("remaining_time", "next_activity"), 1):
        model, _ = models.fit_predict(rows, rows, models.default_task_specs()[name], "tree")
        assert model.getNumTrees == 100 and read.value == n * 240
    assert not [i for i in spark.sparkContext._jsc.getPersistentRDDs().values()
                if i.getStorageLevel().useDisk() and not i.getStorageLevel().useMemory()]


def test_kept_nodes_give_the_same_forest(encoded):
    est = models.make_estimator("tree", models.default_task_specs()["remaining_time"])
    assert est.getCacheNodeIds()
    walked = est.copy({est.cacheNodeIds: False})
    assert est.fit(encoded).toDebugString == walked.fit(encoded).toDebugString


def test_a_frame_for_last_state_gathers_no_lists_of_activities(spark, monkeypatch):
    from caseflow.plans import catalog
    tried, plain = [], models.tuned_model
    monkeypatch.setattr(models, "tuned_model", lambda data, task: tried.append(data.columns) or plain(data, task, {"linear": [{"alpha": 1.0}]}))
    (r,) = catalog.q_tuned_model(spark, "/root/testdata/sf0.001").collect()
    assert r.estimator == "linear" and r.val_mae > 0
    assert "prefix_activities" not in tried[0] and "features" in tried[0]
    assert catalog.model_frame(spark, "/root/testdata/sf0.001").columns.count("prefix_activities") == 1
