"""The grid of several tasks: what they share is done once, and each task scores as if it were searched alone."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caseflow.operators import prefixes
from caseflow.operators.models import default_task_specs
from caseflow.plans import strategy


def frame(spark):
    rng, t0, rows = random.Random(5), dt.datetime(2024, 1, 1), []
    for c in range(60):
        t = t0
        for i in range(rng.randrange(3, 7)):
            t += dt.timedelta(hours=rng.randrange(1, 40))
            rows.append((f"c{c}", rng.choice("ABC"), t, i, rng.random() * 100, rng.choice(["x", "y"])))
    log = spark.createDataFrame(rows, "case_id string, activity string, timestamp timestamp, _event_index bigint, price double, kind string")
    pre = prefixes.extract_prefixes(log).withColumn("label_outcome", F.when(F.crc32("case_id") % 2 == 0, "1").otherwise("0"))
    return pre.withColumn("split", F.when(F.crc32("case_id") % 3 == 0, "val").otherwise("train")).persist()


def test_tasks_share_buckets_and_features(spark, monkeypatch):
    data, tasks = frame(spark), list(default_task_specs().values())
    bucketers, encodings, fitted, buckets = ["no_bucket", "prefix_len_bins"], ["aggregation", "index_latest_payload"], [], []
    fit, make = strategy.fit_encoder, strategy.make_bucketer
    monkeypatch.setattr(strategy, "fit_encoder", lambda name, *a, **kw: fitted.append(name) or fit(name, *a, **kw))
    monkeypatch.setattr(strategy, "make_bucketer", lambda name, **kw: buckets.append(name) or make(name, **kw))
    got = {(r.task, r.bucketing, r.encoding): r for r in strategy.compare_tasks(data, tasks, bucketers, encodings, min_bucket_samples=5).collect()}
    assert buckets == bucketers  # not once for each task
    assert sorted(fitted) == ["aggregation", "index_latest_payload", "index_latest_payload"]  # a target encoding is the regression's own
    assert len(got) == 12
    for task in tasks:
        alone = strategy.strategy_search(data, task, bucketers, encodings, "ridge", 5, target_log1p=task.task_type == "regression").collect()
        assert len(alone) == 4
        for r in alone:
            one = got[r.task, r.bucketing, r.encoding]
            assert (one.rank, one.feature_dim, one.n_models) == (r.rank, r.feature_dim, r.n_models)
            assert one.primary_score == pytest.approx(r.primary_score, rel=1e-6)
