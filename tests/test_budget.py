"""The search under a budget finds the full grid's winner, keeps to its budget and refits on every train row."""

import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from caseflow.operators import models as mdl
from caseflow.plans.budget import Learner, Ridge, bucket_budget, budgeted_search

TASK = mdl.default_task_specs()["remaining_time"]
GRID = [Ridge(setting={"alpha": a}) for a in (1e7, 1.0, 1e5)] + [Learner("linear", {"alpha": 1e6})]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(f"c{i}", [x := rng.random() * 10, rng.random()], 1e5 + 9e4 * x + rng.gauss(0, 1e3), float(1 + (x > 5)))
            for i in range(900) for _ in range(2)]
    return spark.createDataFrame(data, "case_id string, x array<double>, label double, c double") \
        .withColumn("features", array_to_vector("x")).persist()


def test_the_winner_of_the_full_grid_is_found_and_refitted(rows):
    got = budgeted_search(rows, TASK, GRID, keep=2)
    trials = got.trials.orderBy("trial").collect()
    assert [(t.rung, t.share) for t in trials] == [(1, 0.25)] * 4 + [(2, 0.5)] * 2 + [(3, 1.0)]
    assert all(t.status == "scored" and t.score > 0 for t in trials)
    sizes = [t.n_rows for t in trials]
    assert sizes == sorted(sizes) and sizes[0] < sizes[4] < sizes[6] < 1800 and all(n % 2 == 0 for n in sizes)  # whole cases
    one_rung = [budgeted_search(rows, TASK, [x]).score for x in GRID]
    assert got.learner is GRID[1] and one_rung.index(min(one_rung)) == 1 and got.score == pytest.approx(one_rung[1])
    assert got.model.first()["n"] == 1800


def test_fits_and_seconds_are_kept_to(rows):
    got = budgeted_search(rows, TASK, GRID, max_fits=3, keep=2)
    assert [t.status for t in got.trials.orderBy("trial").collect()] == ["scored"] * 3 + ["skipped"] * 4  # 4, 2 and 1 candidates
    assert got.learner is GRID[1]
    late = budgeted_search(rows, TASK, GRID, max_seconds=0, keep=2)
    assert late.trials.where("status = 'scored'").count() == 1 and late.learner is GRID[0]
    assert bucket_budget(600, 4) == 150 and bucket_budget(60, 40) == 30 and bucket_budget(60, 0) == 60


def test_classes_and_nothing_to_learn_from(rows):
    task = mdl.default_task_specs()["next_activity"]
    got = budgeted_search(rows.withColumn("label", F.col("c")), task, [Ridge(), Learner("tree", {"maxDepth": 2, "numTrees": 5})],
                          n_classes=2)
    assert got.score > 0.9
    none = budgeted_search(rows.withColumn("label", F.lit(None).cast("double")), TASK, GRID)
    assert none.model is None and none.score is None
    assert {t.status for t in none.trials.collect()} == {"empty"}
