"""Model search under a budget (MOD-5, UDF-5): successive halving over growing samples of cases.

Every candidate is a :class:`Learner`, so other learners join the search by
implementing its two methods.  The driver loop runs over candidates; each fit and
each score is a distributed job on cached rows.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.scalar import hash_unit, log1p_nonneg
from caseflow.operators.least_squares import fit_buckets, predict_buckets
from caseflow.operators.models import TaskSpec, balanced_weights, make_estimator, predict, ridge_penalty
from caseflow.plans.strategy import score_predictions, settled

TRIALS = ("trial int, rung int, share double, n_rows bigint, learner string, setting string, score double, "
          "status string, seconds double")


@dataclass
class Learner:
    """A candidate: ``fit`` returns a model of (features, label) rows, ``predict`` adds ``y_true`` and ``y_pred``.

    ``kind`` is one of :func:`make_estimator`'s, with ``alpha`` (linear penalty) or
    parameters of the Spark estimator in ``setting``.
    """
    kind: str
    setting: dict = field(default_factory=dict)

    def fit(self, rows: DataFrame, task: TaskSpec, n_classes: int, target_log1p: bool, seed: int):
        if n_classes:
            rows = balanced_weights(rows)
        elif target_log1p:
            rows = rows.withColumn("label", log1p_nonneg("label", null_as_zero=False))
        penalty = ridge_penalty(rows, task, self.setting.get("alpha", 1.0)) if self.kind == "linear" else 0.0
        # class ids start at 1, 0 is unknown
        est = make_estimator(self.kind, task, n_classes + 1, seed, penalty)
        return est.copy({est.getParam(k): v for k, v in self.setting.items() if k != "alpha"}).fit(rows)

    def predict(self, model, rows: DataFrame, task: TaskSpec, n_classes: int, target_log1p: bool) -> DataFrame:
        return predict(model, rows, task, target_log1p)


@dataclass
class Ridge(Learner):
    """The one-pass linear model (:mod:`caseflow.operators.least_squares`) with penalty ``alpha``."""
    kind: str = "ridge"

    def fit(self, rows, task, n_classes, target_log1p, seed):
        return fit_buckets(rows.withColumn("bucket_id", F.lit(0)), n_classes, self.setting.get("alpha", 1.0), target_log1p)

    def predict(self, model, rows, task, n_classes, target_log1p):
        return predict_buckets(rows.withColumn("bucket_id", F.lit(0)), model, n_classes, target_log1p)


def default_learners() -> list[Learner]:
    """Penalties of the one-pass linear model, and forests of two depths."""
    return [*(Ridge(setting={"alpha": a}) for a in (0.1, 1.0, 10.0, 1000.0)),
            *(Learner("tree", {"maxDepth": d, "numTrees": 20}) for d in (4, 8))]


def bucket_budget(total_seconds: float, n_buckets: int, least: float = 30.0) -> float:
    """Seconds for each of ``n_buckets`` searches: an equal share, and at least ``least``."""
    return max(least, total_seconds / max(1, n_buckets))


@dataclass
class SearchResult:
    """``trials``: a row for each fit asked for; ``learner`` and ``model``: the winner, refitted on all train rows."""
    trials: DataFrame
    learner: Learner
    score: float
    model: object


def budgeted_search(train: DataFrame, task: TaskSpec, learners: list[Learner] | None = None, max_fits: int = 50,
                    max_seconds: float = 600.0, keep: int = 3, folds: int = 5, n_classes: int = 0,
                    target_log1p: bool = False, seed: int = 42) -> SearchResult:
    """Successive halving: all candidates on a small share of the cases, the best ``1 / keep`` of them on ``keep`` times as many, until
    those left are fitted on all.

    ``train`` holds case_id, ``features`` and ``label``.  One case in ``folds`` is held out
    by a hash of its id, and every candidate is scored on all held-out rows by the task's
    metric; samples are nested and made of whole cases, by the same hash.  A fit is started
    only while fits and seconds are left; later ones are listed as ``skipped``, and the best
    candidate of the furthest rung that was scored wins (ties: the earlier candidate).  A
    candidate without rows to learn from, or without held-out rows, is ``empty``.  The
    first fit is always made; the refit of the winner on all of ``train`` is outside of the budget.
    """
    learners = learners or default_learners()
    rungs = max(1, math.ceil(math.log(len(learners), keep) - 1e-9) + 1)
    place = hash_unit(F.concat(F.lit("search:"), F.col("case_id").cast("string")), seed)
    rows = train.where(F.col("label").isNotNull()).withColumn("_place", place * folds).persist()
    held = rows.where("_place < 1").drop("_place")
    sign = -1.0 if task.higher_is_better else 1.0
    n_held, started, fits, trials, left, best = held.count(), time.time(), 0, [], list(range(len(learners))), None
    for rung in range(rungs):
        share = float(keep) ** (rung - rungs + 1)
        part = rows.where((F.col("_place") >= 1) & (F.col("_place") < 1 + share * (folds - 1))).drop("_place")
        n, scored = part.count(), []
        for i in left:
            made, score, t0 = learners[i], None, time.time()
            if fits and (fits >= max_fits or t0 - started >= max_seconds):
                status = "skipped"
            elif not n or not n_held:
                status = "empty"
            else:
                model = made.fit(part, task, n_classes, target_log1p, seed)
                score = score_predictions(settled(made.predict(model, held, task, n_classes, target_log1p)), task)[task.primary_metric]
                status, fits = "scored", fits + 1
                scored.append((sign * score, i))
            trials.append((len(trials) + 1, rung + 1, share, n, made.kind, str(dict(sorted(made.setting.items()))), score,
                           status, time.time() - t0))
        if scored:
            best = min(scored)
        left = ([i for _, i in sorted(scored)] or left)[:max(1, math.ceil(len(left) / keep))]
    winner = learners[best[1] if best else 0]
    model = winner.fit(rows.drop("_place"), task, n_classes, target_log1p, seed) if best else None
    rows.unpersist()
    return SearchResult(train.sparkSession.createDataFrame(trials, TRIALS), winner,
                        sign * best[0] if best else None, model)
