"""Gains of the stages of a search, in the direction of each task's metric."""

from caseflow.plans.strategy import staged_gains


def test_staged_gains(spark):
    rows = [("a", "f1_macro", "no_bucket", "last_state", 0.5), ("a", "f1_macro", "cluster", "aggregation", 0.6),
            ("b", "mae_days", "no_bucket", "last_state", 4.0), ("b", "mae_days", "cluster", "last_state", 5.0),
            ("zero", "f1_macro", "no_bucket", "last_state", 0.0), ("no_base", "f1_macro", "cluster", "last_state", 0.4),
            ("no_search", "f1_macro", "no_bucket", "last_state", 0.4)]
    results = spark.createDataFrame(rows, "task string, primary_metric string, bucketing string, encoding string, primary_score double")
    searched = spark.createDataFrame([("a", 0.57), ("b", 3.0), ("zero", 0.3), ("no_base", 0.3), ("no_search", None)],
                                     "task string, search_score double")
    got = {r.task: (round(r.gain_strategy_pct, 6), round(r.gain_search_pct, 6)) for r in staged_gains(results, searched).collect()}
    assert got == {"a": (20.0, -5.0), "b": (0.0, 25.0), "zero": (0.0, 0.0)}
    assert staged_gains(results.limit(0), searched).count() == 0
