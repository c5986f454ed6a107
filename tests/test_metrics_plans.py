from caseflow.operators import metrics


def test_f1_scores(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")]
    df = spark.createDataFrame(rows, "y_true string, y_pred string")
    r = metrics.f1_scores(df).first()
    # per class F1: a = 2/3, b = 2/4, c = 0 (labels = union of true and predicted)
    assert abs(r["f1_macro"] - (2 / 3 + 0.5 + 0.0) / 3) < 1e-9
    assert abs(r["f1_micro"] - 0.5) < 1e-9


def test_regression_errors(spark):
    df = spark.createDataFrame([(0.0, 86400.0), (0.0, 0.0), (10.0, 20.0)], "y_true double, y_pred double")
    r = metrics.regression_errors(df).first()
    assert abs(r["mae_sec"] - (86400 + 0 + 10) / 3) < 1e-6 and r["medae_sec"] == 10.0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefix_plan_limits_before_window(spark):
    from caseflow.plans.catalog import q_prefix_summary
    p = _plan(q_prefix_summary(spark, "/root/testdata/sf0.001"))
    assert "WindowGroupLimit" in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_no_python_udf_in_core_queries(spark):
    from caseflow.plans.catalog import QUERIES
    for name in ["prefixes", "dedup_events", "case_labels", "last_state_long", "mae_medae", "split_random"]:
        p = _plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "BatchEvalPython" not in p and "CartesianProduct" not in p, name


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_group_limit_runs_before_the_shuffle(spark):
    from caseflow.operators import prefixes
    from caseflow.sources import testlogs
    p = prefixes.extract_prefixes(testlogs.customer_log(spark, "/root/testdata/sf0.001"), include_event_attributes=False)
    plan = _plan(p)
    partial = plan.find("row_number(), 31, Partial")
    assert partial > 0
    # the partial limit sits below (after, in the printed tree) the case_id exchange
    assert plan.rfind("Exchange hashpartitioning(case_id", 0, partial) > 0
