"""Counts of the ablation stages, observed while they are written."""

from pyspark.sql import functions as F

from caseflow.plans.ablation import SCORED_STAGES, ablation_row_counts


def test_counts_of_every_stage(make_log):
    rows = [(f"c{i}", a, 100 * i + 10 * k, 10 * i + k) for i in range(12) for k, a in enumerate("ABCD")]
    rows += [("c0", "A", 0, 5), ("one", "A", 5, 200), ("still", "A", 7, 300), ("still", "B", 7, 301),
             ("odd", "A", 9, 400), ("odd", "D", 12, 401), ("twice", "A", 20, 500), ("twice", "A", 25, 501)]
    got = {r.stage_name: (r.n_events, r.n_cases, r.n_prefix_rows) for r in ablation_row_counts(make_log(rows)).collect()}
    assert list(got) == [n for n, *_ in SCORED_STAGES]
    assert got["load"] == (56, 16, 40) and got["dedup"] == (55, 16, 39)
    assert got["stable_sort"] == got["clean"] == got["time_features"] == got["dedup"]
    assert got["short_cases"][1] == 15 and got["zero_duration"][1] == 14
    assert got["consecutive_duplicates"] == (51, 14, 12 * 3 + 1) and got["rare_variants"] == (48, 12, 36)
    assert got["rare_classes"][:2] == (48, 12) and got["rare_classes"][2] <= 36


def test_left_out_stages_late_cases_and_an_empty_log(make_log):
    rows = [(f"c{i}", a, 100 * i + 10 * k, 10 * i + k) for i in range(6) for k, a in enumerate("AB")]
    log = make_log(rows)
    got = {r.stage_name: r.n_cases for r in ablation_row_counts(log, leave_out=("rare_variants", "impute"), since="2024-01-01 00:05:00").collect()}
    assert "rare_variants" not in got and "impute" not in got and got["consecutive_duplicates"] == 6 and got["drift_window"] == 3
    empty = ablation_row_counts(log.where(F.col("case_id") == "none"))
    assert {tuple(r)[2:] for r in empty.collect()} == {(0, 0, 0)} and empty.count() == len(SCORED_STAGES)


def test_copies_in_buckets_of_cases_need_no_shuffle(spark, make_log):
    from caseflow.session import materialize
    rows = [(f"c{i}", a, 100 * i + 10 * k, 10 * i + k) for i in range(6) for k, a in enumerate("AB")]
    before = {t.name for t in spark.catalog.listTables()}
    log = materialize(make_log(rows).repartition(3, "case_id"), by="case_id", parts=3)
    sizes = log.groupBy("case_id").count()
    kept = log.join(sizes.where("count > 1"), "case_id", "left_semi")
    assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 12 and {t.name for t in spark.catalog.listTables()} == before


def test_a_hot_case_gives_the_same_counts(spark, make_log):
    rows = [(f"c{i}", a, 100 * i + 10 * k, 10 * i + k) for i in range(8) for k, a in enumerate("ABCD")]
    counts = lambda: [tuple(r) for r in ablation_row_counts(make_log(rows)).collect()]
    plain = counts()
    spark.conf.set("caseflow.hotCaseRows", "3")
    try:
        assert counts() == plain
    finally:
        spark.conf.unset("caseflow.hotCaseRows")


def test_scored_stages_make_again_only_what_changed(make_log, monkeypatch):
    from caseflow.operators import encoding, models, splits
    from caseflow.plans import ablation
    rows = [(f"c{i}", a, 5000 * i + (7 * i + 3) * k, 10 * i + k) for i in range(40) for k, a in enumerate("ABCD"[: 2 + i % 3])]
    rows += [("c0", "A", 0, 0), ("one", "A", 5, 900)]
    made, seen, fits = [], [], []
    split, fit, fit_encoder = splits.split_cases, models.fit_predict, encoding.fit_encoder
    monkeypatch.setattr(splits, "split_cases", lambda log, **kw: made.append(1) or split(log, **kw))
    monkeypatch.setattr(models, "fit_predict", lambda *a, **kw: fits.append(1) or fit(*a, **kw))
    monkeypatch.setattr(encoding, "fit_encoder", lambda name, train, **kw: seen.append(train.columns) or fit_encoder(name, train, **kw))
    stages = [s for s in ablation.SCORED_STAGES if s[0] in ("load", "dedup", "stable_sort", "time_features", "short_cases", "outliers")]
    monkeypatch.setattr(ablation, "SCORED_STAGES", stages)
    got = {r.stage_name: r for r in ablation.ablation_scores(make_log(rows)).collect()}
    assert list(got) == [s[0] for s in stages]
    assert len(made) == 2  # the cases change only when the case of one event goes
    assert len(fits) == 5 and all("prefix_activities" not in columns for columns in seen)
    counts = {r.stage_name: r for r in ablation_row_counts(make_log(rows)).collect()}
    for name, r in got.items():
        assert (r.n_events, r.n_cases, r.n_prefix_rows) == tuple(counts[name])[2:] and r.primary_score >= 0
    assert got["stable_sort"].primary_score == got["dedup"].primary_score and got["stable_sort"].delta_vs_previous == 0
