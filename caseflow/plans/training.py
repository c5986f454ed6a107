"""End-to-end training run for one task (§3.1): the user-facing composition of the operators.

log -> cleaning stages -> case labels -> prefixes (materialised) -> case split
-> train-fitted outlier / rare-class filters -> strategy search on val ->
final model(s) for the best strategy -> test metrics -> optional bundle.

Every stage is a DataFrame transformation; the prefix frame is written once to
the checkpoint folder because fitting and scoring read it many times.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.operators import filters, labels, metrics, prefixes, sampling, schema
from caseflow.operators.bucketing import make_bucketer
from caseflow.operators.encoding import fit_encoder, label_vocabulary
from caseflow.operators.models import TaskSpec, default_task_specs, predict_routed, train_per_bucket
from caseflow.operators.splits import attach_split, split_cases
from caseflow.plans.strategy import dealt, eligible_buckets, settled, strategy_search
from caseflow.session import materialize


@dataclass
class RunConfig:
    task: str = "remaining_time"
    outcome_col: str = ""
    outcome_values: str = ""
    max_prefix_len: int = 30
    min_events: int = 2
    min_trace_freq: float = 0.005
    max_length_percentile: float = 99.0
    filter_consecutive_duplicates: bool = False
    min_variant_count: int | None = None
    iqr_multiplier: float | None = 1.5
    min_class_samples: int | None = None
    temporal_split: bool = False
    bucketers: list = field(default_factory=lambda: ["no_bucket", "prefix_len_bins"])
    encodings: list = field(default_factory=lambda: ["last_state", "aggregation"])
    target_log1p: bool = True
    kind: str = "linear"
    min_bucket_samples: int = 1000
    bundle_path: str | None = None


def clean_log(log: DataFrame, cfg: RunConfig) -> DataFrame:
    """Stages 4-7 of §3.1 on a canonical log."""
    d = filters.deduplicate_events(schema.clean_events(log))
    d = filters.filter_short_cases(d, cfg.min_events)
    d = schema.normalize_activities(d)
    d = filters.filter_infrequent_activities(d, cfg.min_trace_freq)
    d = filters.filter_zero_duration_cases(d)
    d = filters.filter_case_length(d, cfg.max_length_percentile)
    if cfg.filter_consecutive_duplicates:
        d = filters.filter_consecutive_duplicates(d)
    if cfg.min_variant_count:
        d = filters.filter_rare_variants(d, cfg.min_variant_count)
    return d


def train_task(log: DataFrame, cfg: RunConfig | None = None) -> dict:
    """Run one task end to end; returns DataFrames and fitted objects (no data on the driver)."""
    cfg = cfg or RunConfig()
    task: TaskSpec = default_task_specs()[cfg.task]
    clean = materialize(clean_log(log, cfg))
    cases = labels.case_table(clean, cfg.outcome_col, cfg.outcome_values)
    pre = prefixes.extract_prefixes(clean, cases, max_prefix_len=cfg.max_prefix_len)
    splits = split_cases(clean, temporal=cfg.temporal_split)
    frame = attach_split(pre, splits)
    if cfg.iqr_multiplier and task.task_type == "regression":
        frame = sampling.filter_iqr_outliers(frame, task.label_col, cfg.iqr_multiplier)
    if cfg.min_class_samples and task.task_type == "classification":
        frame = sampling.filter_rare_classes(frame, task.label_col, cfg.min_class_samples)
    frame = materialize(frame)

    log1p = cfg.target_log1p and task.task_type == "regression"
    results = materialize(strategy_search(frame, task, cfg.bucketers, cfg.encodings, cfg.kind, cfg.min_bucket_samples,
                                          target_log1p=log1p))
    best = results.where("rank = 1").first()  # one row: the winning strategy's names
    chosen = best.asDict() if best else {"bucketing": "no_bucket", "encoding": cfg.encodings[0], "mode": "global"}

    train = frame.where("split = 'train'")
    cls = task.task_type == "classification"
    lv = label_vocabulary(train, task.label_col) if cls else None
    bucketer = make_bucketer(chosen["bucketing"]).fit(train)
    encoder = fit_encoder(chosen["encoding"], train, label_col=task.label_col, label_is_numeric=not cls, label_vocab=lv)
    bucketed = bucketer.assign(frame)
    ids = eligible_buckets(bucketed, task, cfg.min_bucket_samples) if chosen["mode"] == "per_bucket" else []
    data = materialize(dealt(encoder.transform, bucketed, encoder.feature_dim).select(
        "case_id", "prefix_len", "split", "bucket_id", "features", "label"), "persist")
    # the final models see train and val rows; every test row is scored, by the nearest model if its bucket has none
    fit_rows = data.where("split IN ('train', 'val')").withColumn("split", F.lit("train"))
    models, _ = train_per_bucket(fit_rows, ids, task, cfg.kind, target_log1p=log1p)
    test_pred = predict_routed(data.where("split = 'test'"), models, task, log1p)
    if cls:
        test_metrics = metrics.f1_scores(settled(test_pred).select(F.col("y_true").cast("string").alias("y_true"),
                                                          F.col("y_pred").cast("string").alias("y_pred")))
    else:
        test_metrics = metrics.regression_errors(settled(test_pred))
    if cfg.bundle_path:
        from caseflow.sources.sinks import save_bundle
        save_bundle(cfg.bundle_path, models, {"task": task.name, "bucketing": chosen["bucketing"],
                                              "encoding": chosen["encoding"], "mode": chosen["mode"],
                                              "label_vocab": lv, "target_log1p": log1p}, encoder, bucketer)
    return {"clean_log": clean, "case_table": cases, "prefixes": frame, "strategies": results,
            "best": chosen, "bucketer": bucketer, "encoder": encoder, "models": models,
            "test_predictions": test_pred, "test_metrics": test_metrics}


def compare_configs(log: DataFrame, baseline: RunConfig, configured: RunConfig) -> DataFrame:
    """EXP-8: the same log trained with a baseline and a configured run; test metrics side by side."""
    a = train_task(log, baseline)["test_metrics"]
    b = train_task(log, configured)["test_metrics"]
    ren = lambda d, tag: d.select(*[F.col(c).alias(f"{tag}_{c}") for c in d.columns])
    from caseflow.functions.scalar import attach_scalars
    return attach_scalars(ren(a, "baseline"), ren(b, "configured"))
