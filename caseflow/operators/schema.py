"""Canonical schema, projection and cleaning (PRJ-1..10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from caseflow.functions.scalar import attach_scalars

CASE, ACT, TS, IDX = "case_id", "activity", "timestamp", "_event_index"
CORE = (CASE, ACT, TS, IDX)

# Default candidate column names, in preference order.
DEFAULT_CASE_CANDIDATES = ["case:concept:name", "case_id", "CaseID", "case", "trace_id", "Case", "CaseId", "caseid"]
DEFAULT_ACT_CANDIDATES = ["concept:name", "activity", "Activity", "task", "event", "Action", "EventName",
                          "activity_name", "activityNameEN"]
DEFAULT_TS_CANDIDATES = ["time:timestamp", "timestamp", "time", "datetime", "event_time", "Timestamp",
                         "start_time", "end_time"]

# Activity texts that count as missing.
MISSING_ACTIVITY_TEXTS = ["", "nan", "None"]


def case_window(*order: str | Column) -> Window:
    """Per-case window ordered by (timestamp, _event_index) unless told otherwise."""
    return Window.partitionBy(CASE).orderBy(*(order or (TS, IDX)))


def pick_columns(df: DataFrame, case_candidates=None, act_candidates=None, ts_candidates=None) -> dict:
    """Choose case / activity / timestamp source columns (PRJ-1).

    Among the candidates present, the one with the fewest nulls wins; ties go to
    list order.  One aggregate job over the candidate columns only.
    """
    lists = {
        # the user's names come first; a name counts where it first stands
        CASE: list(dict.fromkeys([*(case_candidates or ()), *DEFAULT_CASE_CANDIDATES])),
        ACT: list(dict.fromkeys([*(act_candidates or ()), *DEFAULT_ACT_CANDIDATES])),
        TS: list(dict.fromkeys([*(ts_candidates or ()), *DEFAULT_TS_CANDIDATES])),
    }
    present = {k: [c for c in v if c in df.columns] for k, v in lists.items()}
    missing = [k for k, v in present.items() if not v]
    if missing:
        raise ValueError(f"could not infer columns for {missing}; available: {df.columns}")
    cands = sorted({c for v in present.values() for c in v})
    if all(len(v) == 1 for v in present.values()):
        return {k: v[0] for k, v in present.items()}
    nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cands]).first().asDict()
    return {k: min(v, key=lambda c: (nulls[c], v.index(c))) for k, v in present.items()}


# Auto-detection lists for uploaded logs, in preference order (PRJ-3).
AUTO_CASE_NAMES = ["case_id", "caseid", "case:concept:name", "case id", "case", "trace_id", "traceid", "instance_id",
                   "process_instance_id", "issue_num", "id"]
AUTO_CASE_PARTS = ["case", "trace", "instance", "issue"]
AUTO_TS_NAMES = ["timestamp", "time:timestamp", "time", "datetime", "start_time", "starttime", "started", "start",
                 "begin_time", "event_time", "eventtime", "created", "creation_time", "date", "event_date"]
AUTO_TS_PARTS = ["time", "date", "start", "created"]
AUTO_ACT_NAMES = ["concept:name", "activity", "Activity", "ACTIVITY", "act", "event", "task", "action", "event_type",
                  "eventtype", "ActivityName", "event_name"]
AUTO_ACT_PARTS = ["activity", "event_type", "task", "action"]


# How a column name can match the names of a rule, and whether the rule prefers earlier names or earlier columns.
MATCHES = {
    "listed": (lambda column, name: column.lower() == name, True),
    "key": (lambda column, name: column == name, True),
    "exact": (lambda column, name: column == name, False),
    "any_case": (lambda column, name: column.lower() == name.lower(), False),
    "contains": (lambda column, name: name in column.lower(), False),
}
ACT_RULES = [("exact", AUTO_ACT_NAMES), ("any_case", AUTO_ACT_NAMES), ("contains", AUTO_ACT_PARTS)]
#: For each format and role the rules, strongest first.
AUTO_RULES = {
    "csv": {CASE: [("listed", AUTO_CASE_NAMES), ("contains", AUTO_CASE_PARTS)],
            TS: [("listed", AUTO_TS_NAMES), ("contains", AUTO_TS_PARTS)], ACT: ACT_RULES},
    "xes": {CASE: [("key", ["case:concept:name", "case_id"])], TS: [("key", ["time:timestamp", "timestamp"])],
            ACT: ACT_RULES},
}


def detect_columns(columns: list[str], fmt: str = "csv") -> dict:
    """PRJ-3: guess case / timestamp / activity columns from names only (no data scan).

    Every match of a column with a rule gets a rank (rule, then place of the
    name or of the column, as the rule prefers); the best-ranked column takes
    the role, and a role without a match is None.
    """
    def ranks(rules):
        for strength, (kind, names) in enumerate(rules):
            matches, by_name = MATCHES[kind]
            for place, column in enumerate(columns):
                hits = [n for n, name in enumerate(names) if matches(column, name)]
                if hits:
                    yield strength, hits[0] if by_name else place, column
    best = {role: min(ranks(rules), default=None)
            for role, rules in AUTO_RULES["csv" if fmt == "csv" else "xes"].items()}
    return {role: rank and rank[-1] for role, rank in best.items()}


def normalize_schema(df: DataFrame, case_candidates=None, act_candidates=None, ts_candidates=None,
                     mapping: dict | None = None) -> DataFrame:
    """Rename the chosen columns to ``case_id / activity / timestamp`` (PRJ-1).

    A column already named like a canonical target but not chosen is kept as
    ``<name>__orig`` so no duplicate names appear.  Timestamps are parsed, bad
    values become null.
    """
    m = mapping or pick_columns(df, case_candidates, act_candidates, ts_candidates)
    src_to_dst = {v: k for k, v in m.items()}
    cols = []
    for c in df.columns:
        q = F.col(f"`{c}`")
        if c in src_to_dst:
            dst = src_to_dst[c]
            if dst == TS:
                q = q if isinstance(df.schema[c].dataType, T.TimestampType) else F.try_to_timestamp(q.cast("string"))
            cols.append(q.alias(dst))
        elif c in m:  # a canonical name that lost to another candidate
            cols.append(q.alias(f"{c}__orig"))
        else:
            cols.append(q.alias(c))
    return df.select(*cols)


# Semantic columns reported by the schema QC when present.
SEMANTIC_COLUMNS = ["lifecycle:transition", "EventID", "org:resource"]


def schema_qc(raw: DataFrame, mapping: dict | None = None, **candidates) -> DataFrame:
    """PRJ-2: one row: chosen source columns, semantic columns present, rows, unparsable times."""
    m = mapping or pick_columns(raw, **candidates)
    ts = F.col(f"`{m[TS]}`")
    parsed = ts if isinstance(raw.schema[m[TS]].dataType, (T.TimestampType, T.TimestampNTZType)) \
        else F.try_to_timestamp(ts.cast("string"))
    present = [c for c in SEMANTIC_COLUMNS if c in raw.columns]
    return raw.agg(F.lit(m[CASE]).alias("case_source"), F.lit(m[ACT]).alias("activity_source"),
                   F.lit(m[TS]).alias("timestamp_source"), F.lit(",".join(present)).alias("semantic_columns"),
                   F.count(F.lit(1)).alias("n_rows"), F.count_if(ts.isNotNull() & parsed.isNull()).alias("n_ts_unparsed"))


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """PRJ-4: missing names are ignored."""
    return df.drop(*[c for c in columns if c in df.columns])


def clean_events(df: DataFrame) -> DataFrame:
    """PRJ-5: case and activity as text, timestamp parsed; rows without case or time dropped.

    Null activity becomes ``UNKNOWN`` (the text ``None`` in the reference is a
    pandas artefact).  Order is not materialised: every consumer declares
    ``(timestamp, _event_index)`` in its window.
    """
    for c in (CASE, ACT, TS):
        if c not in df.columns:
            raise ValueError(f"missing required column {c!r}")
    ts = F.col(TS) if isinstance(df.schema[TS].dataType, T.TimestampType) else F.try_to_timestamp(F.col(TS).cast("string"))
    out = df.withColumns({
        CASE: F.col(CASE).cast("string"),
        ACT: F.coalesce(F.col(ACT).cast("string"), F.lit("UNKNOWN")),
        TS: ts,
    })
    if IDX not in out.columns:
        out = out.withColumn(IDX, F.monotonically_increasing_id())
    return out.where(F.col(CASE).isNotNull() & F.col(TS).isNotNull())


def normalize_activities(df: DataFrame, placeholder: str = "UNKNOWN") -> DataFrame:
    """PRJ-6: trim; empty / ``nan`` / ``None`` / null become the placeholder."""
    a = F.trim(F.col(ACT).cast("string"))
    return df.withColumn(ACT, F.when(a.isNull() | a.isin(*MISSING_ACTIVITY_TEXTS), F.lit(placeholder)).otherwise(a))


def repair_timestamps(df: DataFrame, strategy: str = "forward_fill", chunk_rows: int | None = 2_000_000) -> DataFrame:
    """PRJ-7/8 in source (``_event_index``) order within a case (skew-aware scans).

    forward_fill: a time earlier than the running maximum is raised to it.
    drop: an event earlier than its original predecessor is dropped (one pass).
    """
    from caseflow.operators.sequence import ordered_scan
    if strategy == "forward_fill":
        s = ordered_scan(df, [IDX], running_max={"_run_ts": TS}, chunk_rows=chunk_rows)
        return s.withColumn(TS, F.col("_run_ts")).drop("_run_ts")
    if strategy == "drop":
        s = ordered_scan(df, [IDX], lags={"_prev_ts": TS}, chunk_rows=chunk_rows)
        return s.where(F.col("_prev_ts").isNull() | (F.col(TS) >= F.col("_prev_ts"))).drop("_prev_ts")
    raise ValueError(f"unknown strategy {strategy!r}")


# Columns never imputed.
DEFAULT_IMPUTE_SKIP = ["case_id", "activity", "timestamp", "_event_index", "lifecycle:transition", "org:resource"]


def imputation_values(df: DataFrame, max_missing_frac: float = 0.5, skip_cols=None) -> DataFrame:
    """PRJ-9 fit: one row per column with its fill value (as text) and whether it is used.

    numeric -> exact median, other -> mode (ties: smallest value).  Columns with
    no nulls, only nulls, or a missing fraction above ``max_missing_frac`` are
    not imputed.  Values are counted as (column, value) rows, so no column's
    values gather in one place: medians come from the distributed exact quantile, modes
    from counts that are combined before the shuffle.
    """
    from caseflow.functions.quantiles import exact_quantiles_by
    skip = set(DEFAULT_IMPUTE_SKIP if skip_cols is None else skip_cols)
    cols = [f for f in df.schema.fields if f.name not in skip and not f.name.startswith("_")
            and isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType))]
    kind = {f.name: "numeric" if isinstance(f.dataType, T.NumericType) else "categorical" for f in cols}

    def values(of: str, as_type: str) -> DataFrame:
        pairs = [F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast(as_type).alias("value"))
                 for n, k in kind.items() if k == of]
        pairs = F.array(*pairs) if pairs else F.array().cast(f"array<struct<column:string,value:{as_type}>>")
        return df.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null")

    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{n}`").isNull()).alias(f"m{i}")
                                                    for i, n in enumerate(kind)])
    missing = counts.select("n", F.explode(F.array(*[
        F.struct(F.lit(n).alias("column"), F.lit(k).alias("kind"), F.col(f"m{i}").alias("n_missing"))
        for i, (n, k) in enumerate(kind.items())]
        or [F.lit(None).cast("struct<column:string,kind:string,n_missing:bigint>")])).alias("r")).select("n", "r.*")
    medians = exact_quantiles_by(values("numeric", "double"), ["column"], "value", [0.5]) \
        .select("column", F.col("q0").cast("string").alias("fill_value"))
    modes = (values("categorical", "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
             .groupBy("column").agg(F.min_by("value", F.struct(-F.col("c"), F.col("value"))).alias("fill_value")))
    frac = F.col("n_missing") / F.col("n")
    return (missing.where("column is not null").join(medians.unionByName(modes), "column", "left")
            .select("column", "kind", "n_missing", frac.alias("missing_frac"), "fill_value",
                    ((F.col("n_missing") > 0) & (F.col("n_missing") < F.col("n")) & (frac <= F.lit(max_missing_frac)))
                    .alias("imputed")))


def impute_missing_attributes(df: DataFrame, max_missing_frac: float = 0.5, skip_cols=None) -> DataFrame:
    """PRJ-9 apply: fill values are a one-row aggregate, cross-joined (broadcast, 1 row)."""
    names = [f.name for f in df.schema.fields]
    fit_cols = [f for f in df.schema.fields if f.name not in set(DEFAULT_IMPUTE_SKIP if skip_cols is None else skip_cols)
                and not f.name.startswith("_") and isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType))]
    if fit_cols:  # values are learned for columns with holes only: a median ranks all values of its column
        holes = df.agg(*[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"m{i}") for i, f in enumerate(fit_cols)]).first()
        fit_cols = [f for f, n in zip(fit_cols, holes) if n]
    if not fit_cols:
        return df
    fitted = {f.name for f in fit_cols}
    vals = imputation_values(df, max_missing_frac, [n for n in names if n not in fitted])
    one = vals.groupBy().agg(*[
        F.max(F.when((F.col("column") == f.name) & F.col("imputed"), F.col("fill_value"))).alias(f"__fill_{i}")
        for i, f in enumerate(fit_cols)])
    j = attach_scalars(df, one)
    out = []
    idx = {f.name: i for i, f in enumerate(fit_cols)}
    for n in names:
        c = F.col(f"`{n}`")
        if n in idx:
            c = F.coalesce(c, F.col(f"__fill_{idx[n]}").cast(df.schema[n].dataType)).alias(n)
        out.append(c)
    return j.select(*out)
