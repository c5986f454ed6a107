"""Scalar column helpers (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "seconds_between", "log1p_nonneg", "expm1_clamped", "to_utc_timestamp_col",
    "safe_attr_name", "calendar_features", "parse_activities", "hash_unit",
    "relative_gain_pct", "json_safe", "round_half_up", "seconds_to_days",
]


def to_utc_timestamp_col(c: Column | str) -> Column:
    """Cast anything timestamp-like to TIMESTAMP; unparsable text becomes null (SCL-6).

    Timestamps without a zone are read as UTC (the session zone is pinned to UTC).
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_to_timestamp(c.cast("string")), F.lit(None).cast("timestamp"))


def seconds_between(a: Column | str, b: Column | str) -> Column:
    """Fractional seconds from ``a`` to ``b`` (SCL-4): micros difference / 1e6."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(1e6)


def log1p_nonneg(x: Column | str, null_as_zero: bool = True) -> Column:
    """``log1p(max(0, x))`` (SCL-1); null -> 0 for features, null kept for targets."""
    x = F.col(x) if isinstance(x, str) else x
    v = F.log1p(F.greatest(F.lit(0.0), x.cast("double")))
    return F.coalesce(v, F.lit(0.0)) if null_as_zero else v


def expm1_clamped(x: Column | str) -> Column:
    """Back-transform of a log1p target, clamped at 0 (SCL-2)."""
    x = F.col(x) if isinstance(x, str) else x
    return F.greatest(F.expm1(x), F.lit(0.0))


def seconds_to_days(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x / F.lit(86400.0)


def safe_attr_name(name: str) -> str:
    """Column-name helper (PRJ-10): ``: space - .`` become ``_``."""
    return re.sub(r"[: \-.]", "_", str(name))


def calendar_features(ts: Column | str, prefix: str = "feat_prefix_end_") -> list[Column]:
    """hour, weekday (Mon=0), is_weekend, month; 0 when ts is null (SCL-3)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    wd = F.weekday(ts)
    return [
        F.coalesce(F.hour(ts), F.lit(0)).alias(f"{prefix}hour"),
        F.coalesce(wd, F.lit(0)).alias(f"{prefix}weekday"),
        F.coalesce((wd >= 5).cast("int"), F.lit(0)).alias(f"{prefix}is_weekend"),
        F.coalesce(F.month(ts), F.lit(0)).alias(f"{prefix}month"),
    ]


def parse_activities(c: Column | str) -> Column:
    """Parse an activity list given as JSON array, JSON scalar, or ``,`` / ``;`` text (SCL-9).

    The elements of a JSON array are taken as text (``True``, ``False`` and ``None`` for its
    literals), and any other JSON value is one activity with the text it has.  Other text is split at commas if it has one, else
    at semicolons, and its parts are trimmed; empty parts stay.  Null and empty text have no activities.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    bare = F.trim(s)
    json_array = F.when(bare.startswith("["), F.try_parse_json(s).try_cast("array<variant>"))
    json_value = (bare.rlike(r'^"([^"\\]|\\.)*"$') | bare.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")
                  | bare.isin("true", "false", "null")
                  | (bare.startswith("{") & F.from_json(s, "map<string,string>").isNotNull()))
    parts = F.when(s.contains(","), F.split(s, ",")).when(s.contains(";"), F.split(s, ";")).otherwise(F.array(s))
    return (F.when(s.isNull() | (s == ""), F.array().cast("array<string>"))
            .when(json_array.isNotNull(), F.transform(json_array, lambda x: F.when(
                F.schema_of_variant(x) == "BOOLEAN", F.initcap(x.cast("string"))).otherwise(F.coalesce(x.cast("string"), F.lit("None")))))
            .when(json_value, F.array(s))
            .otherwise(F.transform(parts, lambda x: F.trim(x))))


def hash_unit(key: Column | str, seed: int = 42) -> Column:
    """Deterministic uniform value in [0, 1) from ``md5(seed:key)``; DuckDB-reproducible."""
    key = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def relative_gain_pct(score: Column, baseline: Column, higher_is_better: Column | bool) -> Column:
    """Relative improvement in percent with metric direction (SCL-13)."""
    hib = F.lit(higher_is_better) if isinstance(higher_is_better, bool) else higher_is_better
    diff = F.when(hib, score - baseline).otherwise(baseline - score)
    return F.try_divide(diff * 100.0, F.abs(baseline))


def json_safe(x: Column | str) -> Column:
    """NaN / +-Inf -> null (SCL-14)."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def round_half_up(x: Column | str, digits: int = 4) -> Column:
    """Round via ``floor(x*10^d + 0.5)``: same result in Spark and DuckDB (Appendix B)."""
    x = F.col(x) if isinstance(x, str) else x
    m = float(10 ** digits)
    return F.floor(x * m + 0.5) / m


def attach_scalars(df, one_row):
    """Attach the columns of a one-row frame (a global aggregate: thresholds, bounds,
    totals) to every row of ``df``.

    ``one_row`` must be an aggregate without grouping keys, so it has exactly one
    row; the broadcast nested-loop join then costs O(rows of df), never a product.
    """
    return df.crossJoin(F.broadcast(one_row))


#: Rows up to which a lookup table is sent to every task.
SMALL_TABLE_ROWS = 200_000


def small_side(table):
    """The lookup side of a join: broadcast if it is counted to be small, else left to a shuffled join.

    The table (a vocabulary, class weights) is kept, so counting it costs no second computation.
    """
    kept = table.persist()
    return F.broadcast(kept) if kept.limit(SMALL_TABLE_ROWS + 1).count() <= SMALL_TABLE_ROWS else kept
