"""Case splits train / val / test without leakage (SPL-1..4).

Splits are a DataFrame ``(case_id, split)`` joined to prefixes; no case set ever
goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.scalar import hash_unit
from caseflow.operators.ranking import global_rank
from caseflow.operators.schema import CASE, TS
from caseflow.functions.scalar import attach_scalars


def _cut(ranked: DataFrame, n: DataFrame, train_ratio: float, val_ratio: float) -> DataFrame:
    sizes = n.select(F.floor(F.col("_n") * F.lit(float(train_ratio))).cast("bigint").alias("_nt"),
                     F.floor(F.col("_n") * F.lit(float(val_ratio))).cast("bigint").alias("_nv"))
    j = attach_scalars(ranked, sizes)
    split = (F.when(F.col("_rank") <= F.col("_nt"), F.lit("train"))
             .when(F.col("_rank") <= F.col("_nt") + F.col("_nv"), F.lit("val"))
             .otherwise(F.lit("test")))
    return j.select(CASE, split.alias("split"))


def split_cases(log: DataFrame, train_ratio: float = 0.7, val_ratio: float = 0.15, seed: int = 42,
                temporal: bool = False) -> DataFrame:
    """SPL-1 (random) / SPL-2 (temporal).

    random: cases ordered by ``md5(seed:case_id)`` (ties by id); temporal: by case
    start time (ties by id).  The first int(n*train) are train, the next
    int(n*val) val, the rest test.  Exact sizes via a distributed global rank.
    """
    if temporal:
        cases = log.groupBy(CASE).agg(F.min(TS).alias("_key"))
    else:
        cases = log.select(CASE).distinct().withColumn("_key", hash_unit(CASE, seed))
    ranked = global_rank(cases, [F.col("_key"), F.col(CASE)], "_rank")
    n = cases.agg(F.count(F.lit(1)).alias("_n"))
    return _cut(ranked, n, train_ratio, val_ratio)


def split_cases_hash(log: DataFrame, train_ratio: float = 0.7, val_ratio: float = 0.15, seed: int = 42) -> DataFrame:
    """SPL-1, approximate sizes: a pure per-case hash threshold (no sort, no rank)."""
    u = hash_unit(CASE, seed)
    split = (F.when(u < train_ratio, F.lit("train")).when(u < train_ratio + val_ratio, F.lit("val"))
             .otherwise(F.lit("test")))
    return log.select(CASE).distinct().select(CASE, split.alias("split"))


def attach_split(prefixes: DataFrame, splits: DataFrame) -> DataFrame:
    """SPL-4: split column per row (inner join: cases without a split drop out)."""
    return prefixes.join(splits, CASE)
