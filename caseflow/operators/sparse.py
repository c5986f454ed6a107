"""Sparse feature blocks (ENC-3, ENC-6, ENC-7, ENC-13).

A block is one vector column whose entries are the slots of a vocabulary.  The
vocabulary lives in a Spark ML model (a hash table that goes to each executor
once), not in the plan: a plan is as long for ten thousand activities as for
three, and a row costs what it holds, not what the vocabulary holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_block(df: DataFrame, tokens: Column, vocabulary: list[str], out: str) -> DataFrame:
    """Add ``out``: how often each word of ``vocabulary`` is among ``tokens`` (array of strings).

    Other tokens and nulls count nowhere.  Null tokens give an empty vector.
    """
    from pyspark.ml.feature import CountVectorizerModel
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_tokens", outputCol=out)
    return model.transform(df.withColumn("_tokens", F.coalesce(tokens, F.array().cast("array<string>")))).drop("_tokens")


def onehot_blocks(df: DataFrame, values: dict[str, list[str]], outs: list[str]) -> DataFrame:
    """Add one vector for each column of ``values``: its known values, then one slot for all else and null.

    A column without known values has only the last slot.
    """
    from pyspark.ml.feature import OneHotEncoder, StringIndexerModel
    known = [(c, out) for c, out in zip(values, outs) if values[c]]
    nothing = {out: F.lit(1.0) for c, out in zip(values, outs) if not values[c]}
    df = df.withColumns(nothing) if nothing else df
    if not known:
        return df
    texts, slots = [f"_text_{out}" for _, out in known], [f"_slot_{out}" for _, out in known]
    indexer = StringIndexerModel.from_arrays_of_labels([values[c] for c, _ in known], inputCols=texts, outputCols=slots,
                                                       handleInvalid="keep")
    indexed = indexer.transform(df.withColumns({t: F.col(f"`{c}`").cast("string") for t, (c, _) in zip(texts, known)}))
    # the sizes are in the indexer's column metadata, so fitting reads no row
    encoder = OneHotEncoder(inputCols=slots, outputCols=[out for _, out in known], dropLast=False).fit(indexed.limit(0))
    return encoder.transform(indexed).drop(*texts, *slots)


def position_blocks(df: DataFrame, activities: Column, vocabulary: list[str], positions: int, known_out: str,
                    unknown_out: str) -> DataFrame:
    """Add two vectors: (position, activity) as one index, by position, and the positions whose activity is
    unknown, null or absent."""
    tokens = F.transform(F.slice(activities, 1, positions), lambda a, i: F.concat((i + 1).cast("string"), F.lit(":"), a))
    every = [str(p) for p in range(1, positions + 1)]
    df = count_block(df, tokens, [f"{p}:{a}" for p in every for a in vocabulary], known_out) if vocabulary else df
    there = F.transform(F.unwrap_udt(known_out)["indices"], lambda k: F.floor(k / F.lit(len(vocabulary))) + 1) \
        if vocabulary else F.array()
    unknown = F.array_except(F.array(*[F.lit(p) for p in every]), there.cast("array<string>"))
    return count_block(df, unknown, every, unknown_out)


def block_sum(block: str) -> Column:
    """Sum of a sparse block's values."""
    return F.aggregate(F.unwrap_udt(block)["values"], F.lit(0.0), lambda s, x: s + x)


def entries(vector: str = "features") -> Column:
    """The non-zero entries of a vector, sparse or dense, as an array of (``index``, ``value``)."""
    v = F.unwrap_udt(vector)
    index = F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1))
    pairs = F.transform(v["values"], lambda x, i: F.struct(F.get(index, i).alias("index"), x.alias("value")))
    return F.filter(pairs, lambda e: e["value"] != 0)


def entries_long(encoded: DataFrame, names: list[str], keys: list[str], vector: str = "features") -> DataFrame:
    """ENC-13 long: one row for each non-zero entry, with its feature's name."""
    from caseflow.functions.scalar import small_side
    spark = encoded.sparkSession
    table = spark.createDataFrame(list(enumerate(names)), "index int, feature string")
    rows = encoded.select(*keys, F.explode(entries(vector)).alias("_e")).select(*keys, "_e.index", "_e.value")
    return rows.join(small_side(table), "index")
