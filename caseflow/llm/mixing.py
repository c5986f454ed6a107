"""Mixing sources to target weights: repetition rates from per-source word totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.scalar import attach_scalars
from caseflow.functions.running import running_totals
from caseflow.llm.common import n_words
from caseflow.session import materialize

#: Weights that the sources get in their order, over and over.
WEIGHTS = (3, 1, 2)
#: The mix takes this share of all words, and no source more than this many times its own.
SHARE, MOST = 1.5, 2.0
SEED = 20240607
#: Partitions for the table of sources, which has one row for each.
SOURCE_PARTS = 4


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """One row for each source of (source, size): ``source_size``, ``target``, ``rate``.

    Sources are numbered by code point, null last, and weigh ``weights`` in turn.
    The targets sum to ``share`` of all sizes and stop at ``most`` times the
    source's own; what is cut off goes to the others by weight until none is
    above.  That is the level L at which sum(min(cap, L * weight)) meets the sum:
    with the sources in the order of cap / weight, the capped ones come first, so
    running totals of caps and weights give L without iterating.
    """
    sources = (sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
               .withColumn("no_name", F.col("source").isNull()).withColumn("one", F.lit(1)))
    cycle = F.array(*[F.lit(w) for w in weights])
    numbered = (running_totals(sources, ["no_name", "source"], "one", SOURCE_PARTS)
                .select("source", "source_size",
                        F.element_at(cycle, (F.col("row_no") % len(weights) + 1).cast("int")).cast("double").alias("w"))
                .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
                .withColumn("fills_at", F.col("cap") / F.col("w"))
                .withColumn("no_name", F.col("source").isNull()))
    order = ["fills_at", "no_name", "source"]
    by_cap = running_totals(numbered, order, "cap", SOURCE_PARTS).withColumnRenamed("before", "caps") \
        .withColumnRenamed("total", "all_caps").drop("row_no")
    by_both = materialize(running_totals(by_cap, order, "w", SOURCE_PARTS))
    wanted = F.lit(share / most) * F.col("all_caps")
    full = by_both.withColumn("full", F.col("cap") * (F.col("total") - F.col("before"))
                              <= (wanted - F.col("caps")) * F.col("w"))
    level = full.agg((F.max(wanted) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0))).alias("left"),
                     F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).alias("weight"))
    level = level.select(F.when(F.col("weight") > 0, F.col("left") / F.col("weight")).alias("level"))
    return (attach_scalars(full, level)
            .select("source", "source_size",
                    F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))
                    .alias("target"))
            .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                        .otherwise(1.0)))


def draw(key: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 that only the seed and the key decide."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def draw_limits(sized: DataFrame, target: DataFrame) -> DataFrame:
    """``target`` with ``limit``: a document whose draw is at most this gets one copy beside its floor(rate).

    Of ``sized`` (source, size, draw).  With the fraction of the rate as limit, each
    document would draw alone and a source of few or uneven documents miss its
    target by chance.  So the limit is calibrated: the draw at which the source's
    words, added up in the order of draws, come nearest to what its whole copies
    leave of the target (-1 if no document at all comes nearer).  It tends to the
    fraction, and the miss is at most half the size of one draw's documents.  Of
    two limits that come equally near, the smaller one.
    """
    draws = (sized.groupBy("source", "draw").agg(F.sum("size").alias("size"))
             .withColumn("no_name", F.col("source").isNull()))
    placed = materialize(running_totals(draws, ["no_name", "source", "draw"], "size")
                         .select(F.col("source").alias("of_draw"), "draw", "size", "before"))
    starts = placed.groupBy(F.col("of_draw").alias("of_start")).agg(F.min("before").alias("start"))
    left = target.withColumn("left", F.col("target") - F.floor("rate") * F.col("source_size"))
    left = left.join(starts, F.col("source").eqNullSafe(F.col("of_start"))).select(F.col("source").alias("of_left"), "left", "start")
    miss = F.abs(F.col("before") + F.col("size") - F.col("start") - F.col("left"))
    best = (placed.join(left, F.col("of_draw").eqNullSafe(F.col("of_left")))
            .groupBy(F.col("of_left").alias("of_best")).agg(F.min(F.struct(miss.alias("miss"), "draw")).alias("best"),
                                                            F.first("left").alias("left"))
            .withColumn("limit", F.when(F.col("best.miss") < F.col("left"), F.col("best.draw")).otherwise(-1.0)))
    return (target.join(best.select("of_best", "limit"), F.col("source").eqNullSafe(F.col("of_best")))
            .drop("of_best"))


def copies(rate: Column, drawn: Column, limit: Column) -> Column:
    """floor(rate), plus one if the draw is within the source's limit."""
    return (F.floor(rate) + (drawn <= limit).cast("int")).cast("int")


def _key(docs: DataFrame) -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def mixing_plan(docs: DataFrame, seed: int = SEED, **targets) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, rate, copies, taken.

    The size of a text is its number of words (null: 0; whole texts, however
    long).  ``copies`` is how often the mix holds the document; ``taken`` =
    copies * size.  A draw depends on the seed and the id alone (on the text where
    the id is null) and its limit on all sizes, so reruns agree and rows that
    repeat an id share its draw.  Sources that fill up at one level are taken by
    name, null last; what they get is the same in any order.  A source without
    words has no words to reach a target with; its documents stay once.  Extra
    columns are ignored; an empty table gives an empty result.
    """
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                                    draw(_key(docs), seed).alias("draw")))
    target = draw_limits(sized, materialize(source_targets(sized, **targets))).withColumnRenamed("source", "of_source")
    return (sized.join(target, F.col("source").eqNullSafe(F.col("of_source")))
            .withColumn("copies", copies(F.col("rate"), F.col("draw"), F.col("limit")))
            .withColumn("taken", F.col("copies") * F.col("size"))
            .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken"))


def mix(docs: DataFrame, seed: int = SEED, **targets) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as :func:`mixing_plan` says, with all its columns.

    Texts are not shuffled: sources, sizes and draws give a limit for each source,
    and each row looks up its own.  Nulls, ties, long texts and empty tables are as there.
    """
    sized = materialize(docs.select("source", n_words(F.col("text")).alias("size"), draw(_key(docs), seed).alias("draw")))
    target = draw_limits(sized, materialize(source_targets(sized, **targets)))
    target = target.select(F.col("source").alias("of_source"), "rate", "limit")
    rows = docs.select("source", draw(_key(docs), seed).alias("draw"), F.struct("*").alias("row"))
    return (rows.join(target, F.col("source").eqNullSafe(F.col("of_source")))
            .withColumn("copy", F.explode(F.sequence(F.lit(0), copies(F.col("rate"), F.col("draw"), F.col("limit")))))
            .filter("copy > 0").select("row.*"))
