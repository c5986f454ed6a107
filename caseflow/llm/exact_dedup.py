"""Exact dedup by content sort: range-partition on sampled splitters, sort by content, compare neighbours in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseflow.functions.running import shuffle_partitions
from caseflow.session import materialize

#: Bytes of a text that the range splitters look at: so many from its front, and half as many each from its
#: middle and its end.  Whole texts would be sampled to the driver.
SPLIT_BYTES = 32
#: Rows of one splitting key up to which its texts are never cut into stretches.
HOT_ROWS = 1000
_KEY = ["k_front", "k_size", "k_middle", "k_end"]
_STRETCH = [*_KEY, "stretch"]


def _id_order(keep: str) -> Column:
    return {"max": F.desc_nulls_last, "min": F.asc_nulls_last}[keep]("doc_id")


def content_sorted(rows: DataFrame, keep: str, hot_rows: int | None = None) -> DataFrame:
    """Rows with ``doc_id`` and ``body`` sorted by content; adds ``first`` (its neighbour's body differs) and ``run``.

    The splitting key is made of bytes of the body and its length, so equal
    bodies have equal keys and a long common beginning does not gather in one
    partition.  Keys that a count shows to have more rows than ``hot_rows``
    (default: a quarter of an even partition, ``HOT_ROWS`` at least) are cut into stretches of
    about that many, dealt by the row's place in the input; there are four such keys for
    each partition at most, the bound of their broadcast.  Spark samples splitters of
    (key, stretch), and each partition sorts its rows by key, stretch, body and
    id.  A row's neighbour is the one before it in its stretch; ``run`` numbers the stretches' different bodies.
    """
    parts = shuffle_partitions(rows.sparkSession)
    size = F.octet_length("body")
    data = F.col("body").cast("binary")
    keyed = rows.withColumns({
        "k_front": F.substring(data, 1, SPLIT_BYTES), "k_size": size,
        "k_middle": F.substring(data, F.floor(size / 2).cast("int") + 1, F.lit(SPLIT_BYTES // 2)),
        "k_end": F.right(data, F.lit(SPLIT_BYTES // 2)), "place": F.monotonically_increasing_id()})
    n = rows.count()
    limit = hot_rows or max(HOT_ROWS, n // (4 * parts))
    hot = (keyed.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
           .select(*_KEY, F.ceil(F.col("n") / limit).alias("stretches")))
    dealt = (keyed.join(F.broadcast(hot), _KEY, "left")
             .withColumn("stretches", F.coalesce("stretches", F.lit(1)))
             .withColumn("stretch", F.pmod(F.xxhash64("place"), F.col("stretches"))).drop("place"))
    order = Window.partitionBy(*_STRETCH).orderBy("body", _id_order(keep))
    return (dealt.repartitionByRange(parts, *_STRETCH)
            .withColumn("first", ~F.col("body").eqNullSafe(F.lag("body").over(order)))
            .withColumn("run", F.sum(F.col("first").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))))


def exact_dedup(docs: DataFrame, keep: str = "max", normalise=None, hot_rows: int | None = None) -> DataFrame:
    """Group equal texts; one row stays of each group.

    Returns one row for each row of ``docs``: ``doc_id``, ``keep_id`` (id of the
    row that stays), ``group_size``, ``kept``, ``text_sha256`` (of the normalised
    text; nothing is decided by it).  ``keep`` is ``"max"`` or ``"min"`` (the id that stays);
    ``normalise`` maps a text column to the text that is compared (default: unchanged).

    Rows are sorted by content (:func:`content_sorted`) and each is compared in
    full with its neighbour.  Equal texts of a key that is not hot are one run;
    of a hot key, one in each stretch.  The first row of each such run is sorted and
    compared in full once more, so a hot text costs one row a stretch there.

    Null text counts as empty.  A null id never wins over another id.  Of rows
    that repeat both id and text one is kept.  Extra columns are ignored; an
    empty table gives an empty result; a long text is one row, sorted outside memory if need be.
    """
    text: Column = F.coalesce(F.col("text"), F.lit(""))
    if normalise is not None:
        text = F.coalesce(normalise(text), F.lit(""))
    best = {"max": F.max, "min": F.min}[keep]
    run = Window.partitionBy(*_STRETCH, "run")
    members = materialize(
        content_sorted(docs.select("doc_id", text.alias("body")), keep, hot_rows)
        .select("doc_id", *_STRETCH, "run", "first", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"),
                F.when(F.col("first") & (F.col("stretches") > 1), F.col("body")).alias("head"))
        .withColumns({"n": F.count(F.lit(1)).over(run), "best": best("doc_id").over(run)}))
    order = Window.partitionBy(*_KEY).orderBy("head")
    same = Window.partitionBy(*_KEY, "text_no")
    merged = (members.filter("head is not null").select(*_STRETCH, "run", "head", "n", F.col("best").alias("doc_id"))
              .withColumn("new", ~F.col("head").eqNullSafe(F.lag("head").over(order)))
              .withColumn("text_no", F.sum(F.col("new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .select(*_STRETCH, "run", best("doc_id").over(same).alias("keep_id"), F.sum("n").over(same).alias("size"),
                      (F.row_number().over(same.orderBy(_id_order(keep), "stretch")) == 1).alias("stays")))
    one_run = F.col("size").isNull()
    return (members.join(merged, [*_STRETCH, "run"], "left")
            .select("doc_id", F.when(one_run, F.col("best")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("size", "n").cast("long").alias("group_size"),
                    (F.col("first") & F.coalesce("stays", F.lit(True))).alias("kept"), "text_sha256"))


def keep_one(docs: DataFrame, keep: str = "max", hot_rows: int | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    The same sorts and comparisons, with the rows themselves: the first row of each
    run stays, and of the runs of a hot key those that differ.  Nulls, ties,
    repeated rows, empty tables and long texts as there; columns of any name come back as they are.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"), F.isnull("text").alias("no_text"),
                       F.struct(*others).alias("row"))
    firsts = materialize(content_sorted(rows, keep, hot_rows).filter("first").drop("first", "run"))
    order = Window.partitionBy(*_KEY).orderBy("body", _id_order(keep), "stretch")
    hot = (firsts.filter("stretches > 1").withColumn("first", ~F.col("body").eqNullSafe(F.lag("body").over(order)))
           .filter("first").drop("first"))
    text = F.when(~F.col("no_text"), F.col("body")).alias("text")
    return firsts.filter("stretches = 1").unionByName(hot).select(
        *[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
