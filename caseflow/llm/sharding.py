"""Sharding into contiguous stretches of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.running import running_totals
from caseflow.session import materialize

SHARDS = 8
#: A group of equal texts that a cut would part goes to one shard whole if it is no more than this share of a shard.
GROUP_SLACK = 1 / 32


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, group_slack: float = GROUP_SLACK) -> DataFrame:
    """Place each row of ``docs`` in one of ``shards`` contiguous shards of nearly equal bytes.

    Returns doc_id, ``size`` (UTF-8 bytes of the text + 1), ``text_crc32``, ``law``
    (``bytes``), ``shard``, ``slot`` (place in the shard, gapless from 0) and
    ``grown_shard`` (null: this law does not say where rows go with more shards).

    Rows are put in the order of (MD5 of the text, id), which keeps equal texts
    together and spreads sources evenly.  Global prefix sums of the sizes come
    from per-partition totals, and a row goes to the shard that holds its middle
    byte.  A cut can fall inside a group of equal texts, at most ``shards - 1``
    of them: a group of up to ``group_slack`` of a shard's target then stays
    whole on the side of its middle, a larger one is parted at the cut, since its
    weight would tip the balance.  The range partitioner looks at the id too, so
    a text shared by a third of all rows spreads over many tasks.

    Null text counts as empty and has size 1.  Rows that repeat an id and a text
    get slots of their own in arbitrary order.  Extra columns are ignored.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body).cast("long").alias("text_crc32"), F.md5(body).alias("digest"))
    placed = materialize(
        running_totals(rows, ["digest", "doc_id"], "size")
        .withColumn("shard", F.expr(f"(2 * before + size) * {shards} div (2 * total)").cast("int")))
    parted = (placed.groupBy("digest")
              .agg(F.min("shard").alias("low"), F.max("shard").alias("high"), F.min("before").alias("start"),
                   F.sum("size").alias("bytes"), F.max("total").alias("total"))
              .filter((F.col("low") < F.col("high")) & (F.col("bytes") * shards <= group_slack * F.col("total")))
              .select("digest", F.expr(f"(2 * start + bytes) * {shards} div (2 * total)").cast("int").alias("whole")))
    settled = (placed.join(F.broadcast(parted), "digest", "left")  # a row for each cut at most
               .withColumn("shard", F.coalesce("whole", "shard")))
    first = settled.groupBy("shard").agg(F.min("row_no").alias("first"))
    return (settled.join(F.broadcast(first), "shard")  # a row for each shard
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("row_no") - F.col("first")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
