"""Connected components of a link table, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.session import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the least of its neighbourhood."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (both.join(least, "a").filter("b > a")
            .select(F.col("b").alias("a"), F.least("m", "a").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return (links.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))))


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of ``links`` (a, b) with a != b the least node of its component.

    Rounds of large-star and small-star (each node points at the least node it
    knows) turn every component into a star; the number of rounds grows with the
    logarithm of its size.  Each round is written, so lineage does not grow, and
    the driver sees two numbers of it.  Minima are combined before the shuffle,
    and the joins with them are plain equality joins whose hot nodes adaptive
    execution splits.
    """
    links = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = materialize(links), None
    while True:
        state = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if state == before or not state.n:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
        links = materialize(_small_star(_large_star(links).distinct()).distinct())
