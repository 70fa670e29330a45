"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): each linked node and the least node of its component, without the least nodes themselves.

    links holds pairs (a, b) in any direction. The links stay a table throughout; each round writes it to the shared
    folder, and only its size and a checksum reach the driver. The rounds grow with the logarithm of the nodes.
    """
    links = links.where("a != b")
    before = None
    while True:
        links = materialise(_small_star(_large_star(links)), "links")
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 31)).alias("h")).first()
        if not now.n or now == before:
            return links
        before = now
