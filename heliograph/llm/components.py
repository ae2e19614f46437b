"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """node and component (smallest node that can be reached) for every node of links (a, b).

    Each round hangs a node's larger neighbours on its smallest (large star), then its smaller ones (small star);
    both only use a minimum for each node and a join with it, so a node with very many links is combined before
    exchanges and split by Spark's skew join. Rounds grow with the logarithm of the links. Each round is written
    to the shared folder. Links from a node to itself and nulls are ignored; repeats don't matter.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialise(pairs, "links")
    state = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
        pairs = materialise(small.where("a <> b").distinct(), "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return pairs.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
