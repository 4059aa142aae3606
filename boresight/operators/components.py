"""Connected components of links by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stored


def components(links: DataFrame) -> DataFrame:
    """links (a, b), any order, repeats and loops allowed -> (node, component), the least node reachable; a row for each linked node.

    Each round hangs every node below the least neighbour it knows, which takes a number of rounds logarithmic in the longest
    path. A hub's neighbours are never gathered in a row: each step is a minimum (combined before the shuffle) and a join.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "large")
        least = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("k")).where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        old, edges = edges, stored(small.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), "small")
        discard(old, large)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
