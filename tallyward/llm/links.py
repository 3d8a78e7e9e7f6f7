"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.staging import Shelf, keep


def components(links: DataFrame) -> DataFrame:
    """Label every node of ``links(a, b)`` with the smallest node it reaches.

    Returns ``node, label`` for nodes that have a link to another one. Links may repeat, come in either
    direction, or join a node to itself; rows with a null end are ignored. Each step only takes minima per
    node (combined before the shuffle) and joins them back, so a node with very many links is no bottleneck.
    """
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    down = down.where(links["a"].isNotNull() & links["b"].isNotNull() & (F.col("a") != F.col("b"))).distinct()
    shelf, seen = Shelf(links.sparkSession), None
    edges = shelf.put(down, "links")
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        old, shelf = shelf, Shelf(links.sparkSession)
        edges = shelf.put(small.where("a != b").distinct(), "links")
        old.drop()
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = keep(nodes.union(nodes.select(F.col("label").alias("node"), "label")).distinct(), "labels")
    shelf.drop()
    return out
