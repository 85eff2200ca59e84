"""Connected components of a large graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release, stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b. Each node's neighbours get the smallest node known to it; no node's neighbours are ever gathered."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = edges.join(least, "a")
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(linked.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Rounds grow with the logarithm of a component's size. Each round is written to the shared folder, where it replaces
    the one before it. Edges with a null end are left out; an empty table gives an empty result.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = stash(edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter("a > b").distinct(), "cc")
    seen = None
    while True:
        before, now = now, stash(_star(_star(now, True), False), "cc")
        discard(before)
        release(edges.sparkSession)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
