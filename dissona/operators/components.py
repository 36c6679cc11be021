"""Connected components of an edge table by alternating large-star and small-star steps, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissona.sources.scratch import discard, stored


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b): each node's neighbours are tied to the smallest of its neighbourhood."""
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node of edges (a long, b long) reaches.

    Nodes without an edge are absent. Loops and repeated edges do no harm. The edges of every round are written to the
    shared folder, which cuts the lineage; the number of rounds grows with the logarithm of the longest path."""
    edges = edges.where("a != b")
    last = before = None
    while True:
        edges = stored(_step(_step(edges, True), False), "edges")
        if before is not None:
            discard(before)
        before = edges
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    stars = edges.groupBy("a").agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("id")).distinct().join(stars.select(F.col("a").alias("id")), "id", "left_anti")
    return stars.select(F.col("a").alias("id"), "component").unionAll(roots.select("id", F.col("id").alias("component")))
