"""Connected components of a written edge list, by alternating large-star and
small-star rounds.  Nothing is collected; a round is a pre-aggregated minimum
per node and an equi-join, and is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a, b), a > b: every node's neighbours (larger
    ones in a large star, smaller ones in a small star) go to its minimum."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("u"), F.least("a", "m").alias("m"))
    moved = both.join(least, both["a"] == least["u"])
    moved = moved.where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else (
        moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
    return moved.where("a > b").distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; ``edges`` holds pairs
    (a, b) of longs in any order, the component is its smallest node."""
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(),
                  "edges")
    mark = _mark(edges)
    while mark[0]:
        edges = stage(_star(_star(edges, True), False), "edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
