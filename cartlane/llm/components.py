"""Connected components by alternating large-star and small-star rounds, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlane.llm.common import written


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined to the least node around it."""
    both = _neighbours(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are joined to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return moved.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
        least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; the root is the least node that links reach. Rounds grow with
    the logarithm of the component size; each is written, so lineage stays short."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(),
                    "edges")
    seen = _mark(edges)
    for _ in range(rounds):
        edges = written(_small_star(_large_star(edges)), "edges")
        mark = _mark(edges)
        if mark == seen:
            stars = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        seen = mark
    raise RuntimeError("components did not settle")
