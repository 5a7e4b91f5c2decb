"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is tied to the least node of u's neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the least of them (edges have a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(moved).distinct()


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Nodes (``node``) with the least node of their component (``label``).

    ``edges`` has two long columns ``a`` and ``b``; loops, null ends and
    repeated edges are ignored.  Only nodes with an edge to another node are
    returned.  Each round is one large-star and one small-star step over
    aggregates with map-side combine and joins; a round's edges are written
    to the checkpoint folder, so no lineage grows and no node's neighbour
    list is ever held in one task.  Rounds end when the edges stand still.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct())
    before = None
    for _ in range(most_rounds):
        edges = cut_lineage(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("xxhash64(b, a) % 1000003"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
