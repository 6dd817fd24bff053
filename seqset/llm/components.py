"""Connected components of a distributed edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqset.session import saved


def _state(edges: DataFrame) -> tuple:
    """Count and order-free sum of the edges; equal states mean that a round changed nothing."""
    mark = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mark)).first())


def _towards(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Each edge with the smallest node that `node` can see, itself included."""
    least = edges.groupBy(node).agg(F.least(F.col(node), F.min(other)).alias("least"))
    return edges.join(least, node)


def component_roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b); root is the smallest node of its component.

    Large-star and small-star steps alternate until the edges are stars. Every step is a
    grouped minimum, pre-aggregated before its shuffle, and a join that Spark may split where
    a node has very many edges. The edges of each round are written out, so that lineage stays
    short and a lost executor costs one round. Null nodes and loops are left out; an empty
    table gives an empty table.
    """
    now = saved(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct())
    before = _state(now)
    while before[0]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _towards(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        seen = _towards(large, "a", "b")
        small = (
            seen.select(F.col("b").alias("a"), F.col("least").alias("b"))
            .union(seen.select("a", F.col("least").alias("b")))
            .where("a <> b")
            .distinct()
        )
        now = saved(small)
        after = _state(now)
        if after == before:
            break
        before = after
    rows = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return rows.union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
