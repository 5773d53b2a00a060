"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import discard, stage

MAX_ROUNDS = 100
#: Edges from which the minima of neighbourhoods are written before they are joined, so that a hub's rows can be split.
LARGE = 1_000_000


def _star(edges: DataFrame, large: bool, many: bool) -> DataFrame:
    """One star step over edges ``(u, v)`` with ``u > v``: link the neighbours of a node to its smallest.

    The minimum of a neighbourhood is pre-aggregated before its shuffle. With many edges it is written, and
    the following join has an exchange on both sides.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    low = stage(low, "star") if many else low
    linked = both.join(low, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "i", dst: str = "j") -> DataFrame:
    """``(node, component)`` for every node that has an edge; the component is its smallest node.

    Self-loops, repeated edges, either edge direction and nulls (ignored) are accepted. The number of
    rounds grows with the logarithm of a component's size, not with its diameter.
    """
    valid = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    loops = valid.where(F.col(src) == F.col(dst)).select(F.col(src).alias("node"))
    current = stage(valid.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        after = tuple(current.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if after == before or after[0] == 0:
            break
        before, many = after, after[0] > LARGE
        large = _star(current, True, many)
        small = stage(_star(stage(large, "large") if many else large, False, many), "small", rows=2 * after[0])
        discard(current)
        current = small
    else:
        raise RuntimeError("components did not converge")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return nodes.union(loops.select("node", F.col("node").alias("component"))).groupBy("node").agg(
        F.min("component").alias("component"))
