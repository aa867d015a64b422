"""Connected components by alternating large-star and small-star rounds on plain joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraforge.llm.common import stored


def _unsettled(edges: DataFrame) -> bool:
    """Whether a vertex hangs on two others, or on one and holds others itself: one aggregate over the vertices."""
    ends = edges.select(F.col("hi").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("lo").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    counts = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.agg(F.count_if(F.expr("up + down > 1"))).first()[0] > 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every vertex that has an edge to another; root is the least id reachable.

    Large star hangs each larger neighbour of a vertex on the least vertex around it, small star
    each smaller one; the edges converge to one star per component in O(log n) rounds. Minima are partial
    aggregates, and a vertex with very many edges is a hot key of an equi-join, which adaptive execution
    splits. Every round is a written table, so lineage stays short."""
    a, b = F.col(a), F.col(b)
    now = stored(edges.filter(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(),
                 "edges")
    while _unsettled(now):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, "u")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(lowest, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = stored(moved.unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
    roots = now.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct()
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionByName(roots)


class Forest:
    """Union-find over positions 0 to n - 1 of one bounded block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were in different trees, which are one from now on."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
