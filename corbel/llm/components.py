"""Connected components by contraction, as DataFrame joins; nothing is collected but counts.

Each round hooks every node to its least neighbour (or itself), shortens those pointers until they end at roots, maps
the edges to roots and drops what has become equal. Rounds go on until no edge is left; the number of nodes with an
edge at least halves each round. Minima are pre-aggregated on the map side, and joins are plain equi-joins, which
adaptive execution splits when a root is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component. Loops and repeats are allowed."""
    pairs = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    pairs = settle(pairs, "cc-edges")
    roots = None
    while True:
        loops = pairs.filter("u <> v")
        if loops.isEmpty():
            break
        both = loops.select("u", "v").unionByName(loops.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = settle(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("p")).withColumnRenamed("u", "node"), "cc-hook")
        while True:  # pointer jumping: depth halves each time
            up = hook.select(F.col("node").alias("p"), F.col("p").alias("q"))
            nxt = settle(hook.join(up, "p").selectExpr("node", "q AS p", "p <> q AS moved"), "cc-jump")
            hook = nxt.select("node", "p")
            if nxt.filter("moved").isEmpty():
                break
        if roots is None:
            roots = hook.selectExpr("node", "p AS root")
        else:
            up = hook.selectExpr("node AS root", "p")
            roots = settle(roots.join(up, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "cc-roots")
        left, right = hook.selectExpr("node AS u", "p AS pu"), hook.selectExpr("node AS v", "p AS pv")
        pairs = settle(loops.join(left, "u").join(right, "v").filter("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "cc-pairs")
    if roots is None:
        return pairs.select(F.col("u").alias("node"), F.col("u").alias("root"))
    return roots
