"""Connected components by contraction, with joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join


def components(edges: DataFrame) -> DataFrame | None:
    """edges (a, b) to (node, root), root the least node that links lead to; None without edges. In each round a
    node points to its least neighbour, or itself if that is less; pointers are doubled until all lead to the
    least node of their tree, and edges are carried over to there. Each tree has two nodes at least, so half of
    the nodes are gone after each round, and hubs are only ever aggregated or joined to one row."""
    rest = cut(edges.filter("a != b").select("a", "b").distinct())
    maps = []
    while n := rest.count():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("to")), 2 * n)
        while True:
            step = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
            to = cut(join(to, step, "to", rows=2 * n).select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), 2 * n)
            if to.filter("moved").isEmpty():
                break
            to = to.select("node", "to")
        to = to.select("node", "to")
        maps.append((to, n))
        moved = join(rest, to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a", rows=2 * n)
        moved = join(moved, to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b", rows=2 * n)
        rest = cut(moved.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), n)
    if not maps:
        return None
    out = maps[0][0].select("node", F.col("to").alias("root"))
    for to, n in maps[1:]:
        step = to.select(F.col("node").alias("root"), F.col("to").alias("next"))
        out = join(out, step, "root", "left", 2 * n).select("node", F.coalesce("next", "root").alias("root"))
    return cut(out, 2 * maps[0][1])
