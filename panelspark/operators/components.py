"""Connected components of an edge table, computed by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the component's smallest node.

    Each round hooks every node to its smallest neighbour, shortens the resulting chains by
    pointer jumping, and replaces the edges by edges between roots. Rounds are logarithmic in the
    component size; nothing but counts reaches the driver. Self-loops keep a node as its own root;
    null ends are ignored; repeated edges count once. An empty edge table gives an empty result.
    Tables of earlier rounds are removed as soon as the next ones are written.
    """
    edges = edges.select("a", "b").dropna()
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = scratch.table(nodes.select("node", F.col("node").alias("root")), "roots")
    live = scratch.table(edges.filter("a <> b").distinct(), "edges")
    while not live.isEmpty():
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        parents = up = scratch.table(up, "parents")
        while True:
            over = up.select(F.col("a").alias("q"), F.col("p").alias("pp"))
            nxt = scratch.table(up.join(over, up.p == over.q, "left").select("a", F.col("pp").alias("p"), (F.col("pp") < F.col("p")).alias("moved")), "parents")
            moved = nxt.agg(F.max("moved")).first()[0]
            scratch.drop(parents)
            parents, up = nxt, nxt.select("a", "p")
            if not moved:
                break
        to = up.withColumnsRenamed({"a": "x", "p": "y"})
        joined = roots.join(to, roots.root == to.x, "left").select("node", F.coalesce("y", "root").alias("root"))
        old, roots = roots, scratch.table(joined, "roots")
        moved = live.join(to, live.a == to.x).select(F.col("y").alias("a"), "b")
        moved = moved.join(to, moved.b == to.x).select("a", F.col("y").alias("b"))
        moved = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        spent, live = live, scratch.table(moved.filter("a <> b").distinct(), "edges")
        scratch.drop(old, parents, spent)
    scratch.drop(live)
    return roots
