"""Connected components of a graph that is a table of edges, by contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): two nodes have one root where a path joins them. Loops don't count.

    In each round a node becomes the least of itself and its neighbours, by value and by a fresh hash in turn: stars go
    in one round, and long paths shrink by a share in each. What is left of the graph is written in every round; a hub's
    neighbours are reduced before the shuffle.
    """
    live = stored(edges.select("a", "b").filter("a <> b"), "edges")
    total, turn = None, 0
    while not live.isEmpty():
        rank = F.xxhash64(F.lit(turn), F.col("b")) if turn % 2 else F.lit(0).cast("long")
        own = F.xxhash64(F.lit(turn), F.col("a")) if turn % 2 else F.lit(0).cast("long")
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(rank.alias("rank"), F.col("b").alias("node"))).alias("near"))
        step = stored(least.select("a", F.least("near", F.struct(own.alias("rank"), F.col("a").alias("node")))["node"].alias("r")), "step")
        if total is None:
            total = step.select(F.col("a").alias("node"), F.col("r").alias("root"))
        else:
            total = stored(total.join(step, total.root == step.a, "left").select("node", F.coalesce("r", "root").alias("root")), "roots")
        left, right = step.select("a", F.col("r").alias("ra")), step.select(F.col("a").alias("b"), F.col("r").alias("rb"))
        live = stored(live.join(left, "a").join(right, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        turn += 1
    if total is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return total
