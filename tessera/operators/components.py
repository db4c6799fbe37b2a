"""Connected components by alternating large-star and small-star contraction.

Every step is a grouped minimum followed by an equi-join, so a hub of any degree is pre-aggregated
before the shuffle and its rows can be split by AQE; nothing is collected but two counters a round. Where the counters stay as
they were, the edges of both rounds are compared themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a")
    hang = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hang.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node reachable.

    Null ends and self loops add no link (a node with only a self loop is its own component). Node ids may
    be of any orderable type. An empty input gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    pairs = cut(pairs.distinct())
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    star, seen = pairs.filter("a <> b"), None
    for _ in range(max_rounds):
        star, before = cut(_small_star(_large_star(star))), star
        state = tuple(star.agg(F.count("*"), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0))).first())
        if state == seen and star.join(before, ["a", "b"], "left_anti").isEmpty():  # distinct edges, as many in both
            break
        seen = state
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = star.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
