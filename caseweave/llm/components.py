"""Connected components of a link table, by alternating star contractions.

Each round sends every node's larger neighbours to its smallest neighbour, then
its smaller ones; the links shrink to stars in a number of rounds that grows
with the logarithm of the longest path. A round is two minima with partial
aggregation and two joins, and is written to the shared folder. One aggregation
tells whether the links are stars, so links that are stars already take no round.
Nodes may be of any type with an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import materialise


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Links of each node's larger (or smaller) neighbours with the least of node and neighbours."""
    near = _both(links)
    if not larger:
        near = near.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    moved = near.join(least, "a")
    if larger:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select("a", F.col("m").alias("b"))
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    return out.where("a <> b").distinct()


def _settled(held: DataFrame) -> bool:
    """Whether links (a, b) with a > b are stars: each a has one link and none ends another."""
    ends = held.select("a", F.lit(1).alias("n")).unionByName(
        held.select(F.col("b").alias("a"), F.lit(0).alias("n"))
    )
    more = ends.groupBy("a").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    return more.where((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("least") == 0))).isEmpty()


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for links (a, b); component is the least node reachable."""
    held = materialise(
        links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
        .where("a <> b").distinct(),
        "links",
    )
    rounds = 0
    while not _settled(held):
        if rounds == max_rounds:
            raise RuntimeError("links did not settle")
        held = materialise(_star(_star(held, True), False), "stars")
        rounds += 1
    node = held.select(F.col("a").alias("node"), F.col("b").alias("component"))
    root = held.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return node.unionByName(root)
