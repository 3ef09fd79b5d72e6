"""Connected components of a link table, by contraction towards random neighbours of lower order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayread.llm.common import settle


def connected(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) -> (node, component): for each node in a link, the smallest node that it reaches.

    Every round gives each node the neighbour (or itself) of lowest random order and merges it into that one, so long
    chains shrink by a constant factor and a star of any size is gone in one round. A round takes a partial aggregation
    and joins on node ids; nothing holds all neighbours of a node together. Null ends and self links are ignored, repeated
    links count once, no links give an empty table.
    """
    edges = settle(links.where("a is not null and b is not null and a <> b").select(
        F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct())
    label = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("now"))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        order = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: B023, E731
        both = edges.union(edges.select("b", "a"))
        into = both.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b").alias("to"))).alias("m"))
        into = into.select(F.col("a").alias("old"), F.when(F.col("m.o") < order("a"), F.col("m.to")).otherwise(F.col("a")).alias("new"))
        # one hop further: a node whose target itself moves goes along
        hop = into.select(F.col("old").alias("new"), F.col("new").alias("next"))
        into = settle(into.join(hop, "new", "left").select("old", F.coalesce("next", "new").alias("new")))
        label = label.join(into, label.now == into.old, "left").select("node", F.coalesce("new", "now").alias("now"))
        edges = settle(
            edges.join(into.select(F.col("old").alias("a"), F.col("new").alias("x")), "a")
            .join(into.select(F.col("old").alias("b"), F.col("new").alias("y")), "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    label = settle(label)
    smallest = label.groupBy("now").agg(F.min("node").alias("component"))
    return settle(label.join(smallest, "now").select("node", "component"))
