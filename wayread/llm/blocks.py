"""Dealing the members of groups into tiles, so that all pairs of a group are met tile by tile and no task holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayread.llm.common import settle


def tile_pairs(rows: DataFrame, group: str, key: str, tile: int) -> DataFrame:
    """``rows`` for each pair of tiles of their group: with ``low``, ``high`` (the pair) and ``mine`` (the row's own tile).

    A group of n rows has about n / ``tile`` tiles, dealt by a hash of ``key``; each row goes to as many pairs as its group
    has tiles. ``group`` and ``key`` hold no nulls.
    """
    sizes = settle(rows.groupBy(F.col(group).alias("of")).agg(F.ceil(F.count("*") / F.lit(float(tile))).cast("int").alias("tiles")))
    mine = F.pmod(F.xxhash64(key), F.col("tiles")).cast("int")
    dealt = rows.join(sizes, F.col(group) == F.col("of")).withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other")).drop("of", "tiles", "other")


class Forest:
    """Links found so far within one task: which rows they join, and those links that joined something new."""

    def __init__(self, size: int):
        self.up, self.links = list(range(size)), []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((x, y))
