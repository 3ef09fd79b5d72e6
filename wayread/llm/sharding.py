"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayread.llm.common import settle

#: Rows that a ranking cell holds on average.
CELL = 1024


def _ranked(rows: DataFrame, group: list[str], at: str, order: list[str], cells: int, name: str) -> DataFrame:
    """``rows`` with ``name``: the rank from 0 within ``group`` by ``order``, whose first key ``at`` is even in [0, 1).

    Rows are numbered within cells of ``at`` and cells by running counts, so no task sorts a whole group.
    """
    rows = rows.withColumn("cell", F.least(F.lit(cells - 1), F.floor(F.col(at) * cells)).cast("long"))
    counts = rows.groupBy(*group, "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(g).alias(f"{g}_") for g in group], F.col("cell").alias("cell_"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    same = F.col("cell") == F.col("cell_")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_"))
    local = F.row_number().over(Window.partitionBy(*group, "cell").orderBy(*order)) - 1
    return rows.withColumn("local", local).join(counts, same).withColumn(name, F.col("before") + F.col("local")).drop(
        "cell", "cell_", "before", "local", *[f"{g}_" for g in group])


def fractional_rank(rank: Column, rows: Column, seed: int) -> Column:
    """Place of a row in [0, 1) by its rank in its source: drawn within the middle half of its slot.

    Sources of equal size would have equal places otherwise, and all their rows one cell. A stretch of all places holds
    its share of a source's rows to within one and a half, as slots are not left.
    """
    drawn = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit(seed + 1)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return (rank + 0.25 + drawn / 2) / rows


def interleaved(documents: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """``documents`` (doc_id, text, source) -> doc_id, source, size, text_crc32, shard, slot.

    Within each source rows are shuffled by a seeded hash and ranked; the fractional rank, from (rank + 1/4) / rows of the
    source to (rank + 3/4) / rows, orders all rows, and the order is cut into ``shards`` stretches whose counts differ by one at most. Each stretch then
    holds every source in its share of the whole. ``slot`` is the place in the shard, without gaps from 0.

    Null texts count as empty (size 1); null sources are a source; null and repeated ids are rows like others, ties go by
    size and checksum and beyond that are between equal rows. Other columns are not looked at. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = settle(documents.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"),
                                   F.crc32(text.cast("binary")).alias("text_crc32")))
    total = rows.count()
    cells = max(1, total // CELL)
    shuffled = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rows = rows.withColumn("draw", shuffled)
    sizes = rows.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("of"))
    ties = ["doc_id", "size", "text_crc32"]
    ranked = _ranked(rows, ["source"], "draw", ["draw", *ties], cells, "rank").join(sizes, F.col("source").eqNullSafe(F.col("s")))
    ranked = settle(ranked.withColumn("part", fractional_rank(F.col("rank"), F.col("of"), seed)).drop("s", "of", "rank"))
    placed = _ranked(ranked, [], "part", ["part", "draw", "source", *ties], cells, "place")
    shard = F.floor(F.col("place") * shards / F.lit(max(total, 1)))
    # rows before a shard: the smallest place with place * shards >= shard * total
    first = F.ceil(shard * F.lit(max(total, 1)) / shards)
    return placed.select("doc_id", "source", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("place") - first).cast("long").alias("slot"))
