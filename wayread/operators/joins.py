"""Joins that stay balanced when one key owns a large share of the rows.

Nothing here is broadcast by order. Spark broadcasts a side when its measured size allows it; the functions
make sure that the shuffled join, used beyond that size, does not put a hot key into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8
#: Parts of a task's share of rows by which hot keys are dealt out; many small parts even out over the tasks.
PIECES = 32
SPREAD_BY = ("doc_id", "question_id", "idx", "window_no")


def _checked(how: str) -> str:
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    return how


def lookup_join(
    facts: DataFrame, lookup: DataFrame, key: str, how: str = "inner", salts: int = SALTS,
    spread_by: Sequence[str] = SPREAD_BY,
) -> DataFrame:
    """Join with a table that has one row per key and is small next to ``facts``, such as questions.

    Every key is spread over ``salts`` tasks and the lookup repeated as often.
    """
    own = [c for c in spread_by if c in facts.columns and c != key]
    if salts <= 1 or not own:
        return facts.join(lookup, key, _checked(how))
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*own), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [key, "_salt"], _checked(how)).drop("_salt")


def hot_key_join(
    facts: DataFrame, lookup: DataFrame, key: str, how: str = "inner", hot_rows: int | None = None,
    spread_by: Sequence[str] = SPREAD_BY,
) -> DataFrame:
    """Join with a table that has one row per key and is large itself.

    Keys are hot that own more rows than ``hot_rows``, by default a ``PIECES``-th of what a task of the join would have if all
    were alike. They are spread over as many salts as they own such parts, and only their lookup rows are repeated. Counting
    the keys, in one aggregation that merges on each task, reads ``facts`` once more: hand in a stored table.
    """
    own = [c for c in spread_by if c in facts.columns and c != key]
    counts = facts.groupBy(key).agg(F.count("*").alias("_n"))
    if hot_rows is None:
        parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        most = F.greatest(F.lit(1), F.ceil(counts.agg(F.sum("_n")).scalar() / F.lit(parts * PIECES)))
    else:
        most = F.lit(hot_rows)
    hot = counts.where(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_salts"))
    if hot_rows is None:
        hot = F.broadcast(hot)  # each owns one of parts * PIECES shares, so there are no more than that
    salted = facts.join(hot, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*own), F.coalesce("_salts", F.lit(1))).cast("int")
    )
    repeated = lookup.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    )
    return salted.drop("_salts").join(repeated.drop("_salts"), [key, "_salt"], _checked(how)).drop("_salt")
