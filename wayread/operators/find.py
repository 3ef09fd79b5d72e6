"""Finding by meaning: matches, literal hits, summaries and stepping through matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayread.constants import DEFAULT_THRESHOLD, WS_CHARS
from wayread.functions.scoring import tier
from wayread.operators.digest import GROUP, threshold_grid


def literal(text: Column, query: Column) -> Column:
    """Case-folded substring test."""
    return F.contains(F.lower(text), F.lower(query))


def flag_literal(items: DataFrame, query_col: str = "question") -> DataFrame:
    return items.withColumn("is_literal", literal(F.col("text"), F.trim(query_col, F.lit(WS_CHARS))))


def find_matches(
    judged: DataFrame, query_col: str = "question", threshold: float | Column = DEFAULT_THRESHOLD
) -> DataFrame:
    """Items at or above the threshold with their tier and whether a literal search finds them too."""
    return flag_literal(judged.where(F.col("p") >= threshold), query_col).withColumn("tier", tier(F.col("p")))


def find_summary(
    judged: DataFrame, query_col: str = "question", threshold: float | Column = DEFAULT_THRESHOLD,
    group: Sequence[str] = GROUP,
) -> DataFrame:
    """Matches, literal hits and matches only meaning finds, per run. One aggregation, no set operation."""
    hit = F.coalesce(F.col("p") >= threshold, F.lit(False))
    return flag_literal(judged, query_col).groupBy(*group).agg(
        F.count_if(hit).alias("n_matches"),
        F.count_if("is_literal").alias("n_literal"),
        F.count_if(hit & ~F.col("is_literal")).alias("n_only_here"),
    )


def semantic_only(matches: DataFrame) -> DataFrame:
    return matches.where(~F.col("is_literal"))


def literal_and_semantic(matches: DataFrame) -> DataFrame:
    return matches.where("is_literal")


def find_sweep(
    judged: DataFrame, thresholds: Sequence[float] | None = None, group: Sequence[str] = GROUP, query_col: str | None = None
) -> DataFrame:
    """Number of matches of every run at every threshold, from one pass over the judgments.

    With ``query_col`` also the literal hits, which no threshold changes, and the matches that only meaning finds.
    """
    grid = list(thresholds or threshold_grid())
    items = judged if query_col is None else flag_literal(judged, query_col)
    only = F.lit(False) if query_col is None else ~F.col("is_literal")
    at = [F.col("p") >= t for t in grid]
    counts = F.array(*[F.struct(F.count_if(hit).alias("n_matches"), F.count_if(hit & only).alias("n_only_here")) for hit in at])
    literal_hits = F.count_if(F.lit(False) if query_col is None else F.col("is_literal"))
    level = F.get(F.array(*[F.lit(t) for t in grid]), F.col("at")).alias("threshold")
    each = items.groupBy(*group).agg(counts.alias("n"), literal_hits.alias("n_literal")).select(*group, "n_literal", F.posexplode("n").alias("at", "n"))
    if query_col is None:
        return each.select(*group, level, "n.n_matches")
    return each.select(*group, level, "n.n_matches", "n_literal", "n.n_only_here")


def top_matches(matches: DataFrame, k: int) -> DataFrame:
    """The ``k`` most probable matches of the whole corpus."""
    return matches.orderBy(F.desc("p"), F.asc("doc_id"), F.asc("question_id"), F.asc("idx")).limit(k)


def match_navigation(matches: DataFrame, group: Sequence[str] = GROUP, chunk: int = 4096) -> DataFrame:
    """Adds ``match_no``, ``n_matches``, ``prev_idx`` and ``next_idx``; stepping past an end wraps around.

    Neighbours are looked up inside chunks of consecutive items; a second window over one row per chunk
    joins the chunks, so a run with very many matches is not sorted in one task.
    """
    key = [*group, "chunk"]
    parts = matches.withColumn("chunk", F.floor(F.col("idx") / F.lit(chunk)))
    inside = Window.partitionBy(*key).orderBy("idx")
    local = parts.withColumns(
        {"local_no": F.row_number().over(inside), "lag": F.lag("idx").over(inside), "lead": F.lead("idx").over(inside)}
    )
    whole = Window.partitionBy(*group)
    across = whole.orderBy("chunk")
    ends = (
        parts.groupBy(*key)
        .agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n"))
        .withColumns(
            {
                "before": F.coalesce(F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                "n_matches": F.sum("n").over(whole),
                "prev_last": F.coalesce(F.lag("last").over(across), F.max("last").over(whole)),
                "next_first": F.coalesce(F.lead("first").over(across), F.min("first").over(whole)),
            }
        )
        .drop("first", "last", "n")
    )
    return (
        local.join(ends, key)
        .withColumns(
            {
                "match_no": F.col("before") + F.col("local_no"),
                "prev_idx": F.coalesce("lag", "prev_last"),
                "next_idx": F.coalesce("lead", "next_first"),
            }
        )
        .drop("chunk", "local_no", "lag", "lead", "before", "prev_last", "next_first")
    )
