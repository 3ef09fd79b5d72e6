"""Reading paths: role-diverse selection, the catch, signal shares and threshold sweeps.

``judged`` holds one row per judged item: ``doc_id, question_id, idx, text, p, role, role_p`` and whatever
else the caller wants to carry along. A reading path belongs to one ``(doc_id, question_id)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayread.constants import (
    DEFAULT_THRESHOLD,
    IRRELEVANT,
    MAX_PATH,
    MIN_PATH,
    ROLE_NAMES,
    SECOND_PASS_FLOOR,
    SWEEP_HUNDREDTHS,
)
from wayread.functions.scoring import digest_score, is_catch_role, label, needed
from wayread.functions.text import word_count

GROUP = ("doc_id", "question_id")
#: Ranks of a role that a selection can reach.
REACH = MAX_PATH + len(ROLE_NAMES) - 1
#: Parts of a sweep for each partition of a shuffle.
SWEEP_PARTS = 4


def select_digest(
    judged: DataFrame, threshold: float | Column = DEFAULT_THRESHOLD, group: Sequence[str] = GROUP
) -> DataFrame:
    """Selected items with ``ord, score, is_catch, label``, in source order within each group.

    The best item of every role is taken first. Then the ranking by score is walked: items are added until
    the path is full, and the walk ends at the first item whose relevance is under the floor once the path
    has its minimum, whether or not that item was taken already.

    Everything the walk can reach lies within the first ``MAX_PATH`` + number of roles ranks. Limiting each
    role to that many rows is therefore exact, and Spark applies such a rank limit before the shuffle
    (WindowGroupLimit), so a group with a third of all rows still sends only a few rows per task.
    """
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    score = digest_score(F.col("p"), F.col("role"), F.col("role_p"))
    best_first = [F.desc("score"), F.asc("idx")]
    in_role = Window.partitionBy(*group, "role").orderBy(*best_first)
    shortlist = (
        judged.where(F.col("p").isNotNull() & (F.col("p") >= cut) & needed(F.col("role")))
        .withColumn("score", score)
        .withColumn("role_rank", F.row_number().over(in_role))
        .where(F.col("role_rank") <= REACH)
    )

    whole = Window.partitionBy(*group)
    ranked = whole.orderBy(*best_first)
    is_best = (F.col("role_rank") == 1) & F.col("role").isin(ROLE_NAMES)
    walked = (
        shortlist.withColumn("best", is_best)
        .withColumns(
            {
                "rank": F.row_number().over(ranked),
                "chosen": F.count_if(F.col("best")).over(whole)
                + F.count_if(~F.col("best")).over(ranked.rowsBetween(Window.unboundedPreceding, -1)),
            }
        )
        .withColumn(
            "stop",
            F.min(
                F.when(
                    (F.col("chosen") >= MIN_PATH) & (F.col("p") < F.greatest(F.lit(SECOND_PASS_FLOOR), cut)),
                    F.col("rank"),
                )
            ).over(whole),
        )
    )
    kept = walked.where(
        F.col("best")
        | ((F.col("stop").isNull() | (F.col("rank") < F.col("stop"))) & (F.col("chosen") < MAX_PATH))
    )
    numbered = kept.withColumn("ord", F.row_number().over(whole.orderBy("idx")))
    return mark_catch(numbered, group).drop("role_rank", "best", "rank", "chosen", "stop")


def mark_catch(selected: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Flag the best qualification or counterpoint of each path and label every item."""
    contender = is_catch_role(F.col("role"))
    order = Window.partitionBy(*group).orderBy(F.desc(contender), F.desc("score"), F.asc("idx"))
    return (
        selected.withColumn("is_catch", contender & (F.row_number().over(order) == 1))
        .withColumn("label", label(F.col("role"), F.col("is_catch")))
    )


def signal_stats(
    judged: DataFrame, threshold: float | Column = DEFAULT_THRESHOLD, group: Sequence[str] = GROUP
) -> DataFrame:
    """Words of judged items and of those that are needed, per group, and their ratio to four digits.

    Items that come with their number of ``words`` need no text.
    """
    words = F.col("words") if "words" in judged.columns else word_count(F.col("text")).cast("long")
    hit = (F.col("p") >= threshold) & needed(F.col("role"))
    return (
        judged.select(*group, words.alias("words"), "p", "role")
        .groupBy(*group)
        .agg(
            F.coalesce(F.sum(F.when(F.col("p").isNotNull(), F.col("words"))), F.lit(0)).alias("judged_words"),
            F.coalesce(F.sum(F.when(hit, F.col("words"))), F.lit(0)).alias("signal_words"),
        )
        .withColumn("signal_ratio", _ratio())
    )


def _ratio() -> Column:
    return F.when(
        F.col("judged_words") > 0, F.bround(F.col("signal_words") / F.col("judged_words"), 4)
    )


def threshold_grid(hundredths: Sequence[int] = SWEEP_HUNDREDTHS) -> list[float]:
    first, last, step = hundredths
    return [n / 100 for n in range(first, last + 1, step)]


def threshold_sweep(
    judged: DataFrame, thresholds: Sequence[float] | None = None, group: Sequence[str] = GROUP
) -> DataFrame:
    """Path size, catch and signal of every group at every threshold, from judgments already made.

    Signal is one aggregation with a column per threshold. Selections change only where a threshold passes the ``p`` of an
    item, so items between two thresholds of the grid are alike: of each role the best of such a level hold back all others
    at every threshold these reach. Only they are shuffled, once and without their text, however long the grid is; they are
    repeated for their thresholds where their run has been brought together, in parts so small that the repeated rows, which
    every window sorts, still fit.
    """
    grid = sorted(set(thresholds or threshold_grid()))
    words = word_count(F.col("text")).cast("long")
    slim = judged.select(*group, "idx", "p", "role", "role_p", words.alias("words"))
    ok = needed(F.col("role"))

    # thresholds are keyed by their place in the grid: whole numbers partition, group and join alike
    levels = F.array(*[F.lit(t) for t in grid])
    per_level = F.array(*[F.coalesce(F.sum(F.when(ok & (F.col("p") >= t), F.col("words"))), F.lit(0)) for t in grid])
    signal = (
        slim.groupBy(*group)
        .agg(
            F.coalesce(F.sum(F.when(F.col("p").isNotNull(), F.col("words"))), F.lit(0)).alias("judged_words"),
            per_level.alias("per_level"),
        )
        .select(*group, "judged_words", F.posexplode("per_level").alias("level", "signal_words"))
        .withColumn("signal_ratio", _ratio())
    )

    # the grid ascends, so the thresholds an item reaches are its first ones
    reached = F.size(F.filter(levels, lambda t: t <= F.col("p")))
    best = Window.partitionBy(*group, "role", "reached").orderBy(F.desc("score"), F.asc("idx"))
    able = slim.where(ok & F.col("p").isNotNull()).select(
        *group, "idx", "p", "role", "role_p", reached.alias("reached"), digest_score(F.col("p"), F.col("role"), F.col("role_p")).alias("score")
    )
    shortlist = able.where(F.col("reached") > 0).withColumn("place", F.row_number().over(best)).where(F.col("place") <= REACH)
    parts = int(judged.sparkSession.conf.get("spark.sql.shuffle.partitions")) * SWEEP_PARTS
    by_level = shortlist.repartition(parts, *group).select(
        *group, "idx", "p", "role", "role_p", F.posexplode(F.slice(levels, 1, F.col("reached"))).alias("level", "cut")
    )
    key = [*group, "level"]
    paths = (
        select_digest(by_level, F.col("cut"), key)
        .groupBy(*key)
        .agg(F.count("*").alias("n_selected"), F.max(F.when(F.col("is_catch"), F.col("idx"))).alias("catch_idx"))
    )
    return signal.join(paths, key, "left").select(
        *group, F.get(levels, F.col("level")).alias("threshold"), "judged_words", "signal_words", "signal_ratio",
        F.coalesce("n_selected", F.lit(0)).alias("n_selected"), "catch_idx",
    )


def reading_path(selected: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """One row per selected item, as it is shown to a reader."""
    extra = [F.col("quads")] if "quads" in selected.columns else []
    confidence = F.col("confidence") if "confidence" in selected.columns else F.lit(None).cast("double")
    return selected.select(
        *group, "ord", "idx", "page", "role", "label",
        F.coalesce("p", F.lit(0.0)).alias("p"),
        F.coalesce("role_p", F.lit(0.0)).alias("role_p"),
        F.coalesce(confidence, F.lit(0.0)).alias("confidence"),
        "score", "text", F.when(F.col("heading") != "", F.col("heading")).alias("heading"), "is_catch", *extra,
    )


def digest_summary(path: DataFrame, signal: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Selected count, distinct labels in path order and signal per cent, for every judged group."""
    ordered = F.sort_array(F.collect_list(F.struct("ord", "label")))
    per_path = path.groupBy(*group).agg(
        F.count("*").alias("n_selected"),
        F.array_distinct(F.transform(ordered, lambda x: x["label"])).alias("labels"),
    )
    return signal.join(per_path, list(group), "left").select(
        *group,
        F.coalesce("n_selected", F.lit(0)).alias("n_selected"),
        F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
        F.round(F.col("signal_words") / F.nullif("judged_words", F.lit(0)) * 100).cast("int").alias("signal_percent"),
    )


def signal_leaderboard(signal: DataFrame, k: int, question: str = "question_id") -> DataFrame:
    """The ``k`` documents with the highest signal for each question; ties go to more signal words, then ids."""
    order = Window.partitionBy(question).orderBy(
        F.desc_nulls_last("signal_ratio"), F.desc("signal_words"), F.asc("doc_id")
    )
    return signal.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def background_blocks(blocks: DataFrame, selected: DataFrame, doc: str = "page_id") -> DataFrame:
    """Blocks that recede behind a reading path: neither selected, nor a heading of one, nor an H1.

    A run without a path has no background.
    """
    key = [doc, "question_id"]
    kept = (
        selected.select(*key, F.explode(F.array("block_id", "heading_block_id")).alias("block_id"))
        .where(F.col("block_id").isNotNull())
        .distinct()
    )
    runs = selected.select(*key).distinct()
    shown = blocks.where(F.col("tag") != "h1").join(runs, doc)
    return shown.join(kept, [*key, "block_id"], "left_anti")


def background_around(blocks: DataFrame, extents: DataFrame, selected: DataFrame, doc: str = "page_id") -> DataFrame:
    """Blocks that recede behind a reading path, with nesting: ``background_blocks`` without those that hold, or lie in, a kept block.

    ``extents`` are the elements of ``html_extents``. Where all selected passages lie in the innermost article or main part around the
    first of them (by ``idx``), only blocks in that part recede, without the part itself; otherwise all of the page.
    A run keeps a path and its headings only, so what it keeps is one short array; a page's parts are another.
    """
    key = [doc, "question_id"]
    at = F.struct("block_id", "until")
    ends = extents.select(doc, "block_id", "until", "focuses")
    items = selected.select(*key, "idx", "block_id", F.explode(F.array("block_id", "heading_block_id")).alias("kept_id"))
    items = items.where(F.col("kept_id").isNotNull()).join(ends.select(doc, F.col("block_id").alias("kept_id"), "until"), [doc, "kept_id"])
    runs = items.groupBy(*key).agg(
        F.collect_set(F.struct(F.col("kept_id").alias("block_id"), "until")).alias("kept"),
        F.min(F.struct("idx", "block_id"))["block_id"].alias("first_id"),
        F.min("block_id").alias("least_id"), F.max("block_id").alias("last_id"),
    )
    parts = ends.where("focuses").groupBy(doc).agg(F.collect_list(at).alias("parts"))
    inside = lambda block, part: (part["block_id"] <= block) & (block <= part["until"])
    part = F.array_max(F.filter("parts", lambda x: inside(F.col("first_id"), x)))
    whole = F.struct(F.lit(-1).alias("block_id"), F.lit(2**31 - 1).alias("until"))
    runs = runs.join(parts, doc, "left").withColumn("part", part).withColumn(
        "root", F.when(inside(F.col("least_id"), F.col("part")) & inside(F.col("last_id"), F.col("part")), F.col("part")).otherwise(whole)
    )
    shown = blocks.where(F.col("tag") != "h1").join(ends.drop("focuses"), [doc, "block_id"]).join(runs, doc)
    own = F.struct("block_id", "until")
    touches = F.exists("kept", lambda k: inside(k["block_id"], own) | inside(F.col("block_id"), k))
    is_root = (F.col("block_id") == F.col("root.block_id")) | ((F.col("tag") == "body") & (F.col("root.block_id") == -1))
    return shown.where(inside(F.col("block_id"), F.col("root")) & ~is_root & ~touches).select(*blocks.columns, "question_id")
