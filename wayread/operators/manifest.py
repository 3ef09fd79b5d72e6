"""Nested results of a run: the manifest, the annotation plan and the printed reading path."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayread.constants import IRRELEVANT, MANIFEST_VERSION
from wayread.functions.text import excerpt
from wayread.operators.judge import question_key

_PASSAGE = (
    ("ord", "order"), ("page", "page"), ("role", "role"), ("label", "label"), ("p", "probability"),
    ("role_p", "role_probability"), ("confidence", "confidence"), ("score", "score"), ("text", "text"),
    ("heading", "heading"), ("is_catch", "is_catch"),
)


def source_info(documents: DataFrame, content: str, path: Column, pages: Column) -> DataFrame:
    """``(doc_id, source)`` with path, SHA-256 of the content and page count of every document."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    return documents.select(
        "doc_id", F.struct(path.alias("path"), digest.alias("sha256"), pages.cast("int").alias("pages")).alias("source")
    )


def page_counts(passages: DataFrame) -> DataFrame:
    """Passages and pages of every document."""
    return passages.groupBy("doc_id").agg(F.count("*").alias("n_passages"), F.max("page").alias("n_pages"))


def documents_without_text(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Documents from which no passage could be taken."""
    return documents.select("doc_id").join(passages.select("doc_id"), "doc_id", "left_anti")


def require_text(documents: DataFrame, passages: DataFrame) -> None:
    """Fail if any document has no passages; asks for one such document only."""
    empty = documents_without_text(documents, passages).take(1)
    if empty:
        raise ValueError(f"no text found, for example in document {empty[0]['doc_id']}")


def with_text(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """``passages``, in a plan that fails when it runs if any document has none. No job of its own."""
    lost = F.raise_error(F.concat(F.lit("no text found in document "), F.col("doc_id").cast("string"))).cast("boolean")
    # by a count, which the failing condition cannot be moved below
    both = documents.select("doc_id", F.lit(0).alias("found")).unionByName(passages.select("doc_id", F.lit(1).alias("found")))
    empty = both.groupBy("doc_id").agg(F.max("found").alias("found")).where(F.when(F.col("found") == 1, False).otherwise(lost))
    return passages.unionByName(empty.select("doc_id"), allowMissingColumns=True)


def _box(quad: Column) -> Column:
    xs = F.filter(quad, lambda _, i: i % 2 == 0)
    ys = F.filter(quad, lambda _, i: i % 2 == 1)
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def manifest(
    path: DataFrame, signal: DataFrame, usage: DataFrame, source: DataFrame, questions: DataFrame,
    config: dict[str, Any],
) -> DataFrame:
    """One row per run with a path: ``(doc_id, question_id, manifest)``. At most seven passages are nested.

    ``source`` has a row per document or, with ``question_id``, per run; the latter is joined where the passages are.
    """
    fields = [F.col(c).alias(name) for c, name in _PASSAGE]
    if "quads" in path.columns:
        quads = F.transform(
            "quads", lambda q: F.struct(q["page"].alias("page"), q["quad"].alias("quad"), _box(q["quad"]).alias("rect"))
        )
        fields.append(quads.alias("quads"))
    key = ["doc_id", "question_id"]
    nested = path.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("passages"))
    settings = F.struct(*[F.lit(v).alias(k) for k, v in config.items()])
    tokens = F.struct(
        F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"),
    )
    return (
        nested.join(signal, key, "left")
        .join(usage, key, "left")
        .join(source, [c for c in key if c in source.columns], "left")
        .join(questions.select(*question_key(questions), "question"), question_key(questions), "left")
        .select(
            *key,
            F.struct(
                F.lit(MANIFEST_VERSION).alias("manifest_version"),
                "source",
                "question",
                settings.alias("config"),
                F.coalesce("model", F.lit(config.get("model"))).alias("model"),
                tokens.alias("usage"),
                "passages",
                F.struct("judged_words", "signal_words", "signal_ratio").alias("signal"),
            ).alias("manifest"),
        )
    )


def annotation_text(
    role: Column, order: Column, p: Column, role_p: Column, is_catch: Column, tool: str = "reading-path"
) -> Column:
    def three(c: Column) -> Column:
        return F.format_string("%.3f", F.bround(c, 3))

    return F.concat_ws(
        "; ",
        F.concat(F.lit(f"{tool} role="), F.coalesce(role, F.lit(IRRELEVANT))),
        F.concat(F.lit("order="), order.cast("string")),
        F.concat(F.lit("p="), F.coalesce(three(p), F.lit("?"))),
        F.concat(F.lit("role_p="), three(F.coalesce(role_p, F.lit(0.0)))),
        F.when(is_catch, F.lit("catch=yes")),
    )


def annotation_plan(path: DataFrame, tool: str = "reading-path") -> DataFrame:
    """Marks to draw: one row per path item and page with at least one box."""
    note = annotation_text(F.col("role"), F.col("ord"), F.col("p"), F.col("role_p"), F.col("is_catch"), tool)
    title = F.concat_ws(" ", F.col("ord").cast("string"), F.col("label"))
    boxes = path.select(
        "doc_id", "question_id", "ord", title.alias("title"), note.alias("content"),
        F.posexplode("quads").alias("at", "box"),
    ).where(F.col("box.quad").isNotNull())
    in_order = F.sort_array(F.collect_list(F.struct("at", "box.quad")))
    return boxes.groupBy("doc_id", "question_id", F.col("box.page").alias("page"), "ord", "title", "content").agg(
        F.transform(in_order, lambda x: x["quad"]).alias("quads")
    )


def path_lines(path: DataFrame) -> DataFrame:
    """Printed form of every path item: order, label, probability, page and an excerpt."""
    line = F.concat_ws(
        " · ", F.col("ord").cast("string"), "label", F.format_string("%.2f", F.bround("p", 2)),
        F.col("page").cast("string"), excerpt(F.col("text")),
    )
    return path.select("doc_id", "question_id", "ord", line.alias("line"))


def signal_lines(signal: DataFrame) -> DataFrame:
    """Printed form of the signal of every judged run."""
    percent = F.format_string("%d", F.bround(F.col("signal_ratio") * 100, 0).cast("int"))
    line = F.concat(
        F.lit("Signal: "), percent, F.lit("% of judged text ("), F.col("signal_words").cast("string"), F.lit("/"),
        F.col("judged_words").cast("string"), F.lit(" words)"),
    )
    return signal.where(F.col("signal_ratio").isNotNull()).select("doc_id", "question_id", line.alias("line"))
