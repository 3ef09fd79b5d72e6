"""Runs and recorded judgments derived from ids, for tables that come without a judge.

They stand in for model output wherever results must be the same on every engine and every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayread.constants import ROLE_NAMES


def derived_runs(documents: DataFrame, n_questions: int, per_document: int = 2, doc: str = "doc_id") -> DataFrame:
    """Every document is asked ``per_document`` of the questions ``0 .. n_questions - 1``."""
    turn = F.explode(F.sequence(F.lit(0), F.lit(per_document - 1)))
    return documents.select(F.col(doc).alias("doc_id"), turn.alias("turn")).select(
        "doc_id", F.pmod(F.col("doc_id") * 7 + F.col("turn") * 11, F.lit(n_questions)).cast("long").alias("question_id"),
        "turn",
    )


def recorded(items: DataFrame) -> DataFrame:
    """Items of runs with judgments computed from ``doc_id``, ``question_id`` and ``idx``."""
    d, q, i = F.col("doc_id"), F.col("question_id"), F.col("idx")
    roles = F.array(*[F.lit(r) for r in ROLE_NAMES])
    return items.withColumns(
        {
            "p": F.pmod(d * 37 + q * 17 + i * 61, F.lit(101)) / F.lit(100.0),
            "role": F.get(roles, F.pmod(d * 7 + q * 5 + i * 3, F.lit(7)).cast("int")),
            "role_p": F.pmod(d * 13 + q * 3 + i * 29, F.lit(11)) / F.lit(10.0),
            "confidence": F.pmod(d + q + i, F.lit(10)) / F.lit(10.0),
        }
    )


def layout_from_lines(documents: DataFrame, per_page: int = 8) -> DataFrame:
    """Layout blocks from the lines of text documents: two columns, four rows to a page.

    Boxes, sizes and weights follow from ``doc_id`` and the line number.
    """
    line, d = F.col("line_no"), F.col("doc_id")
    left = F.when((d + line) % 2 == 0, F.lit(36.0)).otherwise(F.lit(320.0))
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).withColumns(
        {
            "page": F.floor(line / per_page).cast("int") + 1,
            "number": (line % per_page).cast("int"),
            "x0": left,
            "y0": (F.floor((line % per_page) / 2) * 238 + 24 + line % 3).cast("double"),
            "size": F.when((d + line) % 4 == 0, F.lit(15.0)).otherwise(F.lit(11.0)),
            "bold": (d * 5 + line * 3) % 5 == 0,
        }
    ).withColumns({"x1": F.col("x0") + 244, "y1": F.col("y0") + 24})
    quad = F.array("x0", "y0", "x1", "y0", "x0", "y1", "x1", "y1")
    one_line = F.array(F.struct("text", quad.alias("quad"), "size", "bold"))
    return lines.select(
        "doc_id", "page", "number", "x0", "y0", "x1", "y1", F.lit(0.0).alias("page_y0"), F.lit(800.0).alias("page_y1"),
        one_line.alias("lines"),
    )


def recorded_answers(requests: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """Model output for every digest request, as the judge would send it: ``(request_key, answers, …)``.

    Copies of a window share one key and one answer, that of the lowest ids.
    """
    from wayread.functions.text import item_id

    pos = F.col("idx") % size
    name = item_id("P", pos)
    needed = F.struct(
        F.concat(name, F.lit("_needed")).alias("key"),
        F.struct(
            F.lit("noul").alias("type"), F.col("p").alias("noul"), F.lit(None).cast("string").alias("choice"),
            F.lit(None).cast("double").alias("confidence"),
            F.lit(None).cast("map<string,double>").alias("probabilities"),
        ).alias("value"),
    )
    chosen = F.struct(
        F.concat(name, F.lit("_role")).alias("key"),
        F.struct(
            F.lit("choice").alias("type"), F.lit(None).cast("double").alias("noul"), F.col("role").alias("choice"),
            "confidence", F.create_map("role", "role_p").alias("probabilities"),
        ).alias("value"),
    )
    window = F.floor(F.col("idx") / size).cast("int").alias("window_no")
    answers = (
        items.select("doc_id", "question_id", window, F.explode(F.array(needed, chosen)).alias("one"))
        .groupBy("doc_id", "question_id", "window_no")
        .agg(F.to_json(F.map_from_entries(F.collect_list("one"))).alias("answers"))
    )
    calls = requests.select("request_key", "doc_id", "question_id", "window_no", "n_items").join(
        answers, ["doc_id", "question_id", "window_no"]
    )
    lowest = F.struct("doc_id", "question_id", "window_no")
    return calls.groupBy("request_key").agg(
        F.min_by("answers", lowest).alias("answers"),
        (F.max("n_items") * 100).cast("long").alias("input_tokens"),
        (F.max("n_items") * 10).cast("long").alias("output_tokens"),
        F.lit("recorded").alias("model"),
    )
