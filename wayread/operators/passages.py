"""Items to judge: sentences for finding, passages for reading paths.

One text cell is cut inside its own row with array expressions, so nothing is shuffled to split text.
Only numbering across several blocks of one page needs a window, keyed by the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayread.constants import (
    AUTO_FROM_HEADLINE,
    AUTO_FROM_OPENER,
    HEADING_TAGS,
    HEADLINE_QUOTE_LEN,
    MAX_PASSAGE_LEN,
    MIN_PASSAGE_LEN,
    MIN_SENTENCE_LEN,
    OPENER_QUOTE_LEN,
)
from wayread.functions.arrays import let
from wayread.functions.text import clean_text, sentence_parts, split_long, truncate_quoted


def document_sentences(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences of one-cell documents: ``(doc, idx, text, s, e)``. No shuffle."""
    kept = F.filter(sentence_parts(F.col(text)), lambda x: F.length(x["clean"]) >= MIN_SENTENCE_LEN)
    slim = F.transform(kept, lambda x: F.struct(x["clean"].alias("text"), x["s"].alias("s"), x["e"].alias("e")))
    return documents.select(doc, F.posexplode(slim).alias("idx", "item")).select(
        doc, "idx", "item.text", "item.s", "item.e"
    )


def sentences(blocks: DataFrame, doc: str = "page_id") -> DataFrame:
    """Sentences of all blocks of a page, numbered in reading order."""
    kept = F.filter(sentence_parts(F.col("text")), lambda x: F.length(x["clean"]) >= MIN_SENTENCE_LEN)
    slim = F.transform(kept, lambda x: F.struct(x["clean"].alias("text"), x["s"].alias("s"), x["e"].alias("e")))
    items = blocks.select(doc, "block_id", "block_pos", F.posexplode(slim).alias("part", "item"))
    order = Window.partitionBy(doc).orderBy("block_pos", "part")
    return items.select(
        doc, (F.row_number().over(order) - 1).alias("idx"), "item.text", "item.s", "item.e", "block_id"
    )


def passages_text(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages of one-cell documents: ``(doc, idx, text, heading, page)``. No shuffle."""
    pieces = F.filter(split_long(F.col(text)), lambda p: F.length(p) >= MIN_PASSAGE_LEN)
    return documents.select(doc, F.posexplode(pieces).alias("idx", "text")).select(
        doc, "idx", "text", F.lit("").alias("heading"), F.lit(1).alias("page")
    )


def pack_sentences(parts: Column) -> Column:
    """Greedy packing: index of the first sentence of every passage.

    Only the starts are kept while walking the sentences, so the state stays far smaller than the text.
    """
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("size"), F.lit(0).alias("i"))

    def step(acc: Column, part: Column) -> Column:
        span = part["e"] - part["s"]
        opens = (F.size(acc["starts"]) == 0) | (acc["size"] + span > MAX_PASSAGE_LEN)
        return F.struct(
            F.when(opens, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(opens, span).otherwise(acc["size"] + span).alias("size"),
            (acc["i"] + 1).alias("i"),
        )

    return F.aggregate(parts, start, step, lambda acc: acc["starts"])


def packed_spans(text: Column) -> Column:
    """``array<struct<s, e, text>>``: the passages of one block, in order."""

    def cut(parts: Column) -> Column:
        def group(starts: Column) -> Column:
            ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(parts)))

            def passage(first: Column, after: Column) -> Column:
                members = F.slice(parts, first + 1, after - first)
                body = clean_text(F.array_join(F.transform(members, lambda m: m["raw"]), ""))
                return F.struct(
                    F.element_at(parts, first + 1)["s"].alias("s"),
                    F.element_at(parts, after)["e"].alias("e"),
                    body.alias("text"),
                )

            return F.filter(F.zip_with(starts, ends, passage), lambda p: F.length(p["text"]) >= MIN_PASSAGE_LEN)

        none = F.array().cast("array<struct<s:int,e:int,text:string>>")
        return F.when(F.size(parts) == 0, none).otherwise(let(pack_sentences(parts), group))

    return let(sentence_parts(text), cut)


def attach_heading_web(blocks: DataFrame, doc: str = "page_id") -> DataFrame:
    """Body blocks with the nearest heading before them; heading blocks themselves are dropped."""
    order = Window.partitionBy(doc).orderBy("block_pos").rowsBetween(Window.unboundedPreceding, -1)
    is_heading = F.col("tag").isin(HEADING_TAGS)
    latest = F.last(
        F.when(is_heading, F.struct(clean_text(F.col("text")).alias("text"), F.col("block_id").alias("id"))),
        ignorenulls=True,
    ).over(order)
    return (
        blocks.withColumn("latest", latest)
        .where(~is_heading)
        .withColumns({"heading": F.coalesce(F.col("latest.text"), F.lit("")), "heading_block_id": F.col("latest.id")})
        .drop("latest")
    )


def passages_web(blocks: DataFrame, doc: str = "page_id") -> DataFrame:
    """Passages of a page: sentences packed up to the passage limit inside each block, under a heading."""
    spans = F.when(F.length(clean_text(F.col("text"))) >= MIN_PASSAGE_LEN, packed_spans(F.col("text")))
    items = attach_heading_web(blocks, doc).select(
        doc, "block_id", "block_pos", "heading", "heading_block_id", F.posexplode(spans).alias("part", "item")
    )
    order = Window.partitionBy(doc).orderBy("block_pos", "part")
    return items.select(
        doc, (F.row_number().over(order) - 1).alias("idx"), "item.text", "heading", "heading_block_id",
        "item.s", "item.e", "block_id", F.lit(1).alias("page"),
    )


def page_opener(passages: DataFrame, blocks: DataFrame, doc: str = "page_id") -> DataFrame:
    """First passage of a page, or its first block that is long enough: ``(doc, opener)``."""
    body = clean_text(F.col("text"))
    first_passage = passages.groupBy(doc).agg(F.min_by("text", "idx").alias("passage"))
    first_block = (
        blocks.select(doc, "block_pos", body.alias("text"))
        .where(F.length("text") >= MIN_PASSAGE_LEN)
        .groupBy(doc)
        .agg(F.min_by("text", "block_pos").alias("block"))
    )
    return first_block.join(first_passage, doc, "full").select(
        doc, F.coalesce("passage", "block").alias("opener")
    )


def auto_question(pages: DataFrame, headlines: DataFrame, openers: DataFrame, doc: str = "page_id") -> DataFrame:
    """Overview question for every page: ``(doc, question, source)``; both empty when the page has no text."""
    from_headline = F.concat(
        F.lit(AUTO_FROM_HEADLINE[0]), truncate_quoted(F.col("headline"), HEADLINE_QUOTE_LEN),
        F.lit(AUTO_FROM_HEADLINE[1]),
    )
    from_opener = F.concat(
        F.lit(AUTO_FROM_OPENER[0]), truncate_quoted(F.col("opener"), OPENER_QUOTE_LEN), F.lit(AUTO_FROM_OPENER[1])
    )
    both = pages.select(doc).join(headlines, doc, "left").join(openers, doc, "left")
    return both.select(
        doc,
        F.coalesce(from_headline, from_opener, F.lit("")).alias("question"),
        F.when(F.col("headline").isNotNull(), F.lit("headline"))
        .when(F.col("opener").isNotNull(), F.lit("first paragraph"))
        .otherwise(F.lit(""))
        .alias("source"),
    )
