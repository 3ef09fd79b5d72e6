"""Blocks of web pages and of laid-out documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayread.constants import (
    BAND_SHARE,
    HEADING_MAX_LEN,
    HEADING_MAX_WORDS,
    HEADING_SIZE_RATIO,
    HIDDEN_TAGS,
    LEAF_BLOCK_TAGS,
    MAX_HEADLINE_LEN,
    MIN_HEADLINE_LEN,
    MIN_PASSAGE_LEN,
    NEST_BLOCK_TAGS,
    RAW_TEXT_TAGS,
    REPEAT_MAX_LEN,
    REPEAT_MIN_PAGES,
    ROW_HEIGHT,
    WS_CHARS,
)
from wayread.functions.html import (
    ARIA_HIDDEN,
    decode_entities,
    element_contents,
    first_title,
    share_title,
    tag_name,
    tokens,
    without_tags,
)
from wayread.functions.text import clean_headline, clean_text, split_clean, word_count

ROLE_MAIN = r"""(?i)\srole\s*=\s*["']?main["'\s/>]"""
#: Pages whose tokens one task sorts.
PAGES_PER_TASK = 500
_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


# --------------------------------------------------------------------------- web pages


def html_tokens(pages: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    """Text and structural tags of every page: ``(doc, pos, name, opens, hides, text)``.

    Inline tags are dropped at once, except on pages that hide elements from readers, where any tag may end
    a hidden region. Skipped elements with raw text are one token and never become rows.
    """
    structural = [*LEAF_BLOCK_TAGS, *NEST_BLOCK_TAGS, *HIDDEN_TAGS]
    hiding = F.col(html).rlike("(?i)aria-hidden")

    def named(token: Column) -> Column:
        name = F.when(token.rlike("^<(?:[!?/]|[a-zA-Z])"), tag_name(token))  # any other bracket is text
        return F.struct(token.alias("token"), name.alias("name"))

    def useful(x: Column) -> Column:
        is_text = x["name"].isNull() & (F.ltrim(x["token"], F.lit(WS_CHARS)) != "")
        return is_text | x["name"].isin(structural) | (hiding & (x["name"] != "") & ~x["name"].isin(RAW_TEXT_TAGS))

    kept = F.filter(F.transform(tokens(F.col(html)), named), useful)
    rows = pages.select(doc, F.posexplode(kept).alias("pos", "x")).select(doc, "pos", "x.token", "x.name")
    token, name = F.col("token"), F.col("name")
    opens = name.isNotNull() & ~token.startswith("</")
    closed_at_once = opens & token.endswith("/>") & ~name.isin([*LEAF_BLOCK_TAGS, *NEST_BLOCK_TAGS])
    return rows.where(~closed_at_once | name.isNull()).select(
        doc, "pos", "name", opens.alias("opens"),
        (opens & (name.isin(HIDDEN_TAGS) | token.rlike(ARIA_HIDDEN))).alias("hides"),
        F.when(name.isNull(), decode_entities(token)).alias("text"),
        (opens & (name.isin("article", "main") | token.rlike(ROLE_MAIN))).alias("focuses"),
    )


def _by_page(rows: DataFrame, pages: DataFrame, doc: str) -> DataFrame:
    """``rows`` brought together by page. Every window over them sorts all rows of its task, so tasks get a bounded number of pages
    each; merged by the size of what was shuffled, they would grow with the input."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-pages.count() // PAGES_PER_TASK))
    return rows.repartition(tasks, doc)


def html_extents(pages: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    """Where the block elements of every page end: ``(doc, block_id, tag, until, focuses)``.

    ``block_id`` is the token number of the opening tag as in ``html_blocks``, ``until`` the last token number of the element, so
    one block is in another if its number lies between the other's two. Paragraphs and headings end before the next block tag. A
    block left open ends before the next one left open, or with the closed block around it, or with the page. ``focuses`` marks
    articles and main parts. The body is there for every page, under -1 where it has no tag. One shuffle, by page.
    """
    page = html_tokens(pages, doc, html).select(doc, "pos", "name", "opens", "focuses")
    page = _by_page(page, pages, doc)
    nest, leaf = F.col("name").isin(NEST_BLOCK_TAGS), F.col("name").isin(LEAF_BLOCK_TAGS)
    by_name = Window.partitionBy(doc, "name").orderBy("pos").rowsBetween(*_UP_TO_HERE)
    level = F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(by_name) + F.when(F.col("opens"), 0).otherwise(1)
    tags = page.where(nest | leaf).withColumn("level", level)
    pairing = Window.partitionBy(doc, "name", "level").orderBy("pos")
    tags = tags.withColumns({
        "closed_at": F.when(F.col("opens") & ~F.lead("opens").over(pairing), F.lead("pos").over(pairing)),
        "closes": ~F.col("opens") & F.coalesce(F.lag("opens").over(pairing), F.lit(False)),
    })
    paired = F.col("closed_at").isNotNull() | F.col("closes")
    so_far = Window.partitionBy(doc).orderBy("pos").rowsBetween(*_UP_TO_HERE)
    after = Window.partitionBy(doc).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    depth = F.when(nest & paired, F.when(F.col("opens"), 1).otherwise(-1)).otherwise(0)
    ends_leaf = leaf | (nest & (F.col("opens") | paired))
    tags = tags.withColumns({
        "depth": F.sum(depth).over(so_far),
        "next_tag": F.last(F.when(ends_leaf, F.col("pos")), ignorenulls=True).over(after),
        "left_open": nest & F.col("opens") & ~paired,
    })
    here = F.struct("pos", "closed_at")
    at_depth = Window.partitionBy(doc, "depth").orderBy("pos").rowsBetween(*_UP_TO_HERE)
    around = F.last(F.when(nest & F.col("opens") & paired, here), ignorenulls=True).over(at_depth)
    # at depth 0 the last block is closed already: the page is around
    tags = tags.withColumn("around", F.when(F.col("depth") > 0, around))
    among = Window.partitionBy(doc, "around.pos", "left_open").orderBy("pos")
    page_end = F.lit(2**31 - 1)
    until = (
        F.when(leaf, F.coalesce(F.col("next_tag") - 1, page_end))
        .when(F.col("left_open") & (F.col("name") != "body"), F.coalesce(F.lead("pos").over(among) - 1, F.col("around.closed_at"), page_end))
        .otherwise(F.coalesce("closed_at", page_end))
    )
    found = tags.withColumn("until", until).where("opens").select(doc, F.col("pos").alias("block_id"), F.col("name").alias("tag"), "until", "focuses")
    bodies = pages.select(doc, F.lit(-1).alias("block_id"), F.lit("body").alias("tag"), page_end.alias("until"), F.lit(False).alias("focuses"))
    return found.unionByName(bodies)


def html_blocks(pages: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    """Text of every page grouped by nearest enclosing block, in the order of first text.

    Gives ``(doc, block_id, block_pos, tag, text)``; ``block_id`` is the token number of the block's tag.
    Tags are paired per name by their nesting level. A block that is closed encloses what lies between its
    tags; a block left open encloses the rest of the closed block around it, up to the next open one.
    Paragraphs and headings hold no blocks and end at the next block tag.

    All windows are keyed by the page, so the tokens are shuffled once, to as many tasks as the pages need.
    """
    page = _by_page(html_tokens(pages, doc, html), pages, doc)

    level = F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(
        Window.partitionBy(doc, "name").orderBy("pos").rowsBetween(*_UP_TO_HERE)
    )
    levelled = page.withColumn("level", F.when(F.col("name").isNotNull(), level + F.when(F.col("opens"), 0).otherwise(1)))

    pairing = Window.partitionBy(doc, "name", "level").orderBy("pos")
    is_tag = F.col("name").isNotNull()
    paired = levelled.withColumns(
        {
            "paired": is_tag
            & F.when(F.col("opens"), ~F.coalesce(F.lead("opens").over(pairing), F.lit(True))).otherwise(
                F.coalesce(F.lag("opens").over(pairing), F.lit(False))
            ),
            "unhides": is_tag & ~F.col("opens") & F.coalesce(F.lag("hides").over(pairing), F.lit(False)),
        }
    )

    so_far = Window.partitionBy(doc).orderBy("pos").rowsBetween(*_UP_TO_HERE)
    # an unclosed skipped element hides the rest of the page; other unclosed elements hide nothing
    to_the_end = F.col("name").isin([t for t in HIDDEN_TAGS if t != "head"])
    hide = F.when(F.col("hides") & (F.col("paired") | to_the_end), 1).when(F.col("unhides"), -1).otherwise(0)
    nest, leaf = F.col("name").isin(NEST_BLOCK_TAGS), F.col("name").isin(LEAF_BLOCK_TAGS)
    visible = (
        paired.withColumn("hidden", F.sum(hide).over(so_far))
        .withColumn(
            "body_pos", F.min(F.when((F.col("name") == "body") & F.col("opens"), F.col("pos"))).over(Window.partitionBy(doc))
        )
        .where((F.col("hidden") <= 0) & ~F.col("unhides") & (F.coalesce("body_pos", F.lit(0)) <= F.col("pos")))
    )
    here = F.struct(F.col("pos").alias("id"), F.col("name").alias("tag"))
    ends_leaf = leaf | (nest & (F.col("opens") | F.col("paired")))
    depth = F.when(nest & F.col("paired"), F.when(F.col("opens"), 1).otherwise(-1)).otherwise(0)
    placed = visible.withColumns(
        {
            "depth": F.sum(depth).over(so_far),
            "leaf": F.last(
                F.when(ends_leaf, F.struct((leaf & F.col("opens")).alias("open"), here.alias("block"))), ignorenulls=True
            ).over(so_far),
        }
    )
    at_depth = Window.partitionBy(doc, "depth").orderBy("pos").rowsBetween(*_UP_TO_HERE)
    closed = F.last(F.when(nest & F.col("opens") & F.col("paired"), here), ignorenulls=True).over(at_depth)
    inside = Window.partitionBy(doc, "around.id").orderBy("pos").rowsBetween(*_UP_TO_HERE)
    unclosed = F.last(F.when(nest & F.col("opens") & ~F.col("paired"), here), ignorenulls=True).over(inside)

    body = F.struct(F.coalesce("body_pos", F.lit(-1)).alias("id"), F.lit("body").alias("tag"))
    block = F.coalesce(F.when(F.col("leaf.open"), F.col("leaf.block")), F.col("inner"), F.col("around"), body)
    texts = (
        placed.withColumn("around", closed)
        .withColumn("inner", unclosed)
        .where(clean_text(F.col("text")) != "")
        .withColumn("block", block)
    )
    grouped = texts.groupBy(doc, F.col("block.id").alias("block_id"), F.col("block.tag").alias("tag")).agg(
        F.min("pos").alias("first"), F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("parts")
    )
    return grouped.select(
        doc, "block_id",
        (F.row_number().over(Window.partitionBy(doc).orderBy("first")) - 1).alias("block_pos"),
        "tag",
        F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"),
    )


def page_headline(pages: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    """First fitting headline of a page: its H1s, share title, title, then H2s. No shuffle."""
    markup = F.col(html)
    sources = F.concat(
        F.transform(element_contents(markup, "h1"), without_tags),
        F.array(decode_entities(share_title(markup)), decode_entities(first_title(markup))),
        F.transform(element_contents(markup, "h2"), without_tags),
    )
    fits = F.filter(
        F.transform(sources, clean_headline),
        lambda t: F.length(t).between(MIN_HEADLINE_LEN, MAX_HEADLINE_LEN),
    )
    return pages.select(doc, F.get(fits, F.lit(0)).alias("headline"))


# --------------------------------------------------------------------------- laid-out documents


def filled_lines(lines: Column) -> Column:
    """Lines that have text."""
    return F.filter(lines, lambda x: F.ltrim(x["text"], F.lit(WS_CHARS)) != "")


def block_text(lines: Column) -> Column:
    """Cleaned text of all lines. Empty lines vanish with the whitespace around them."""
    return clean_text(F.array_join(lines["text"], " "))


def page_band(y0: Column, y1: Column, page_y0: Column, page_y1: Column, share: float = BAND_SHARE) -> Column:
    """``top`` or ``bottom`` for blocks in the outer share of the page height, else empty; top wins."""
    margin = (page_y1 - page_y0) * F.lit(share)
    return (
        F.when(y0 <= page_y0 + margin, F.lit("top")).when(y1 >= page_y1 - margin, F.lit("bottom")).otherwise(F.lit(""))
    )


def layout_texts(layout: DataFrame) -> DataFrame:
    """Layout blocks with text, band and centre; blocks without text are dropped, before their text is cleaned."""
    filled = F.exists("lines", lambda x: F.ltrim(x["text"], F.lit(WS_CHARS)) != "")
    return layout.where(filled).withColumns(
        {
            "text": block_text(F.col("lines")),
            "band": page_band(F.col("y0"), F.col("y1"), F.col("page_y0"), F.col("page_y1")),
            "center_x": (F.col("x0") + F.col("x1")) / 2,
        }
    )


def _page_window(doc: str) -> Window:
    """Reading order inside a page: rows of equal height, then left to right. ``rint`` rounds half to even."""
    return Window.partitionBy(doc, "page").orderBy(F.rint(F.col("y0") / ROW_HEIGHT), "center_x", "x0", "number")


def page_offsets(counts: DataFrame, doc: str = "doc_id", bucket: int = 1024) -> DataFrame:
    """Rows before each page: ``(doc, page, before)`` from ``(doc, page, n)``.

    Pages are summed in buckets first, so even a document with a large share of all pages never has more
    than a bucket of pages, or one row per bucket, in one window.
    """
    bucketed = counts.withColumn("bucket", F.floor(F.col("page") / F.lit(bucket)))
    before = (Window.unboundedPreceding, -1)
    in_bucket = Window.partitionBy(doc, "bucket").orderBy("page").rowsBetween(*before)
    across = Window.partitionBy(doc).orderBy("bucket").rowsBetween(*before)
    sums = bucketed.groupBy(doc, "bucket").agg(F.sum("n").alias("total")).select(
        doc, "bucket", F.coalesce(F.sum("total").over(across), F.lit(0)).alias("earlier")
    )
    local = bucketed.withColumn("local", F.coalesce(F.sum("n").over(in_bucket), F.lit(0)))
    return local.join(sums, [doc, "bucket"]).select(doc, "page", (F.col("local") + F.col("earlier")).alias("before"))


def reading_order(layout: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Layout blocks with ``reading_no``, their 0-based place in the document."""
    numbered = layout.withColumn("page_no", F.row_number().over(_page_window(doc)))
    offsets = page_offsets(layout.groupBy(doc, "page").agg(F.count("*").alias("n")), doc)
    return (
        numbered.join(offsets, [doc, "page"])
        .withColumn("reading_no", F.col("before") + F.col("page_no") - 1)
        .drop("before", "page_no")
    )


def _short_texts(layout: DataFrame, doc: str) -> DataFrame:
    """Short texts per page: ``(doc, text, page, n, n_band)``. Repeats on a page merge before the shuffle."""
    short = layout.where(F.length("text") <= REPEAT_MAX_LEN)
    return short.groupBy(doc, "text", "page").agg(
        F.count("*").alias("n"), F.count_if(F.col("band") != "").alias("n_band")
    )


def repeated_texts(layout: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Short texts on three or more pages of a document: ``(doc, text, n_blocks, n_pages)``."""
    return (
        _short_texts(layout, doc)
        .groupBy(doc, "text")
        .agg(F.sum("n").alias("n_blocks"), F.count("*").alias("n_pages"))
        .where(F.col("n_pages") >= REPEAT_MIN_PAGES)
    )


def _repeats_by_page(layout: DataFrame, doc: str) -> DataFrame:
    """Running headers and footers of each page: ``(doc, page, repeats, n_long)``.

    ``n_long`` counts those blocks among them that are long enough to be passages. The pages that have a text in a band are
    listed while the pages of the text are counted, so blocks are read once.
    """
    in_band = F.when(F.col("n_band") > 0, F.struct("page", "n_band"))
    repeated = (
        _short_texts(layout, doc)
        .groupBy(doc, "text")
        .agg(F.count("*").alias("n_pages"), F.collect_list(in_band).alias("found"))
        .where(F.col("n_pages") >= REPEAT_MIN_PAGES)
    )
    each = repeated.select(doc, "text", F.inline("found"))
    long_ones = F.sum(F.when(F.length("text") >= MIN_PASSAGE_LEN, F.col("n_band")).otherwise(0))
    return each.groupBy(doc, "page").agg(F.collect_set("text").alias("repeats"), long_ones.alias("n_long"))


def _mark_repeated(blocks: DataFrame, repeats: DataFrame, doc: str) -> DataFrame:
    """Adds ``is_repeat``. The join is on the page, by which the blocks are partitioned for windows anyway."""
    hit = (F.col("band") != "") & F.array_contains("repeats", F.col("text"))
    return (
        blocks.join(repeats.select(doc, "page", "repeats"), [doc, "page"], "left")
        .withColumn("is_repeat", F.coalesce(hit, F.lit(False)))
        .drop("repeats")
    )


def repeated_blocks(layout: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Running headers and footers: repeated texts inside a band, as ``(doc, page, number)``."""
    return (
        _mark_repeated(layout, _repeats_by_page(layout, doc), doc).where("is_repeat").select(doc, "page", "number")
    )


def drop_repeated(layout: DataFrame, doc: str = "doc_id") -> DataFrame:
    return _mark_repeated(layout, _repeats_by_page(layout, doc), doc).where(~F.col("is_repeat")).drop("is_repeat")


def attach_heading_layout(layout: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds ``heading``: the block right before on the same page, if it is short and larger or bolder."""
    return _heading_before(_styled(layout), doc)


def _styled(layout: DataFrame) -> DataFrame:
    """Adds largest ``size``, ``bold``, and ``title``: the text, if it is short enough for a heading."""
    filled = layout.withColumn("filled", filled_lines(F.col("lines")))
    few_words = F.when(F.length("text") <= HEADING_MAX_LEN, word_count(F.col("text")) <= HEADING_MAX_WORDS)
    return filled.withColumns(
        {
            "size": F.array_max(F.col("filled")["size"]),
            "bold": F.array_contains(F.col("filled")["bold"], True),
            "title": F.when(few_words, F.col("text")),
        }
    ).drop("filled")


def _heading_before(styled: DataFrame, doc: str) -> DataFrame:
    """``heading`` in place of the columns of ``_styled``."""
    order = _page_window(doc)
    title, prev_size, prev_bold = (F.lag(c).over(order) for c in ("title", "size", "bold"))
    compared = styled.withColumns({"prev_title": title, "prev_size": prev_size, "prev_bold": prev_bold})
    own_size = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.col("size"))
    larger = (F.col("prev_size") > 0) & (F.col("prev_size") >= own_size * HEADING_SIZE_RATIO)
    bolder = F.col("prev_bold") & ~F.col("bold")
    return compared.withColumn(
        "heading", F.when(F.col("prev_title").isNotNull() & (larger | bolder), F.col("prev_title")).otherwise(F.lit(""))
    ).drop("size", "bold", "title", "prev_title", "prev_size", "prev_bold")


def layout_pieces(layout: DataFrame) -> DataFrame:
    """What passages need of every layout block, its lines read and its text cut once. No shuffle.

    ``text`` is kept where it is short enough to be a heading or to be repeated, all of it is in ``pieces``, and ``quads`` has
    the boxes of the block.
    """
    long_enough = F.length("text") >= MIN_PASSAGE_LEN
    pieces = F.when(long_enough, F.filter(split_clean(F.col("text")), lambda t: F.length(t) >= MIN_PASSAGE_LEN))
    boxes = F.transform(
        F.filter(filled_lines(F.col("lines")), lambda x: x["quad"].isNotNull()),
        lambda x: F.struct(F.col("page").alias("page"), x["quad"].alias("quad")),
    )
    cut = _styled(layout_texts(layout)).withColumns({"pieces": pieces, "quads": F.when(long_enough, boxes)})
    short = F.when(F.length("text") <= max(HEADING_MAX_LEN, REPEAT_MAX_LEN), F.col("text"))
    n_pieces = F.coalesce(F.size("pieces"), F.lit(0))
    return cut.withColumns({"text": short, "n_pieces": F.when(n_pieces > 0, n_pieces).otherwise(0)}).drop("lines")


def passages_layout(layout: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Passages of laid-out documents: ``(doc, idx, text, heading, page, quads)``.

    A dropped header still counts as the block before the next one. The heading goes to the first piece of a
    block only; every piece carries the boxes of the whole block.
    """
    return passages_of_pieces(layout_pieces(layout), doc)


def passages_of_pieces(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Passages of the blocks of ``layout_pieces``. Blocks are read three times: hand in a stored table where they are many."""
    has_pieces = F.col("n_pieces") > 0
    # Pieces per page, from partial sums of narrow rows. A repeated block has one piece if it is long enough.
    repeats = _repeats_by_page(blocks, doc)
    counts = (
        blocks.where(has_pieces)
        .groupBy(doc, "page")
        .agg(F.sum("n_pieces").alias("n"))
        .join(repeats.select(doc, "page", "n_long"), [doc, "page"], "left")
        .select(doc, "page", (F.col("n") - F.coalesce("n_long", F.lit(0))).alias("n"))
    )
    offsets = page_offsets(counts, doc)

    numbered = _heading_before(blocks, doc).withColumn("page_no", F.row_number().over(_page_window(doc)))
    body = _mark_repeated(numbered, repeats, doc).where(~F.col("is_repeat") & has_pieces)
    items = body.select(doc, "page", "page_no", "heading", "quads", F.posexplode("pieces").alias("piece", "text"))
    in_page = Window.partitionBy(doc, "page").orderBy("page_no", "piece")
    local = items.withColumn("local", F.row_number().over(in_page) - 1)
    return local.join(offsets, [doc, "page"]).select(
        doc, (F.col("before") + F.col("local")).cast("int").alias("idx"), "text",
        F.when(F.col("piece") == 0, F.col("heading")).otherwise(F.lit("")).alias("heading"), "page", "quads",
    )
