"""Text expressions: cleaning, counting, cutting and splitting. Column in, Column out.

All of them stay inside the JVM. Splitting is done by one pattern per rule instead of a loop over the
text, so the cost grows linearly with the length of the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayread.constants import (
    ABBREVIATIONS,
    CLOSERS,
    EXCERPT_LEN,
    MAX_PASSAGE_LEN,
    MAX_SENTENCE_LEN,
    OPENERS,
    SITE_SUFFIX,
    STOPS,
    WS_CHARS,
)
from wayread.functions.arrays import let, prefix_sums


# The same characters as ``constants.WS``, as the property that Java tests fastest.
_WS = r"\p{IsWhite_Space}"
# Whitespace that is not one space already: few matches, each of which costs more than many characters passed over.
_NOT_ONE_SPACE = rf" {_WS}++|[{_WS}&&[^ ]]{_WS}*+"
# ``constants.LINE_END`` and the other whitespace, with the quick test for whitespace in front.
_LINE_END = r"[\x{1c}-\x{1e}[\p{IsWhite_Space}&&[\n-\r\x{85}\x{2028}\x{2029}]]]"
_INLINE = r"[\p{IsWhite_Space}&&[^\n-\r\x{85}\x{2028}\x{2029}]]"


def clean_text(c: Column) -> Column:
    """Collapse runs of Unicode whitespace to one space and trim."""
    return F.trim(F.regexp_replace(c, _NOT_ONE_SPACE, " "))


def clean_word_count(t: Column) -> Column:
    """Words of a cleaned text: one more than its spaces."""
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words."""
    return let(clean_text(c), clean_word_count)


def rfind(c: Column, limit: int) -> Column:
    """Index of the last space before ``limit``, or -1."""
    return let(
        F.instr(F.reverse(F.substring(c, 1, limit)), " "),
        lambda back: F.when(back == 0, F.lit(-1)).otherwise(F.least(F.length(c), F.lit(limit)) - back),
    )


def excerpt(c: Column, limit: int = EXCERPT_LEN) -> Column:
    return let(
        clean_text(c),
        lambda t: F.when(F.length(t) <= limit, t).otherwise(
            F.concat(F.rtrim(F.substring(t, 1, limit)), F.lit("..."))
        ),
    )


def truncate_quoted(c: Column, limit: int) -> Column:
    """Cut at the last space at or before ``limit`` if that keeps over half of it, and add an ellipsis."""

    def cut(t: Column) -> Column:
        at = rfind(t, limit + 1)
        kept = let(at, lambda a: F.when(a > limit / 2, F.substring(t, F.lit(1), a)).otherwise(F.substring(t, 1, limit)))
        return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.trim(kept), F.lit("…")))

    return let(clean_text(c), cut)


def clean_headline(c: Column) -> Column:
    """Clean, then drop a trailing site name after a bar or dash."""
    return F.trim(F.regexp_replace(clean_text(c), SITE_SUFFIX, ""))


def item_id(prefix: str, pos: Column) -> Column:
    """``P01`` for position 0; wider numbers keep all their digits."""
    n = (pos + 1).cast("int")
    digits = F.coalesce(n.cast("string"), F.lit("null"))
    return F.concat(F.when(n.between(0, 9), F.lit(f"{prefix}0")).otherwise(F.lit(prefix)), digits)


def trim_span(c: Column, s: Column, e: Column) -> Column:
    """Shrink ``[s, e)`` of ``c`` over whitespace at both ends."""

    def shrink(part: Column) -> Column:
        lead = F.length(part) - F.length(F.ltrim(part, F.lit(WS_CHARS)))
        tail = F.length(part) - F.length(F.rtrim(part, F.lit(WS_CHARS)))
        start = s + lead
        return F.struct(start.alias("s"), F.greatest(start, e - tail).alias("e"))

    return let(F.substring(c, s + 1, e - s), shrink)


# A sentence takes everything up to a boundary: text without stops, and runs of stops that are no boundary.
# A run of stops is always entered at its first character. The look-behind keeps abbreviations together.
_BOUNDARY = (
    rf"(?<!(?:^|[(]|{_WS})(?:{ABBREVIATIONS}))[{STOPS}]++[{CLOSERS}]*+{_WS}++(?=[{OPENERS}])"
)
_SENTENCE = rf"(?:[^{STOPS}]++|(?!{_BOUNDARY})[{STOPS}]++)*+(?:{_BOUNDARY}|\z)"
# An over-long sentence is cut before the last space that leaves more than half, else at the limit.
_HARD_CUT = (
    rf"(?s)(?=.{{{MAX_SENTENCE_LEN + 1}}})"
    rf"(?:.{{{MAX_SENTENCE_LEN // 2 + 1},{MAX_SENTENCE_LEN}}}(?= )|.{{{MAX_SENTENCE_LEN}}})|(?s).+"
)


def sentence_parts(c: Column) -> Column:
    """``array<struct<s, e, raw, clean>>``: every sentence span of the text, in order.

    ``[s, e)`` is the trimmed span in the raw text, ``raw`` the untrimmed slice (all slices put together
    give the text again) and ``clean`` its cleaned text. Slices that are only whitespace are left out.
    """
    slices = F.flatten(
        F.transform(
            F.regexp_extract_all(c, F.lit(_SENTENCE), F.lit(0)),
            lambda p: F.when(F.length(p) <= MAX_SENTENCE_LEN, F.array(p)).otherwise(
                F.regexp_extract_all(p, F.lit(_HARD_CUT), F.lit(0))
            ),
        )
    )

    def place(raw: Column, start: Column) -> Column:
        n = F.length(raw)
        lead = n - F.length(F.ltrim(raw, F.lit(WS_CHARS)))
        tail = n - F.length(F.rtrim(raw, F.lit(WS_CHARS)))
        return F.struct(
            (start + lead).alias("s"), (start + n - tail).alias("e"), raw.alias("raw"), clean_text(raw).alias("clean")
        )

    placed = let(slices, lambda ps: F.zip_with(ps, prefix_sums(F.transform(ps, F.length)), place))
    return F.filter(placed, lambda x: x["e"] > x["s"])


def split_sentences(c: Column) -> Column:
    """``array<struct<s, e>>`` of trimmed sentence spans."""
    return F.transform(sentence_parts(c), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def split_long(c: Column, limit: int = MAX_PASSAGE_LEN) -> Column:
    """Text up to ``limit`` is one cleaned piece; longer text is cut at lines, then at words.

    A line that is too long is cut at the last space before the limit, or at the limit itself when that
    space would leave half a piece or less.
    """
    return _split(c, clean_text(c), _lined(F.regexp_replace(c, _INLINE + "+", " ")), limit)


def split_clean(c: Column, limit: int = MAX_PASSAGE_LEN) -> Column:
    """``split_long`` of text that ``clean_text`` has gone over: of the line ends only separators can be left."""
    separated = F.contains(c, F.lit("\x1c")) | F.contains(c, F.lit("\x1d")) | F.contains(c, F.lit("\x1e"))
    return _split(c, c, F.when(separated, _lined(c)).otherwise(c), limit)


def _lined(c: Column) -> Column:
    return F.regexp_replace(c, rf" ?+{_LINE_END}(?:{_LINE_END}| )*+", "\n")


def _split(c: Column, whole: Column, lined: Column, limit: int) -> Column:
    piece = (
        rf"[ \n]?((?=[^\n]{{{limit + 1}}})(?:[^\n]{{{limit // 2 + 1},{limit - 1}}}(?= )|[^\n]{{{limit}}})|[^\n]+)"
    )
    pieces = F.regexp_extract_all(F.trim(lined, F.lit(" \n")), F.lit(piece), F.lit(1))
    return (
        F.when(c.isNull(), F.lit(None).cast("array<string>"))
        .when(F.length(c) <= limit, F.filter(F.array(whole), lambda p: p != ""))
        .otherwise(let(pieces, lambda ps: F.when(F.size(ps) > 0, ps).otherwise(F.array(F.lit("")))))
    )
