"""HTML expressions: tokens, entities, tag names, headline sources."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayread.constants import RAW_TEXT_TAGS
from wayread.functions.arrays import let


def _raw(tag: str) -> str:
    return rf"<{tag}\b[^>]*+(?:>|\z)(?s:.*?)(?:</{tag}\b[^>]*+(?:>|\z)|\z)"


_RAW_ELEMENTS = "|".join(_raw(t) for t in RAW_TEXT_TAGS)
# comments and skipped elements; in the second form titles are the first group
_UNSEEN = rf"(?i)<!--(?s:.*?)(?:-->|\z)|{_RAW_ELEMENTS}"
_UNSEEN_BUT_TITLES = rf"(?i)({_raw('title')})|<!--(?s:.*?)(?:-->|\z)|{'|'.join(_raw(t) for t in RAW_TEXT_TAGS if t != 'title')}"
_ATTRIBUTES = r"""(?:[^=>]++|=\s*+"[^"]*+(?:"|\z)|=\s*+'[^']*+(?:'|\z)|=)*+"""
_TAG = rf"</?[a-zA-Z]{_ATTRIBUTES}(?:>|\z)"

# comment | skipped element with its text | tag | doctype and the like | text | stray bracket
TOKEN = (
    rf"(?i)<!--(?s:.*?)(?:-->|\z)|{_RAW_ELEMENTS}|{_TAG}|<[!?/][^>]*+(?:>|\z)|(?:[^<]++|<[^a-z/!?<])++|<"
)
ARIA_HIDDEN = r"""(?i:\saria-hidden)\s*=\s*(?:"true"|'true'|true[\s/>])"""

# Names come from the standard library's table: the usual ones first, since a lookup walks the list.
_USUAL = ["amp;", "lt;", "gt;", "quot;", "nbsp;", "copy;", "middot;", "mdash;", "ndash;", "hellip;", "rsquo;", "lsquo;"]
_NAMED = {name: html5[name] for name in [*_USUAL, *html5]}
_NO_SEMICOLON = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
_REFERENCE = rf"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*+;|&(?:{_NO_SEMICOLON})"


def tokens(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][^\s/>]*)", 1))


def _code_point(digits: Column, base: int) -> Column:
    """Character for a code point written in ``base``; not a scalar value gives U+FFFD."""
    number = F.conv(digits, base, 10).try_cast("long")
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    return F.when(
        F.coalesce(valid, F.lit(False)),
        F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"),
    ).otherwise(F.lit("\ufffd"))


def decode_entities(c: Column) -> Column:
    """Decode named and numeric character references in one pass, so ``&amp;lt;`` gives ``&lt;``."""
    named = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")

    def one(part: Column) -> Column:
        return (
            F.when(~part.startswith("&"), part)
            .when(part.rlike("^&#[0-9]+;?$"), _code_point(F.regexp_extract(part, "([0-9]+)", 1), 10))
            .when(part.rlike("^&#[xX][0-9a-fA-F]+;?$"), _code_point(F.regexp_extract(part, "^&#[xX]([0-9a-fA-F]+)", 1), 16))
            .otherwise(F.coalesce(F.try_element_at(named, F.substring(part, F.lit(2), F.length(part))), part))
        )

    parts = F.regexp_extract_all(c, F.lit(rf"{_REFERENCE}|[^&]+|&"), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(c)


def without_tags(markup: Column) -> Column:
    """Text of a piece of markup: line breaks become spaces, other tags vanish, entities are decoded."""
    visible = F.regexp_replace(markup, _UNSEEN, "")
    return decode_entities(F.regexp_replace(F.regexp_replace(visible, r"(?i)<br\b[^>]*>", " "), _TAG, ""))


def element_contents(html: Column, tag: str) -> Column:
    """Inner markup of every ``tag`` element outside comments and skipped elements, in document order."""
    visible = F.regexp_replace(html, _UNSEEN, "")
    shown = F.regexp_extract_all(
        visible, F.lit(rf"(?i)<{tag}(?:\s{_ATTRIBUTES})?>((?s:.*?))(?:</{tag}\s*>|\z)"), F.lit(1)
    )
    hidden = F.regexp_extract_all(visible, F.lit(rf"(?i)(<{tag}(?:\s{_ATTRIBUTES})?>)(?s:.*?)(?:</{tag}\s*>|\z)"), F.lit(1))
    return let(
        hidden, lambda opens: F.filter(shown, lambda _, i: ~F.get(opens, i).rlike(ARIA_HIDDEN))
    )


def first_title(html: Column) -> Column:
    """Text of the first title outside comments and other skipped elements."""
    seen = F.regexp_replace(html, _UNSEEN_BUT_TITLES, "$1")
    return F.nullif(F.regexp_extract(seen, r"(?i)<title\b[^>]*>((?s:.*?))(?:</title\s*>|\z)", 1), F.lit(""))


def share_title(html: Column) -> Column:
    """Content of the first meta tag with an Open Graph or Twitter title, comments and skipped elements apart."""
    metas = F.regexp_extract_all(F.regexp_replace(html, _UNSEEN, ""), F.lit(rf"(?i)<meta\s{_ATTRIBUTES}>"), F.lit(0))
    wanted = r"""(?i)\s(?:property\s*=\s*["']?og:title["'\s/>]|name\s*=\s*["']?twitter:title["'\s/>])"""
    meta = F.get(F.filter(metas, lambda m: m.rlike(wanted)), F.lit(0))
    content = F.concat(
        F.regexp_extract(meta, r'(?i)\scontent\s*=\s*"([^"]*)"', 1),
        F.regexp_extract(meta, r"(?i)\scontent\s*=\s*'([^']*)'", 1),
    )
    return F.nullif(content, F.lit(""))
