"""Chat formatting: conversations as training text, with a loss flag for each segment, after a declarative template.

A template names the turns' marks and the machine of turn order. Control strings inside texts are written as escapes that hold
none of them, so the text can be cut at its marks again and every turn comes back as it was.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks, loss and turn order.

    ``heads`` gives the name of a role in its head, ``order`` the moves of the machine: from a state (``start`` or the state
    a move led to) over a role to the next state. A role without a move from the state reached is out of order.
    """

    heads: Mapping[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    trained: Sequence[str] = ("assistant",)
    opening: str = "### "
    named: str = ": "
    closing: str = "</turn>\n"
    #: control strings and the letters that stand for them after a backslash; ``s`` is the backslash itself
    escapes: Mapping[str, str] = field(default_factory=lambda: {"###": "h", "</turn>": "t"})
    order: Mapping[str, Mapping[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "primed", "user": "asked"},
            "primed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked", "tool": "called"},
            "called": {"tool": "called", "assistant": "answered"},
        }
    )
    ends: Sequence[str] = ("asked", "answered")

    def __post_init__(self):
        strings = list(self.escapes)
        if any(not s or _ESCAPE in s for s in strings) or any(a != b and a in b for a in strings for b in strings):
            raise ValueError("control strings are not empty, hold no backslash and no other control string")
        letters = [*self.escapes.values(), "s", "c"]
        if len(set(letters)) < len(letters) or any(len(x) != 1 for x in letters):
            raise ValueError("each control string needs a letter of its own, other than s and c")
        if not any(s in self.opening for s in strings) or not any(s in self.closing for s in strings):
            raise ValueError("opening and closing marks must hold a control string")


CHAT = Template()


def escaped(text: Column, template: Template = CHAT) -> Column:
    """``text`` without any control string: a backslash stands only before the letter of what it replaces."""
    text = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "s"))
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(_ESCAPE + e[1])), template.escapes.items(), text)


def unescaped(text: Column, template: Template = CHAT) -> Column:
    """The text that ``escaped`` was given. No letter's string holds a backslash, so the letters can be read one after another."""
    text = reduce(lambda c, e: F.replace(c, F.lit(_ESCAPE + e[1]), F.lit(e[0])), template.escapes.items(), text)
    return F.replace(text, F.lit(_ESCAPE + "s"), F.lit(_ESCAPE))


def _names(template: Template) -> Column:
    return F.create_map(*[F.lit(x) for pair in template.heads.items() for x in pair])


def head(role: Column, template: Template = CHAT) -> Column:
    """Opening mark and name of a role; a role the template does not know stands in brackets, escaped."""
    other = F.concat(F.lit("("), F.replace(escaped(role, template), F.lit(template.named), F.lit(_ESCAPE + "c")), F.lit(")"))
    name = F.coalesce(F.try_element_at(_names(template), role), other)
    return F.concat(F.lit(template.opening), name, F.lit(template.named))


def machine(roles: Column, template: Template = CHAT) -> Column:
    """State and number of the first role out of order (null if none) after a run of the template's machine over ``roles``."""
    moves = F.create_map(*[F.lit(x) for at, row in template.order.items() for role, to in row.items() for x in (f"{at} {role}", to)])

    def step(reached: Column, role: Column) -> Column:
        to = F.when(reached["bad_turn"].isNull(), F.try_element_at(moves, F.concat_ws(" ", reached["state"], role)))
        bad = F.coalesce(reached["bad_turn"], F.when(to.isNull(), reached["n"]))
        return F.struct(F.coalesce(to, reached["state"]).alias("state"), bad.alias("bad_turn"), (reached["n"] + 1).alias("n"))

    start = F.struct(F.lit("start").alias("state"), F.lit(None).cast("long").alias("bad_turn"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(roles, start, step)


def formatted(conversations: DataFrame, template: Template = CHAT, names: Sequence[str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """One row for each conversation: its id, ``formatted``, ``segments``, ``state``, ``valid`` and ``bad_turn``.

    ``conversations`` has a row for each turn; the columns of ``names`` are used, others are ignored. Turns stand in the order
    of turn number, then role, then text; a null number comes first. Null roles and texts are empty, a null id is an id.
    A repeated row is a turn of its own. An empty table gives no rows.

    ``segments`` holds ``(text, loss, turn, kind)`` for head, text and closing mark of every turn, and ``formatted`` is their
    texts joined. ``valid`` is true if the machine has a move for every role and ends in one of the template's ends; turns out
    of order are formatted as any other, and ``bad_turn`` numbers the first of them from 0.

    Marks and escapes are written row by row before the one shuffle. A formatted conversation is one value, so a conversation
    has to fit one row; conversations share nothing, and a task holds one at a time.
    """
    key, turn, role, text = (F.col(f"`{n}`") for n in names)
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    rows = conversations.select(key.alias("key"), F.struct(turn.alias("turn"), role.alias("role"), text.alias("raw"), head(role, template).alias("head"), escaped(text, template).alias("text")).alias("one"))
    # turns are sorted by number, role and text as given
    turns = rows.groupBy("key").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    turns = turns.select("key", F.transform("turns", lambda t: t.dropFields("raw", "turn")).alias("turns"))

    def segments(t: Column, i: Column) -> Column:
        def segment(text: Column, loss: Column, kind: str) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"), i.cast("long").alias("turn"), F.lit(kind).alias("kind"))

        return F.array(
            segment(t["head"], F.lit(False), "head"),
            segment(t["text"], t["role"].isin(list(template.trained)), "text"),
            segment(F.lit(template.closing), F.lit(False), "closing"),
        )

    cut = turns.select("key", machine(F.col("turns")["role"], template).alias("end"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return cut.select(
        F.col("key").alias(names[0]),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        F.col("end.state").alias("state"),
        (F.col("end.bad_turn").isNull() & F.col("end.state").isin(list(template.ends))).alias("valid"),
        F.col("end.bad_turn").alias("bad_turn"),
    )


def turns_of(text: Column, template: Template = CHAT) -> Column:
    """Turns ``(role, text)`` read back from a formatted conversation."""
    parts = F.split(text, _quoted(template.closing))
    back = F.create_map(*[F.lit(x) for role, name in template.heads.items() for x in (name, role)])
    skip = len(template.opening)

    def read(part: Column) -> Column:
        at = F.instr(part, template.named)
        name = F.substring(part, F.lit(skip + 1), at - F.lit(skip + 1))
        other = F.substring(name, F.lit(2), F.char_length(name) - 2)
        role = F.coalesce(F.try_element_at(back, name), unescaped(F.replace(other, F.lit(_ESCAPE + "c"), F.lit(template.named)), template))
        said = F.substring(part, at + len(template.named), F.char_length(part))
        return F.struct(role.alias("role"), unescaped(said, template).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), read)  # nothing follows the last closing mark


def under_loss(segments: Column, template: Template = CHAT) -> Column:
    """All text of the segments under loss, unescaped and joined with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")


def _quoted(literal: str) -> str:
    return "\\Q" + literal + "\\E"
