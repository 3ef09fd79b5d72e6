"""Main text of web pages: structure first, then nearest-URL page differencing."""

from __future__ import annotations

import bisect
import html as entities
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayread.llm.common import settle

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|select|annotation|annotation-xml|desc|metadata|defs)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$|[a-z])", re.I)
#: Tags that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
                   " strike strong sub sup time tt u var wbr img"
                   " math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle mspace mpadded"
                   " mfenced menclose mtable mtr mtd semantics tspan".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article.
DROP = frozenset("nav footer aside form button dialog menu head".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that name what is around an article.
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner menu navbar nav navigation"
    " breadcrumb breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent gdpr notice notices newsletter subscribe"
    " subscription signup popup modal overlay alert comment comments commentlist respond disqus reply replies related recommended"
    " recommendations share sharing social widget widgets pagination pager toolbar login search skip disclaimer copyright".split())
#: Words that may stand beside them in one class or id; any other word makes it the name of something else.
BESIDE_NAMES = frozenset(
    "site page global main top bottom left right primary secondary box container wrapper wrap inner outer section area block bar list item"
    " items link links button buttons icon icons slot unit form field panel text title posts articles stories content menu trail".split())
#: Elements whose id names a part of the layout; elsewhere ids are made from headings.
STRUCTURAL = frozenset("div ul ol dl table".split())
#: Classes of elements whose id is made from a heading.
SLUGGED = re.compile(r"section|sect\d|level\d")
#: Names of what readers add: such an element is no wrapper of the page, however much it holds.
READERS = frozenset("comment comments commentlist respond disqus reply replies".split())
MAIN_NAMES = frozenset("articlebody post-content entry-content article-content article-body post-body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def _dropped(tag: str, attributes: dict[str, str]) -> bool:
    if tag in DROP or attributes.get("role") in DROP_ROLES or attributes.get("aria-hidden") == "true" or "hidden" in attributes:
        return True
    if "display:none" in attributes.get("style", "").replace(" ", ""):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return bool(_names(tag, attributes))


def _names(tag: str, attributes: dict[str, str]) -> set[str]:
    """The names of surroundings that an element's classes and id are: each a whole token, but for words beside."""
    classes = attributes.get("class", "").split()
    tokens = [*classes]
    if tag in STRUCTURAL and not any(SLUGGED.fullmatch(c) for c in classes):
        tokens += attributes.get("id", "").split()
    found: set[str] = set()
    for token in tokens:
        words = {w for w in re.split(r"[_-]+", token) if w}
        if words & DROP_NAMES and words <= DROP_NAMES | BESIDE_NAMES:
            found |= words & DROP_NAMES
    return found


def _is_main(tag: str, attributes: dict[str, str]) -> bool:
    return (tag in ("article", "main") or attributes.get("role") in ("article", "main") or attributes.get("itemprop") == "articlebody"
            or bool(MAIN_NAMES & set(attributes.get("class", "").split())))


def blocks(page: str | None) -> tuple[list[str], list[str]]:
    """Blocks inside the page's article (or main part), and blocks elsewhere that no element marks as surroundings."""
    found = lines(page)
    return [text for text, inside in found if inside], [text for text, inside in found if not inside]


def lines(page: str | None) -> list[tuple[str, bool]]:
    """The page's blocks in order, each with whether it stands inside the article or main part.

    A form or an element named as surroundings that would take more text than all that is left is a wrapper of the page
    and stays; the page is read again with it.
    """
    spared: set[int] = set()
    for _ in range(8):
        found, wrappers = _lines(page or "", spared)
        if not wrappers:
            return found
        spared |= wrappers
    return _lines(page or "", None)[0]


def _lines(page: str, spared: set[int] | None) -> tuple[list[tuple[str, bool]], set[int]]:
    """Blocks, and places of elements that are dropped by name or as forms but hold more than what is left.

    Elements at the places ``spared`` are not dropped by name or as forms; with None none is.
    """
    found: list[tuple[str, bool]] = []
    words: list[str] = []  # the open block, as raw text
    drop: list[str] = []  # the element that is dropped and those of its name within it
    mains: list[str] = []  # open article and main elements
    named: list[tuple[str, int]] = []  # other elements named as article bodies, with the depth of their tag
    depth: dict[str, int] = {}
    header = heading = 0
    held: dict[int, int] = {}  # characters in elements that may be wrappers, by their place
    wrapper = -1  # the one that is being dropped
    within: set[int] = set()  # those that stand inside the article

    def flush() -> None:
        text = " ".join(entities.unescape("".join(words)).split())
        words.clear()
        if text:
            found.append((text, bool(mains or named)))

    def hear(text: str) -> None:
        if drop and wrapper >= 0:
            held[wrapper] = held.get(wrapper, 0) + len(text.strip())
        if text and not drop and not (header and not (mains and heading)):
            words.append(text)

    at = 0
    for m in TOKEN.finditer(page):
        hear(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = page[m.start() + 1] == "/"
        if drop:
            if not closing and not mains and not named and _is_main(tag, _attributes(m[3])):
                drop.clear()  # what was dropped is left open; the article starts all the same
            else:
                if tag == drop[0]:
                    drop.pop() if closing else drop.append(tag)
                elif closing and tag in ("body", "html") or closing and mains and tag == mains[-1]:
                    drop.clear()
                if drop or tag == m[2].lower() and closing and tag not in ("article", "main"):
                    continue
        if tag not in INLINE:
            flush()
        if closing:
            depth[tag] = max(0, depth.get(tag, 0) - 1)
            if tag in mains:
                while mains and mains.pop() != tag:
                    pass
            while named and named[-1][0] == tag and depth[tag] < named[-1][1]:
                named.pop()
            header = 0 if tag == "header" else header
            heading = 0 if tag in HEADINGS else heading
            continue
        attributes = _attributes(m[3])
        if tag not in VOID and not m[3].rstrip().endswith("/") and _dropped(tag, attributes):
            may = tag == "form" or not _dropped(tag, {k: v for k, v in attributes.items() if k not in ("class", "id")})
            if not (may and (spared is None or m.start() in spared)):
                drop.append(tag)
                wrapper = m.start() if may and not _names(tag, attributes) & READERS else -1
                if mains or named:
                    within.add(wrapper)
                continue
        if tag in VOID:
            continue
        depth[tag] = depth.get(tag, 0) + 1
        if tag in ("article", "main"):
            mains.append(tag)
        elif _is_main(tag, attributes):
            named.append((tag, depth[tag]))
        header = 1 if tag == "header" else header
        heading = 1 if tag in HEADINGS else heading
    hear(page[at:])
    flush()
    left = sum(len(text) for text, _ in found)
    marked = any(inside for _, inside in found)  # then what stands around the article wraps nothing
    return found, {place for place, size in held.items() if size > left and (place in within or not marked)}


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``: chains of matches, by patience."""
    places: dict[int, list[int]] = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    ends: list[int] = []
    links: list[tuple[int, object]] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect.bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            ends[k:k + 1], links[k:k + 1] = [j], [link]
    chain, link = [], links[-1] if links else None
    while link:
        chain.append(link[0])
        link = link[1]
    return chain[::-1]


def _parsed(pages: DataFrame) -> DataFrame:
    """Per page its lines, packed, and for each line its hash, its length and whether it stands inside the article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed, hashes, sizes, inside = [], [], [], []
            for page in batch["html"]:
                found = lines(page.as_py())
                packed.append(pack("\n".join(x for x, _ in found).encode()))  # lines hold no line break
                hashes.append([xxhash.xxh3_64_intdigest(x) >> 1 for x, _ in found])
                sizes.append([len(x) for x, _ in found])
                inside.append([y for _, y in found])
            yield pa.RecordBatch.from_pydict({
                "page_id": batch["page_id"], "url": batch["url"], "packed": pa.array(packed, pa.binary()), "hashes": pa.array(hashes, pa.list_(pa.int64())),
                "sizes": pa.array(sizes, pa.list_(pa.int32())), "inside": pa.array(inside, pa.list_(pa.bool_()))})

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kind}, url string, packed binary, hashes array<long>, sizes array<int>, inside array<boolean>")


#: Different pages that are looked at on each side of a page, until one is no copy of it.
REACH = 4
#: Shares of two pages' text, and of their articles' text, from which one counts as a copy of the other.
COPY, COPY_INSIDE = 0.9, 0.5


def is_copy(a: dict, b: dict) -> bool:
    """Whether two pages share nearly all text, or half of what both mark as their article."""
    other = dict(zip(b["hashes"], b["inside"]))
    both = sum(n for h, n in zip(a["hashes"], a["sizes"]) if h in other)
    if both >= COPY * max(sum(a["sizes"]), sum(b["sizes"])):
        return True
    mine, theirs = (sum(n for n, x in zip(r["sizes"], r["inside"]) if x) for r in (a, b))
    marked = sum(n for h, n, x in zip(a["hashes"], a["sizes"], a["inside"]) if x and other.get(h))
    return bool(mine and theirs) and marked >= COPY_INSIDE * min(mine, theirs)


def _ranged(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` in order of host and path, dealt to ranges: with ``part``, the range, ``run``, the number of the run of equal
    pages in it, ``runs``, how many there are, and ``first`` and ``last`` of the run."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), list(batches)  # hashes only, one range of the order
        keys = [k for b in held for k in zip(b["host"].to_pylist(), b["same"].to_pylist())]
        first = [k == 0 or keys[k] != keys[k - 1] for k in range(len(keys))]
        run = (np.cumsum(first) - 1).astype(np.int64)
        at, runs = 0, int(run[-1]) + 1 if len(run) else 0
        for b in held:
            n = len(b)
            mine = slice(at, at + n)
            last = [*first[at + 1:at + n + 1], *([True] if at + n == len(keys) else [])]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([part] * n, pa.int64()), pa.array(run[mine]), pa.array([runs] * n, pa.int64()),
                 pa.array(first[mine], pa.bool_()), pa.array(last, pa.bool_())],
                names=[*b.schema.names, "part", "run", "runs", "first", "last"])
            at += n

    schema = T.StructType([*rows.schema, T.StructField("part", T.LongType()), T.StructField("run", T.LongType()), T.StructField("runs", T.LongType()),
                           T.StructField("first", T.BooleanType()), T.StructField("last", T.BooleanType())])
    return rows.repartitionByRange(parts, "host", "path", "row").sortWithinPartitions("host", "path", "row").mapInArrow(number, schema)


def _halo(edges: list) -> list[tuple[int, int]]:
    """(row, part): rows that stand in for the runs before and after each range. ``edges`` are the runs near the ends of ranges."""
    runs: dict[int, dict[int, dict]] = {}
    for e in edges:
        run = runs.setdefault(e["part"], {}).setdefault(e["run"], {"key": (e["host"], e["same"])})
        for side in ("first", "last"):
            if e[side]:
                run[side] = e["row"]
    parts, sent = sorted(runs), []
    for place, part in enumerate(parts):
        for step, side in ((-1, "last"), (1, "first")):
            seen, at = [], place + step
            while 0 <= at < len(parts) and len(seen) <= REACH:
                for number in sorted(runs[parts[at]], reverse=step < 0):
                    run = runs[parts[at]][number]
                    if not seen or run["key"] != seen[-1]:
                        seen.append(run["key"])
                        sent.append((run[side], part))
                    if len(seen) > REACH:
                        break
                at += step
    return sent


def _shared(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` (row, host, path, same, hashes, sizes, inside) -> (row_, shared): places of lines that the page shares with
    its nearest one.

    Pages are in order of host and path. On each side the first of the next ``REACH`` different pages of the host that is
    no copy is a neighbour; the nearest of the two has the longest common start of the path. Pages are dealt out by ranges
    of that order, so a large host is many tasks, and each range is sent the runs of equal pages next to it: where ranges
    end makes no difference.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for b in batches:
            for r in b.to_pylist():
                held.setdefault(r["to"], []).append(r)
        for rows in held.values():
            found = []
            runs: list[list[dict]] = []
            for r in rows:
                if runs and (runs[-1][0]["host"], runs[-1][0]["same"]) == (r["host"], r["same"]):
                    runs[-1].append(r)
                else:
                    runs.append([r])
            for k, members in enumerate(runs):
                beside = []
                for step, end in ((-1, -1), (1, 0)):
                    for j in range(k + step, k + step * (REACH + 1), step):
                        if not 0 <= j < len(runs) or runs[j][0]["host"] != members[0]["host"]:
                            break
                        if not is_copy(members[0], runs[j][0]):
                            beside.append((step, runs[j][end]))
                            break
                places = {step: common_lines(members[0]["hashes"], other["hashes"]) for step, other in beside}
                for row in members:
                    if beside and not row["halo"]:
                        near = min((-len(os.path.commonprefix([row["path"], other["path"]])), step) for step, other in beside)
                        if places[near[1]]:
                            found.append((row["row"], places[near[1]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int32()))], names=["row_", "shared"])

    ranged = settle(_ranged(rows, parts))
    near = ranged.where((F.col("first") | F.col("last")) & ((F.col("run") <= REACH + 1) | (F.col("run") >= F.col("runs") - REACH - 2)))
    # some rows for each range, however many pages there are
    sent = _halo(near.select("part", "run", "host", "same", "row", "first", "last").collect())
    halo = rows.sparkSession.createDataFrame(sent, "row_ long, to long")
    names = ["row", "host", "path", "same", "hashes", "sizes", "inside"]
    own = ranged.select(*names, F.col("part").alias("to"), F.lit(False).alias("halo"))
    more = ranged.join(halo, F.col("row") == F.col("row_")).select(*names, "to", F.lit(True).alias("halo"))
    return own.union(more).repartition(parts, "to").sortWithinPartitions("to", "host", "path", "row").mapInArrow(run, "row_ long, shared array<int>")


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, url, text, one row each.

    Elements that surround an article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments) go by
    tag, role and the names in class and id. Each page is paired with the page of the nearest URL on its host that is no copy
    of it, their lines are aligned by a longest common subsequence, and shared lines are deleted. The text is what is left
    in the page's article or main part, or on the whole page where it marks none or holds more outside of it.

    References are decoded, white space in a block becomes one space, blocks are joined by one space. Null and empty html
    give an empty text; null urls count as one host of their own. Repeated rows and ids are pages of their own. A page all of
    whose lines stand on a longer neighbour too is left empty. Other columns are not looked at. An empty table gives no rows.
    """
    parsed = _parsed(pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    parsed = settle(parsed.withColumn("row", F.monotonically_increasing_id()))
    url = F.lower(F.coalesce("url", F.lit("")))
    host = F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    path = F.regexp_replace(url, r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*|[?#].*$", "")
    parts = int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = F.xxhash64("hashes", "inside")
    shared = _shared(parsed.where(F.size("hashes") > 0).select(
        "row", host.alias("host"), path.alias("path"), same.alias("same"), "hashes", "sizes", "inside"), parts)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = []
            for packed, inside, shared in zip(batch["packed"], batch["inside"].to_pylist(), batch["shared"].to_pylist()):
                gone = set(shared or ())
                kept = [(x, y) for k, (x, y) in enumerate(zip(unpack(packed.as_py()).decode().split("\n"), inside)) if k not in gone]
                article = [x for x, y in kept if y]
                rest = sum(len(x) for x, y in kept if not y)
                texts.append(" ".join(article if article and sum(map(len, article)) >= rest else [x for x, _ in kept]))
            yield pa.RecordBatch.from_pydict({"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string())})

    joined = parsed.join(settle(shared), F.col("row") == F.col("row_"), "left").select("page_id", "url", "packed", "inside", "shared")
    return joined.mapInArrow(write, f"page_id {dict(parsed.dtypes)['page_id']}, url string, text string")
