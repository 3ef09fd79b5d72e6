"""Extents of blocks, and what recedes around a reading path, against a tree walked in plain Python."""

import random

from wayread.operators import blocks as B
from wayread.operators import digest as D

NESTING = ["div", "section", "article", "main", "ul", "li", "blockquote"]


def grown(rng, depth=0):
    """Markup of a random tree, and its elements as (tag, children)."""
    tag = rng.choice(["p", "h2", "h1", *NESTING] if depth else NESTING)
    children = [grown(rng, depth + 1) for _ in range(rng.randint(1, 3))] if tag in NESTING and depth < 4 else []
    return tag, children


def written(tree):
    """Markup, and for every element its tag, first and last token; each element begins with a word."""
    tokens, found = [], []

    def put(node):
        tag, children = node
        place = len(found)
        found.append([tag, len(tokens), None])
        tokens.extend([f"<{tag}>", f" w{len(tokens)} "])
        for child in children:
            put(child)
        tokens.append(f"</{tag}>")
        found[place][2] = len(tokens) - 1

    put(tree)
    return "".join(tokens), found


def test_extents_and_background_of_trees(spark):
    rng = random.Random(8)
    trees = [written(grown(rng)) for _ in range(60)]
    pages = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(trees)], "page_id long, html string")
    extents, blocks = B.html_extents(pages), B.html_blocks(pages)
    got, ids = {}, {}
    for r in extents.where("block_id >= 0").collect():
        got.setdefault(r["page_id"], []).append((r["block_id"], r["tag"], r["until"]))
    for r in blocks.collect():
        ids.setdefault(r["page_id"], set()).add(r["block_id"])
    chosen, expected = [], set()
    for page, (_, elements) in enumerate(trees):
        mine = sorted(got[page])
        assert [t for _, t, _ in mine] == [t for t, _, _ in elements]
        number = {a: i for i, (a, _, _) in enumerate(mine)}
        inside = lambda a, b: elements[b][1] <= elements[a][1] <= elements[b][2]
        assert all(inside(a, b) == (mine[b][0] <= mine[a][0] <= mine[b][2]) for a in range(len(mine)) for b in range(len(mine)))
        picked = sorted(rng.sample(sorted(ids[page]), min(2, len(ids[page]))))
        heading = min(ids[page]) if page % 3 == 0 else None
        chosen += [(page, 5, n, b, heading) for n, b in enumerate(picked)]
        keep = {number[b] for b in picked} | ({number[heading]} if heading is not None else set())
        first = number[picked[0]]
        around = [e for e in range(len(mine)) if elements[e][0] in ("article", "main") and inside(first, e)]
        root = around[-1] if around and all(inside(number[b], around[-1]) for b in picked) else None
        for b in ids[page]:
            e = number[b]
            if (root is None or (inside(e, root) and e != root)) and elements[e][0] != "h1" and not any(inside(e, k) or inside(k, e) for k in keep):
                expected.add((page, 5, b))
    selected = spark.createDataFrame(chosen, "page_id long, question_id long, idx int, block_id int, heading_block_id int")
    found = [(r["page_id"], r["question_id"], r["block_id"]) for r in D.background_around(blocks, extents, selected).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) > 20


def test_blocks_left_open(spark):
    page = spark.createDataFrame([(1, "<div>a<li>b<li>c<p>d<p>e</div><p>f")], "page_id long, html string")
    rows = {r["block_id"]: (r["tag"], r["until"]) for r in B.html_extents(page).collect()}
    assert rows[0] == ("div", 10) and rows[2] == ("li", 3) and rows[4] == ("li", 10)
    assert rows[6] == ("p", 7) and rows[8] == ("p", 9) and rows[11] == ("p", 2**31 - 1) and rows[-1] == ("body", 2**31 - 1)
    assert B.html_extents(spark.createDataFrame([(2, None), (3, "")], "page_id long, html string")).count() == 2
