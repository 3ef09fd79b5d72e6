import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from wayread.operators import blocks as B
from wayread.operators import digest as D
from wayread.operators import find as N
from wayread.operators import labels as V
from wayread.operators import manifest as M
from wayread.sources import readers as R
from wayread.sources import sinks as W

PATH = ("doc_id long, question_id long, ord int, idx int, page int, role string, label string, p double, role_p double,"
        " confidence double, score double, text string, heading string, is_catch boolean,"
        " quads array<struct<page: int, quad: array<double>>>")


def path_frame(spark):
    quad = [0.0, 1.0, 9.0, 1.0, 0.0, 5.0, 9.0, 5.0]
    return spark.createDataFrame([
        (1, 0, 2, 5, 2, "qualification", "The catch", 0.9, 0.8, 0.7, 0.83, "second text", None, True, [(2, quad), (3, quad), (2, None)]),
        (1, 0, 1, 0, 1, "evidence", "Evidence", 0.12345, 0.5, 0.6, 0.5, "first " * 40, "Head", False, [(1, quad)]),
        (1, 0, 3, 9, 4, "evidence", "Evidence", 0.5, 0.5, 0.6, 0.4, "third", None, False, []),
    ], PATH)


def test_find(spark):
    rows = [(0, 0, 0, "Money back?", 0.8), (0, 0, 1, "REFUND now", 0.5), (0, 0, 2, "a refund", 0.2), (0, 0, 3, "x", None), (0, 0, 9, "y", 0.72)]
    df = spark.createDataFrame(rows, "doc_id long, question_id long, idx int, text string, p double").withColumn("question", F.lit(" refund "))
    matches = N.find_matches(df)
    assert sorted((r.idx, r.tier, r.is_literal) for r in matches.collect()) == [(0, "hi", False), (1, "mid", True), (9, "hi", False)]
    (s,) = N.find_summary(df).collect()
    assert (s.n_matches, s.n_literal, s.n_only_here) == (3, 2, 2)
    assert {r.idx for r in N.semantic_only(matches).collect()} == {0, 9}
    assert [r.idx for r in N.top_matches(matches, 1).collect()] == [0]
    assert {r.threshold: r.n_matches for r in N.find_sweep(df, [0.2, 0.8]).collect()} == {0.2: 4, 0.8: 1}


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_navigation_wraps_around(spark, chunk):
    idx = [0, 1, 4, 5, 6, 17]
    df = spark.createDataFrame([(g, 0, i) for g in (1, 2) for i in (idx if g == 1 else [3])], "doc_id long, question_id long, idx int")
    got = {(r.doc_id, r.idx): (r.match_no, r.n_matches, r.prev_idx, r.next_idx) for r in N.match_navigation(df, chunk=chunk).collect()}
    for n, i in enumerate(idx):
        assert got[1, i] == (n + 1, 6, idx[n - 1], idx[(n + 1) % 6])
    assert got[2, 3] == (1, 1, 3, 3)


def test_labels(spark, tmp_path):
    rows = [(i, "u", "find" if i % 2 else "digest", "q", "t", i / 10, None, None, i >= 5) for i in range(11)]
    labels = spark.createDataFrame(rows, V.LABEL_SCHEMA)
    (c,) = V.label_counts(labels).collect()
    assert (c.n_labels, c.n_yes, c.n_no) == (11, 6, 5)
    bins = {r.bin: (r.n_labels, r.precision) for r in V.label_calibration(labels, by=()).collect()}
    assert bins[9] == (2, 1.0) and bins[0] == (1, 0.0) and len(bins) == 10
    at = {r.threshold: (r.precision, r.recall) for r in V.label_thresholds(labels, [0.5, 0.9], by=()).collect()}
    assert at == {0.5: (1.0, 1.0), 0.9: (1.0, 2 / 6)}
    W.append_labels(labels, str(tmp_path / "l"))
    W.append_labels(labels, str(tmp_path / "l"))
    stored = R.read_labels(spark, str(tmp_path / "l"))
    assert stored.count() == 22
    W.export_labels(stored.limit(1), str(tmp_path / "export"))
    (line,) = spark.read.text(str(tmp_path / "export")).collect()
    assert "role" in json.loads(line.value)


def test_annotations(spark):
    rows = {(r.page, r.ord): r for r in M.annotation_plan(path_frame(spark)).collect()}
    assert set(rows) == {(1, 1), (2, 2), (3, 2)}
    assert rows[2, 2].title == "2 The catch" and len(rows[2, 2].quads) == 1
    assert rows[2, 2].content == "reading-path role=qualification; order=2; p=0.900; role_p=0.800; catch=yes"
    assert rows[1, 1].content == "reading-path role=evidence; order=1; p=0.123; role_p=0.500"


def test_printed_lines(spark):
    lines = {r.ord: r.line for r in M.path_lines(path_frame(spark)).collect()}
    assert lines[2] == "2 · The catch · 0.90 · 2 · second text"
    assert lines[1].endswith("...") and lines[1].startswith("1 · Evidence · 0.12 · 1 · first")
    signal = spark.createDataFrame([(1, 0, 40, 20, 0.5), (2, 0, 0, 0, None)],
                                   "doc_id long, question_id long, judged_words long, signal_words long, signal_ratio double")
    assert [r.line for r in M.signal_lines(signal).collect()] == ["Signal: 50% of judged text (20/40 words)"]


def test_manifest_agrees_with_annotations(spark, tmp_path):
    signal = spark.createDataFrame([(1, 0, 40, 20, 0.5), (2, 0, 9, 0, 0.0)],
                                   "doc_id long, question_id long, judged_words long, signal_words long, signal_ratio double")
    usage = spark.createDataFrame([(1, 0, 7, 3, "m")], "doc_id long, question_id long, input_tokens long, output_tokens long, model string")
    docs = spark.createDataFrame([(1, "abc"), (2, "x")], "doc_id long, text string")
    source = M.source_info(docs, "text", F.lit("file"), F.lit(4))
    qs = spark.createDataFrame([(0, "Why?")], "question_id long, question string")
    made = M.manifest(path_frame(spark), signal, usage, source, qs, {"threshold": 0.45, "model": "m"})
    W.write_manifest(made, str(tmp_path / "m"))
    with pytest.raises(AnalysisException):
        W.write_manifest(made, str(tmp_path / "m"))
    W.write_manifest(made, str(tmp_path / "m"), force=True)
    (line,) = spark.read.text(str(tmp_path / "m")).collect()
    m = json.loads(line.value)
    assert list(m) == ["manifest_version", "source", "question", "config", "model", "usage", "passages", "signal"]
    assert m["source"] == {"path": "file", "sha256": "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", "pages": 4}
    assert [p["order"] for p in m["passages"]] == [1, 2, 3] and m["passages"][1]["heading"] is None
    assert m["passages"][0]["quads"][0]["rect"] == [0.0, 1.0, 9.0, 5.0]
    boxes = sum(len([q for q in p["quads"] if q["quad"]]) for p in m["passages"])
    assert boxes == sum(len(r.quads) for r in M.annotation_plan(path_frame(spark)).collect())


def test_background(spark):
    blocks = spark.createDataFrame([(1, 0, "h1"), (1, 1, "h2"), (1, 2, "p"), (1, 3, "p"), (2, 0, "p")], "page_id long, block_id int, tag string")
    chosen = spark.createDataFrame([(1, 7, 2, 1)], "page_id long, question_id long, block_id int, heading_block_id int")
    got = D.background_blocks(blocks, chosen).collect()
    assert [(r.page_id, r.question_id, r.block_id) for r in got] == [(1, 7, 3)]


def test_text_files_and_empty_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line one\nline two " + "word " * 20)
    (tmp_path / "b.txt").write_text("tiny")
    docs = R.read_text_files(spark, str(tmp_path / "*.txt"))
    from wayread.operators.passages import passages_text

    empty = M.documents_without_text(docs, passages_text(docs))
    assert empty.count() == 1
    with pytest.raises(ValueError, match="no text found"):
        M.require_text(docs, passages_text(docs))
    hashed = R.read_binary_files(spark, str(tmp_path / "*.txt")).join(docs, "doc_id")
    assert hashed.count() == 2


# ---- laid-out documents

QUAD = [0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0]


def layout(spark, blocks):
    """blocks: (page, number, x0, x1, y0, text, size, bold)"""
    rows = [(0, page, n, float(x0), float(y0), float(x1), y0 + 20.0, 0.0, 800.0, [(t, QUAD, size, bold) for t in (text if isinstance(text, list) else [text])])
            for page, n, x0, x1, y0, text, size, bold in blocks]
    return spark.createDataFrame(rows, R.LAYOUT_SCHEMA)


def passages(spark, blocks):
    return sorted(B.passages_layout(layout(spark, blocks)).collect(), key=lambda r: r.idx)


LONG = "This body text is long enough to be a passage of its own. "


def test_layout_order(spark):
    got = passages(spark, [
        (2, 0, 36, 280, 300, "second page " + LONG, 11.0, False), (1, 1, 320, 580, 301, "right column " + LONG, 11.0, False),
        (1, 0, 36, 280, 300, "left column " + LONG, 11.0, False),
    ])
    assert [r.text.split()[0] for r in got] == ["left", "right", "second"]
    assert [(r.idx, r.page) for r in got] == [(0, 1), (1, 1), (2, 2)] and len(got[0].quads) == 1


def test_layout_long_and_short_blocks(spark):
    got = passages(spark, [(1, 0, 36, 280, 300, "Lorem ipsum dolor sit amet. " * 60, 11.0, False), (2, 0, 36, 280, 300, "Tiny.", 11.0, False),
                           (3, 0, 36, 280, 300, [LONG, "", LONG], 11.0, False)])
    assert len(got) >= 3 and all(40 <= len(r.text) <= 960 for r in got) and {r.page for r in got} == {1, 3}
    assert len(got[-1].quads) == 2


def test_layout_headings(spark):
    got = passages(spark, [
        (1, 0, 36, 280, 100, "Refunds", 20.0, True), (1, 1, 36, 280, 300, LONG, 11.0, False),
        (2, 0, 36, 280, 100, "note", 11.0, False), (2, 1, 36, 280, 300, LONG, 11.0, False),
        (3, 0, 36, 280, 100, "Bold heading that is long enough to be a passage", 11.0, True), (3, 1, 36, 280, 300, LONG * 30, 11.0, False),
    ])
    assert got[0].heading == "Refunds" and got[1].heading == ""
    third = [r for r in got if r.page == 3]
    assert third[0].heading == "" and third[1].heading == third[0].text and third[2].heading == ""


def test_running_headers(spark):
    blocks = []
    for page in (1, 2, 3):
        blocks += [(page, 0, 36, 280, 10, "Annual report of the company, printed on each page", 14.0, True),
                   (page, 1, 36, 280, 300, f"page {page} {LONG}", 11.0, False),
                   (page, 2, 36, 280, 400, "Repeated in the middle of the page, so it stays here", 11.0, False),
                   (page, 3, 36, 280, 770, "A footer that is repeated at the bottom of the pages", 11.0, False)]
    got = passages(spark, blocks)
    assert [r.text.split()[0] for r in got] == ["page", "Repeated"] * 3
    # a dropped header is still the block before the next one
    assert all(r.heading.startswith("Annual report") for r in got[::2])
    assert B.drop_repeated(B.layout_texts(layout(spark, blocks))).count() == 6


def test_page_offsets_in_buckets(spark):
    counts = spark.createDataFrame([(d, p, p % 3) for d in (1, 2) for p in range(1, 40)], "doc_id long, page int, n long")
    for bucket in (4, 1024):
        got = {(r.doc_id, r.page): r.before for r in B.page_offsets(counts, bucket=bucket).collect()}
        assert all(got[d, p] == sum(q % 3 for q in range(1, p)) for d in (1, 2) for p in range(1, 40))


def test_isotonic_calibration(spark):
    import random

    draw = random.Random(6)
    rows = [(i, "u", draw.choice(["find", "digest"]), "q", "t", draw.choice([draw.random(), 1.0, None]), draw.choice([None, "evidence"]), None, draw.random() < 0.5) for i in range(400)]
    labels = spark.createDataFrame(rows, V.LABEL_SCHEMA)
    found = {}
    for r in V.label_isotonic(labels, bins=20).collect():
        found.setdefault((r.mode, r.role), []).append((r.bin, r.n_labels, r.n_yes, r.calibrated))
    for (mode, role), got in found.items():
        blocks = []  # pool adjacent violators
        for b, n, yes, _ in sorted(got):
            blocks.append([yes, n, 1])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                yes2, n2, k2 = blocks.pop()
                blocks[-1] = [blocks[-1][0] + yes2, blocks[-1][1] + n2, blocks[-1][2] + k2]
        want = [yes / n for yes, n, k in blocks for _ in range(k)]
        assert [c for *_, c in sorted(got)] == pytest.approx(want)
        assert sum(n for _, n, _, _ in got) == sum(r[2] == mode and r[6] == role and r[5] is not None for r in rows)


def test_calibration_totals(spark):
    rows = [(1, "u", "find", "q", "t", 0.55, None, None, True), (2, "u", "digest", "q", "t", 0.51, "evidence", None, False), (3, "u", "digest", "q", "t", None, "evidence", None, True)]
    got = {(r.mode, r.role, r.all_modes, r.all_roles): (r.bin, r.n_labels, r.n_yes) for r in V.label_calibration_cube(spark.createDataFrame(rows, V.LABEL_SCHEMA)).collect()}
    assert got[None, None, True, True] == (5, 2, 1) and got["find", None, False, False] == (5, 1, 1) and got["find", None, False, True] == (5, 1, 1)
    assert got[None, None, True, False] == (5, 1, 1) and got[None, "evidence", True, False] == (5, 1, 0)


def test_sweep_rows_do_not_grow_with_the_grid(spark):
    import random

    from wayread.operators import digest as D

    draw = random.Random(9)
    rows = [(g, 0, i, "a b", draw.randint(0, 100) / 100, draw.choice(["evidence", "direct_answer", "qualification", "irrelevant"]), draw.randint(0, 10) / 10) for g in (1, 2) for i in range(300)]
    judged = spark.createDataFrame(rows, "doc_id long, question_id long, idx int, text string, p double, role string, role_p double")
    fine = [n / 100 for n in range(20, 91)]
    swept = {(r.doc_id, r.threshold): (r.n_selected, r.catch_idx) for r in D.threshold_sweep(judged, fine).collect()}
    for t in (0.2, 0.33, 0.45, 0.71, 0.9):
        for doc in (1, 2):
            path = D.select_digest(judged.where(F.col("doc_id") == doc), t).collect()
            catch = [r.idx for r in path if r.is_catch]
            assert swept[doc, t] == (len(path), catch[0] if catch else None)
    plan = D.threshold_sweep(judged, fine)._jdf.queryExecution().executedPlan().toString()
    expand = next(i for i, line in enumerate(plan.split("\n")) if "Generate posexplode(slice" in line)
    assert sum("Exchange" in line for line in plan.split("\n")[expand:]) >= 2  # both shuffles lie below the repeating
