"""Whole runs: pages that ask their own question, laid-out documents down to boxes."""

import json

import pytest

from wayread.plans import runs as L
from wayread.plans.recorded import layout_from_lines

WORDS = "and then some more words that make a passage of it"


def recorder(log):
    def judge(request):
        asked = json.loads(request)
        with open(log, "a") as f:
            f.write(asked["state"]["question"] + "\n")
        ids = asked["questions"]
        return {"answers": {n: {"type": "noul", "noul": 0.9} if n.endswith("_needed") else {"type": "choice", "choice": "evidence", "confidence": 1, "probabilities": {"evidence": 1}} for n in ids},
                "input_tokens": 10, "output_tokens": 2, "model": "fake"}

    return judge


def test_blank_questions_become_the_pages_own(spark, tmp_path):
    log = str(tmp_path / "asked.txt")
    pages = spark.createDataFrame(
        [(1, "u", f"<h1>About tea</h1><p>First {WORDS}</p>"), (2, "u", f"<p>Second {WORDS}</p>"), (3, "u", "<p>no</p>")], "page_id long, url string, html string")
    questions = spark.createDataFrame([(0, " \t"), (1, "What is it?")], "question_id long, question string")
    runs = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (1, 1)], "doc_id long, question_id long")
    path, signal = L.digest_pages(pages, runs, questions, backend=recorder(log))
    assert sorted((r.doc_id, r.question_id) for r in path.collect()) == [(1, 0), (1, 1), (2, 0)]
    with open(log) as f:
        asked = f.read().splitlines()
    assert len(asked) == 3 and "What is it?" in asked
    assert sum("About tea" in q for q in asked) == 1 and sum("Second and then" in q for q in asked) == 1
    assert {r.doc_id for r in signal.collect()} == {1, 2}
    lexical, _ = L.digest_pages(pages, runs, questions, 0.0)
    assert {(r.doc_id, r.question_id) for r in lexical.collect()} <= {(1, 0), (1, 1), (2, 0)}


def test_laid_out_documents_end_in_boxes(spark, tmp_path):
    texts = spark.createDataFrame([(1, f"Title\nOne {WORDS}\nTwo {WORDS}"), (2, f"Three {WORDS}"), (3, "short")], "doc_id long, text string")
    docs = texts.selectExpr("doc_id", "concat('doc/', doc_id) AS path", "text AS content")
    questions = spark.createDataFrame([(0, "What is it?")], "question_id long, question string")
    runs = texts.selectExpr("doc_id", "0L AS question_id")
    judge = recorder(str(tmp_path / "log.txt"))
    manifests, plan = L.digest_layout(docs, layout_from_lines(texts), runs, questions, backend=judge, on_empty="skip")
    found = {r.doc_id: r.manifest for r in manifests.collect()}
    assert set(found) == {1, 2}
    one = found[1]
    assert [p.text.split()[0] for p in one.passages] == ["One", "Two"] and one.source.pages == 1 and one.question == "What is it?"
    assert one.usage.input_tokens == 10 and one.model == "fake" and one.config.batch_size == 12
    for passage in one.passages:
        (quad,) = passage.quads
        xs, ys = quad.quad[0::2], quad.quad[1::2]
        assert quad.rect == [min(xs), min(ys), max(xs), max(ys)]
    assert sorted((r.doc_id, r.ord) for r in plan.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_a_document_without_text_fails_the_run(spark, tmp_path):
    texts = spark.createDataFrame([(1, f"One {WORDS}"), (3, "short")], "doc_id long, text string")
    docs = texts.selectExpr("doc_id", "'p' AS path", "text AS content")
    questions = spark.createDataFrame([(0, "What is it?")], "question_id long, question string")
    log = tmp_path / "log.txt"
    with pytest.raises(Exception, match="no text found in document 3"):
        L.digest_layout(docs, layout_from_lines(texts), texts.selectExpr("doc_id", "0L AS question_id"), questions, backend=recorder(str(log)))
    assert not log.exists()
