import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wayread.operators import judge as J
from wayread.operators.digest import reading_path, select_digest, signal_stats
from wayread.operators.manifest import manifest, source_info
from wayread.plans import runs as L

ITEMS = "doc_id long, question_id long, idx int, text string, heading string, page int"


def windows(spark, n=5, size=2):
    rows = [(0, 7, i, f"item number {i}", "Head" if i == 0 else "", 1) for i in range(n)]
    return J.make_windows(spark.createDataFrame(rows, ITEMS), size)


def questions(spark):
    return spark.createDataFrame([(7, "What is it?")], "question_id long, question string")


def calls(spark, answers):
    return spark.createDataFrame([(k, json.dumps(a), 5, 2, "m") for k, a in answers.items()],
                                 "request_key string, answers string, input_tokens long, output_tokens long, model string")


def noul(p):
    return {"type": "noul", "noul": p}


def choice(role, confidence=0.5, p=0.6):
    return {"type": "choice", "choice": role, "confidence": confidence, "probabilities": {role: p}}


def test_digest_requests(spark):
    rows = sorted(J.digest_requests(windows(spark), questions(spark)).collect(), key=lambda r: r.window_no)
    assert [r.n_items for r in rows] == [2, 2, 1]
    first = json.loads(rows[0].request)
    assert first["state"] == {"question": "What is it?",
                              "passages": "P01| [under heading: Head] item number 0\nP02| item number 1"}
    assert list(first["questions"]) == ["P01_needed", "P01_role", "P02_needed", "P02_role"]
    assert first["questions"]["P02_needed"]["criteria"]["false"].startswith("P02 is irrelevant")
    assert len(first["questions"]["P01_role"]["criteria"]) == 7
    assert len({r.request_key for r in rows}) == 3


def test_find_requests(spark):
    rows = J.find_requests(windows(spark, 3, 25), questions(spark)).collect()
    (only,) = rows
    request = json.loads(only.request)
    assert request["state"] == {"query": "What is it?", "passage": "S01| item number 0\nS02| item number 1\nS03| item number 2"}
    assert list(request["questions"]) == ["S01", "S02", "S03"]
    assert "line S03" in request["questions"]["S03"]["instructions"]["question"]


def test_key_depends_on_model_question_and_text(spark):
    q2 = spark.createDataFrame([(7, "What else?")], "question_id long, question string")
    keys = [{r.request_key for r in J.digest_requests(windows(spark), q, m).collect()}
            for q, m in [(questions(spark), "a"), (questions(spark), "a"), (q2, "a"), (questions(spark), "b")]]
    assert keys[0] == keys[1] and not keys[0] & keys[2] and not keys[0] & keys[3]


def test_parse_answers(spark):
    requests = J.digest_requests(windows(spark, 4, 4), questions(spark))
    key = requests.first().request_key
    answers = {
        "P01_needed": noul(0.8), "P01_role": choice("evidence", 0.77, 0.66),
        "P02_needed": noul("0.5"), "P02_role": choice("unheard_of"),
        "P03_needed": noul("nope"), "P03_role": {"type": "choice", "choice": "background"},
        "P04_needed": noul(float("nan")), "P04_role": choice("counterpoint"),
    }
    rows = sorted(J.parse_answers(requests, calls(spark, {key: answers}), size=4).collect(), key=lambda r: r.idx)
    got = [(r.p, r.role, r.role_p, r.confidence) for r in rows]
    assert got[:3] == [(0.8, "evidence", 0.66, 0.77), (0.5, "irrelevant", 0.0, 0.5), (0.0, "background", 0.0, 0.0)]
    assert got[3][0] == 0.0


def test_missing_answers(spark):
    requests = J.digest_requests(windows(spark, 2, 2), questions(spark))
    key = requests.first().request_key
    answers = calls(spark, {key: {"P01_needed": noul(0.9), "P01_role": choice("evidence"), "P02_needed": noul(0.3)}})
    assert [r.missing_id for r in J.missing_answers(requests, answers).collect()] == ["P02_role"]
    with pytest.raises(PySparkException, match="answers missing: P02_role"):
        J.parse_answers(requests, answers, size=2).collect()
    rows = sorted(J.parse_answers(requests, answers, size=2, on_missing="default").collect(), key=lambda r: r.idx)
    assert [(r.p, r.role) for r in rows] == [(0.9, "evidence"), (0.3, "irrelevant")]


def test_usage_and_progress(spark):
    requests = J.digest_requests(windows(spark), questions(spark))
    keys = [r.request_key for r in requests.orderBy("window_no").collect()]
    answers = calls(spark, {k: {"P01_needed": noul(1.0)} for k in keys[:2]})
    (progress,) = J.run_progress(requests, answers).collect()
    assert (progress.windows_done, progress.windows_total) == (2, 3)
    (usage,) = L.usage_of(requests, answers).collect()
    assert (usage.input_tokens, usage.output_tokens, usage.model) == (10, 4, "m")


def documents(spark, copies=1):
    texts = ["Refund policy body text " * 8, "Evidence paragraph about refunds " * 8]
    pages = "\n".join(texts) + "\n" + "Filler without any meaning for this " * 20
    return spark.createDataFrame([(i, pages) for i in range(copies)], "doc_id long, text string")


def table_of(plan):
    def fn(request):
        asked = json.loads(request)["questions"]
        out = {}
        for name in asked:
            pos = int(name[1:3]) - 1
            p, role, role_p = plan.get(pos, (0.05, "irrelevant", 0.0))
            if name.endswith("_needed"):
                out[name] = {"type": "noul", "noul": p}
            else:
                out[name] = {"type": "choice", "choice": role, "confidence": role_p, "probabilities": {role: role_p}}
        return {"answers": out, "input_tokens": 100, "output_tokens": 10, "model": "fake"}
    return fn


def ask(spark):
    return spark.createDataFrame([(0, "What does the document say about refunds?")], "question_id long, question string")


def test_function_judge_end_to_end(spark, tmp_path):
    docs = documents(spark)
    runs = spark.createDataFrame([(0, 0)], "doc_id long, question_id long")
    fn = table_of({0: (0.92, "direct_answer", 0.9), 1: (0.88, "evidence", 0.85)})
    items = L.passages_text(docs)
    judged = L.judge(items, runs, ask(spark), fn).cache()
    path = reading_path(select_digest(judged))
    assert [(r.ord, r.label) for r in path.orderBy("ord").collect()] == [(1, "Direct answer"), (2, "Evidence")]
    requests = J.digest_requests(J.make_windows(items.join(runs, "doc_id")), ask(spark))
    usage = L.usage_of(requests, L.answer(requests, fn))
    source = source_info(docs, "text", F.lit("memory"), F.lit(1))
    (row,) = manifest(path, signal_stats(judged), usage, source, ask(spark), {"threshold": 0.45, "model": "fake"}).collect()
    m = row.manifest
    assert m.manifest_version == 2 and len(m.passages) == 2 and m.usage.input_tokens == 100
    assert m.passages[0].heading is None and m.passages[0].score == pytest.approx(0.92 * 0.98)
    assert 0 < m.signal.signal_ratio < 1 and m.model == "fake" and len(m.source.sha256) == 64


def test_nothing_qualifies(spark):
    runs = spark.createDataFrame([(0, 0)], "doc_id long, question_id long")
    path = L.digest_documents(documents(spark), runs, ask(spark), backend=table_of({}))
    assert path.count() == 0


def test_store_answers_copies_once(spark, tmp_path):
    store, log = str(tmp_path / "store"), str(tmp_path / "calls.txt")
    inner = table_of({0: (0.9, "evidence", 0.9)})

    def fn(request):
        with open(log, "a") as f:
            f.write("call\n")
        return inner(request)

    docs = documents(spark, copies=30)
    runs = docs.select("doc_id", F.lit(0).cast("long").alias("question_id"))
    for _ in range(2):
        path = L.digest_documents(docs, runs, ask(spark), backend=fn, store=store)
        assert path.count() == 30
    with open(log) as f:
        assert len(f.readlines()) == 1


def test_find_windows_are_clamped(spark, tmp_path):
    items = spark.createDataFrame([(0, i, f"sentence number {i}") for i in range(30)], "doc_id long, idx int, text string")
    qs = spark.createDataFrame([(0, "Number 7"), (1, "\u00a0 \t")], "question_id long, question string")
    runs = spark.createDataFrame([(0, 0), (0, 1)], "doc_id long, question_id long")
    for options, windows in (({}, 2), ({"size": 2}, 6), ({"size": 100}, 1)):
        log = str(tmp_path / f"calls-{windows}.txt")

        def fn(request):
            with open(log, "a") as f:  # noqa: B023
                f.write("call\n")
            answers = {name: {"type": "noul", "noul": 0.9} for name in json.loads(request)["questions"]}
            return {"answers": answers, "input_tokens": 1, "output_tokens": 1, "model": "fake"}

        found = L.find_in(items, runs, qs, 0.45, fn, **options)
        assert [r.idx for r in found.where("is_literal").orderBy("idx").collect()] == [7]
        assert {r.question_id for r in found.select("question_id").distinct().collect()} == {0}
        with open(log) as f:
            assert len(f.readlines()) == windows


def test_error_policy(spark, tmp_path):
    inner = table_of({0: (0.9, "evidence", 0.9)})

    def fn(request):
        if "item number 2" in request:
            raise RuntimeError("no luck")
        return inner(request)

    items = windows(spark).drop("question_id", "window_no", "pos")
    runs = spark.createDataFrame([(0, 7)], "doc_id long, question_id long")
    with pytest.raises(PySparkException, match="no luck"):
        L.judge(items, runs, questions(spark), fn, size=2)
    judged = L.judge(items, runs, questions(spark), fn, size=2, on_error="skip")
    got = {r.idx: r.p for r in judged.collect()}
    assert got == {0: 0.9, 1: 0.05, 2: None, 3: None, 4: 0.9}


def test_hot_keys_are_spread_and_joined_once(spark):
    facts = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    lookup = facts.select("k").distinct().withColumn("v", F.length("k"))
    plain = facts.join(lookup, "k").selectExpr("sum(v) v", "count(*) n").first()
    for joined in (J.hot_key_join(facts, lookup, "k", hot_rows=100), J.lookup_join(facts, lookup, "k")):
        assert joined.columns == ["k", "doc_id", "v"]
        assert joined.selectExpr("sum(v) v", "count(*) n").first() == plain


def test_blank_questions(spark):
    qs = spark.createDataFrame([(0, "  "), (1, " Why? ")], "question_id long, question string")
    runs = spark.createDataFrame([(5, 0), (5, 1), (6, 0)], "doc_id long, question_id long")
    assert [(r.doc_id, r.question) for r in J.valid_runs(runs, qs).collect()] == [(5, "Why?")]
    auto = spark.createDataFrame([(5, "What is 5?"), (6, "")], "doc_id long, question string")
    got = {(r.doc_id, r.question_id): (r.question, r.is_auto) for r in J.with_auto_question(runs, qs, auto).collect()}
    assert got == {(5, 0): ("What is 5?", True), (5, 1): ("Why?", False)}


def test_lexical_judge(spark):
    items = spark.createDataFrame(
        [(0, 0, "Refunds are paid within days"), (0, 1, "Nothing here"), (0, 2, "Refunds are paid, unless late"), (1, 0, "paid")],
        "doc_id long, idx int, text string")
    qs = spark.createDataFrame([(0, "refunds paid when?"), (1, "!!")], "question_id long, question string")
    runs = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, question_id long")
    got = {(r.doc_id, r.idx): (r.p, r.role, r.role_p) for r in J.judge_lexically(items, runs, qs).collect()}
    import math
    refunds, paid, when = math.log(1 + 4 / 2), math.log(1 + 4 / 3), math.log(1 + 4)
    p = round((refunds + paid) / (refunds + paid + when), 6)
    assert got[0, 0] == (p, "background", p) and got[0, 1] == (0.0, "irrelevant", 0.0)
    assert got[0, 2] == (p, "qualification", 1.0) and got[1, 0] == (0.0, "irrelevant", 0.0)


def test_lost_replies_fail_and_dirty_records_are_tidied(spark):
    requests = spark.createDataFrame([("k1", 1, 1, 0, 1), ("k2", 1, 1, 1, 1)], "request_key string, doc_id long, question_id long, window_no int, n_items int")
    for rows in ([("k1", "oops", None), ("k2", "{}", "timeout")], [("k2", None, "timeout")]):
        answers = spark.createDataFrame(rows, "request_key string, answers string, error string")
        with pytest.raises(Exception, match="reply absent or unreadable: k1"):
            J.parse_answers(requests, answers, "find").collect()
    failed = spark.createDataFrame([("k1", None, "timeout"), ("k2", None, "timeout")], "request_key string, answers string, error string")
    assert J.parse_answers(requests, failed, "find").count() == 0

    items = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "doc_id long, idx int")
    runs = spark.createDataFrame([(1, 7)], "doc_id long, question_id long")
    records = spark.createDataFrame(
        [(1, 7, 0, float("nan"), "seer"), (1, 7, 1, 0.5, None), (1, 7, 1, 0.4, None)], "doc_id long, question_id long, idx int, p double, role string")
    got = {r["idx"]: (r["p"], r["role"]) for r in J.judge_from_table(items, runs, records).collect()}
    assert got == {0: (0.0, "irrelevant"), 1: (0.5, None), 2: (None, None)}
