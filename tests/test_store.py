"""The judgment store: what runs read, ask and leave behind."""

import json

from pyspark.sql import functions as F

from wayread.plans import runs as L
from wayread.sources import store as K

CALL = "request_key string, answers string, input_tokens long, output_tokens long, model string, error string"


def calls(spark, *rows):
    return spark.createDataFrame([(k, a, 1, 1, "m", None if a else e) for k, a, e in rows], CALL)


def replies(fails=()):
    def reply(request):
        if any(f in request for f in fails):
            raise TimeoutError("busy")
        ids = json.loads(request)["questions"]
        return {"answers": {n: {"type": "noul", "noul": 0.9} if n.endswith("_needed") else {"type": "choice", "choice": "evidence", "probabilities": {"evidence": 1}} for n in ids}}

    return reply


def corpus(spark, n=12):
    docs = spark.createDataFrame([(i, f"Document {i} says something that is long enough to be a passage of its own.") for i in range(n)], "doc_id long, text string")
    questions = spark.createDataFrame([(0, "What does it say?")], "question_id long, question string")
    return docs, docs.select("doc_id", F.lit(0).cast("long").alias("question_id")), questions


def test_a_run_reads_its_own_prefixes_only(spark, tmp_path):
    path = str(tmp_path / "s")
    K.append_calls(calls(spark, *[(f"{i:02x}rest{j}", "{}", None) for i in range(40) for j in range(3)]), path)
    keys = spark.createDataFrame([("07rest1",), ("07other",)], "request_key string")
    assert K.prefixes_of(keys) == ["07"]
    read = K.read_calls(spark, path, K.prefixes_of(keys))
    files = {r[0] for r in read.select(F.col("_metadata.file_path")).collect()}
    assert len(files) == 1 and "prefix=07" in files.pop() and read.count() == 3
    assert "prefix" in read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:60]


def test_the_latest_reply_holds_before_and_after_compaction(spark, tmp_path):
    path = str(tmp_path / "s")
    K.append_calls(calls(spark, ("aa1", '{"z":1}', None), ("aa2", None, "first"), ("bb1", None, "gone")), path)
    K.append_calls(calls(spark, ("aa1", '{"a":2}', None), ("aa2", '{"b":1}', None)), path)
    K.append_calls(calls(spark, ("aa2", None, "later failure"), ("bb1", None, "again")), path)

    def latest():
        return {r.request_key: (r.answers, r.error) for r in K.latest_calls(K.read_calls(spark, path)).collect()}

    expected = {"aa1": ('{"a":2}', None), "aa2": ('{"b":1}', None), "bb1": (None, "again")}
    assert latest() == expected and K.read_calls(spark, path).count() == 7
    assert K.compact(spark, path) == 1
    assert latest() == expected and K.read_calls(spark, path).count() == 3
    K.append_calls(calls(spark, ("aa1", '{"c":3}', None)), path)
    assert K.compact(spark, path) == 2
    assert latest()["aa1"] == ('{"c":3}', None) and K.read_calls(spark, path).count() == 3


def test_a_compaction_that_broke_off_does_not_count(spark, tmp_path):
    path = str(tmp_path / "s")
    K.append_calls(calls(spark, ("aa1", "{}", None)), path)
    spark.createDataFrame([("zz", "half", None, "done", "aa")], "request_key string, answers string, error string, outcome string, prefix string").write.partitionBy("outcome", "prefix").parquet(f"{path}/answers/version=1")
    assert [r.request_key for r in K.read_calls(spark, path).collect()] == ["aa1"]
    K.compact(spark, path)
    assert [r.request_key for r in K.read_calls(spark, path).collect()] == ["aa1"]


def test_second_run_asks_nothing(spark, tmp_path):
    path, (docs, runs, questions) = str(tmp_path / "s"), corpus(spark)
    seen = []
    for part in (runs.where("doc_id < 5"), runs, runs):
        counts = L.Counts()
        judged = L.judge(L.passages_text(docs), part, questions, replies(), store=path, counts=counts)
        assert judged.where("p = 0.9").count() == part.count()
        seen.append(counts.read())
    assert [(c["reused"], c["asked"], c["done"], c["failed"]) for c in seen] == [(0, 5, 5, 0), (5, 7, 7, 0), (12, 0, 0, 0)]


def test_failed_windows_are_listed_and_asked_again(spark, tmp_path):
    path, (docs, runs, questions) = str(tmp_path / "s"), corpus(spark)

    shaky = replies(("Document 3", "Document 7"))
    items = L.passages_text(docs)
    counts = L.Counts()
    judged = L.judge(items, runs, questions, shaky, store=path, on_error="skip", counts=counts)
    assert sorted(r.doc_id for r in judged.where("p is null").collect()) == [3, 7]
    assert counts.read()["failed"] == 2
    keys = L.J.digest_requests(L.J.make_windows(items.join(runs, "doc_id")), questions)
    failed = {r.doc_id: (r.error, r.failures) for r in K.failed_windows(keys, path).collect()}
    assert failed == {3: ("TimeoutError: busy", 1), 7: ("TimeoutError: busy", 1)}
    L.judge(items, runs, questions, shaky, store=path, on_error="skip")
    assert {r.failures for r in K.failed_windows(keys, path).collect()} == {2}
    again = L.Counts()
    assert L.judge(items, runs, questions, replies(), store=path, counts=again).where("p is null").count() == 0
    assert again.read()["asked"] == 2 and K.failed_windows(keys, path).count() == 0


def test_counts_without_a_store(spark):
    docs, runs, questions = corpus(spark, 4)
    counts = L.Counts()
    L.judge(L.passages_text(docs), runs, questions, replies(), counts=counts)
    assert counts.read() == {"reused": 0, "asked": 4, "done": 4, "failed": 0}
