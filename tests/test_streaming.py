import random

import plain
from pyspark.sql import functions as F

from wayread.constants import ROLE_NAMES
from wayread.streaming import streams as S


def drain(writer, checkpoint):
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_label_counts_grow(spark, tmp_path):
    path, ck = str(tmp_path / "labels"), str(tmp_path / "ck")
    row = (1, "u", "find", "q", "t", 0.5, None, None, True)
    spark.createDataFrame([row, row[:-1] + (False,)], S.LABEL_SCHEMA).write.parquet(path)
    writer = S.stream_labels(spark, path).writeStream.outputMode("complete").format("memory").queryName("label_counts")
    drain(writer, ck)
    assert [tuple(r) for r in spark.table("label_counts").collect()] == [("find", 2, 1, 1)]
    spark.createDataFrame([row, (1, "u", "digest", "q", "t", 0.5, "evidence", 0.5, True)], S.LABEL_SCHEMA).write.mode("append").parquet(path)
    drain(writer, ck)
    assert sorted(tuple(r) for r in spark.table("label_counts").collect()) == [("digest", 1, 1, 0), ("find", 3, 2, 1)]


def judged_rows(rng, doc, run, n, start=0):
    return [(doc, 0, i, 1, "", f"word {i} " * 3, rng.randint(0, 20) / 20, rng.choice(ROLE_NAMES), 0.5, 0.5, run)
            for i in range(start, start + n)]


def test_paths_follow_judgments(spark, tmp_path):
    rng = random.Random(1)
    source, table, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    first, second = judged_rows(rng, 1, 1, 12), judged_rows(rng, 2, 1, 12)
    more, again = judged_rows(rng, 1, 1, 12, 12), judged_rows(rng, 2, 2, 5)
    spark.createDataFrame(first + second, S.JUDGED_SCHEMA).write.parquet(source)
    drain(S.stream_judgments(spark, source, table), ck)
    spark.createDataFrame(more + again, S.JUDGED_SCHEMA).write.mode("append").parquet(source)
    drain(S.stream_judgments(spark, source, table), ck)

    paths = {}
    for r in S.current(spark, table, "paths").collect():
        paths.setdefault(r.doc_id, []).append((r.ord, r.idx, r.is_catch))
    want = {1: first + more, 2: again}
    for doc, rows in want.items():
        assert sorted(paths.get(doc, [])) == plain.reading_path([(r[2], r[6], r[7], r[8]) for r in rows], 0.45)
    words = {r.doc_id: r.judged_words for r in S.current(spark, table, "signal").collect()}
    assert words == {1: 24 * 6, 2: 5 * 6}


def test_stale_answers_are_dropped(spark):
    rows = [(1, 0, 0, 1), (1, 0, 1, 1), (1, 0, 0, 2), (2, 0, 0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, question_id long, idx int, run_id long")
    assert sorted(tuple(r) for r in S.latest_runs(df).select("doc_id", "idx", "run_id").collect()) == [(1, 0, 2), (2, 0, 1)]


def test_pages_are_cut_as_they_arrive(spark, tmp_path):
    source, table, ck = (str(tmp_path / n) for n in ("pages", "passages", "ck"))
    schema = "page_id long, url string, html string"
    for i in range(2):
        spark.createDataFrame([(i, "u", f"<h1>Top {i}</h1><p>{'word ' * 20}</p>")], schema).write.mode("append").parquet(source)
        drain(S.stream_documents(spark, source, table), ck)
    got = sorted((r.page_id, r.heading) for r in S.current_passages(spark, table).collect())
    assert got == [(0, "Top 0"), (1, "Top 1")]


def page(i, words, heading="Top"):
    return (i, "u", f"<h1>{heading}</h1>" + "".join(f"<p>{w} {'word ' * 20}</p>" for w in words))


def test_pages_sent_again_replace_what_they_had(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FOLD", 2)
    source, table, ck = (str(tmp_path / n) for n in ("pages", "out", "ck"))
    sent = [[page(1, "ab"), page(2, "c"), page(2, "c")], [page(1, "x")], [page(3, "yz"), (2, "u", "")], [page(2, "q", "New")], [page(1, "")]]
    now = {}
    for rows in sent:
        spark.createDataFrame(rows, S.PAGE_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        drain(S.stream_digests(spark, source, table, lambda p: p.select("*", F.lit(5).cast("long").alias("question_id"), F.lit(0.9).alias("p"), F.lit("evidence").alias("role"), F.lit(0.5).alias("role_p"), F.lit(0.5).alias("confidence"))), ck)
        for i, _, html in rows:
            now[i] = html.count("<p>")
        judged, paths, signal = (S.current_digests(spark, table, n) for n in ("judged", "paths", "signal"))
        counts = {r.doc_id: r["count"] for r in judged.groupBy("doc_id").count().collect()}
        assert counts == {i: n for i, n in now.items() if n}
        assert {r.doc_id: r["count"] for r in paths.groupBy("doc_id").count().collect()} == counts
        assert sorted(r.doc_id for r in signal.collect()) == sorted(counts)


def test_tables_stay_bounded_over_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FOLD", 4)
    monkeypatch.setattr(S, "BUCKETS", 2)
    rng = random.Random(4)
    source, table, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    want, most = {}, 0
    for batch in range(20):
        rows = judged_rows(rng, batch % 3, 1, 4, rng.randint(0, 12))
        spark.createDataFrame(rows, S.JUDGED_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        drain(S.stream_judgments(spark, source, table), ck)
        want.setdefault(batch % 3, {}).update({r[2]: r for r in rows})
        most = max(most, sum(f.suffix == ".parquet" for f in (tmp_path / "out" / "judged").rglob("bucket=0/*")))
    assert most <= 2 * (4 + 1)
    found = {}
    for r in S.current(spark, table, "paths").collect():
        found.setdefault(r.doc_id, []).append((r.ord, r.idx, r.is_catch))
    for doc, rows in want.items():
        assert sorted(found.get(doc, [])) == plain.reading_path([(r[2], r[6], r[7], r[8]) for _, r in sorted(rows.items())], 0.45)


def test_dirty_judgments(spark, tmp_path):
    source, table, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = [(1, 0, 0, 1, "", "some words", float("nan"), "evidence", 0.5, 0.5, 1), (1, 0, 1, 1, "", "some words", 0.9, "mystery", 0.5, 0.5, 1),
            (1, 0, 2, 1, "", "some words", 0.8, "evidence", float("nan"), 0.5, 1), (1, 0, 2, 1, "", "some words", 0.7, "evidence", 0.5, 0.5, 1),
            (1, 0, 3, 1, "", "some words", None, None, None, None, 1)]
    spark.createDataFrame(rows, S.JUDGED_SCHEMA).write.parquet(source)
    drain(S.stream_judgments(spark, source, table), ck)
    (path,) = S.current(spark, table, "paths").collect()
    assert (path.idx, path.score) == (2, 0.8 * 0.9 * 0.8)
    (signal,) = S.current(spark, table, "signal").collect()
    assert (signal.judged_words, signal.signal_words) == (6, 2)


def test_items_with_several_texts_in_a_batch(spark, tmp_path):
    source, table, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    row = lambda idx, text, p, run=1, doc=1, heading="", page=1: (doc, 0, idx, page, heading, text, p, "evidence", 0.5, 0.5, run)
    first = [row(0, "a b", 0.9), row(0, "z", 0.5), row(0, "z", 0.8), row(1, "c", 0.7), row(1, "c", 0.6), row(2, None, 0.75, heading="c d"), row(2, "c d", 0.9, heading=None),
             row(None, "e f", 0.8), row(None, "g", 0.7), row(3, "h", 0.7, page=2), row(3, "i", 0.8), row(5, "old", 0.9, run=0), row(5, "older", 0.9, run=0),
             row(0, "x", 0.9, doc=None), row(0, "y", 0.9, doc=None), row(0, "x", 0.9, run=None), row(0, "y", 0.9, run=None)]
    sent, found = [], {}
    for rows in (first, [row(0, "b", 0.85), row(0, "a b c", 0.95), row(1, "c", 0.65), row(1, "c", 0.65)]):
        sent.append(rows)
        spark.createDataFrame(rows, S.JUDGED_SCHEMA).repartition(3).write.mode("append").parquet(source)
        drain(S.stream_judgments(spark, source, table), ck)
        found = {r.idx: (r.text, r.p, r.heading) for r in S.current(spark, table, "paths").collect()}
        (signal,) = S.current(spark, table, "signal").collect()
        if len(sent) == 1:
            assert found == {0: ("z", 0.8, None), 1: ("c", 0.7, None), 2: (None, 0.75, "c d"), 3: ("h", 0.7, None), None: ("g", 0.7, None)}
            assert signal.judged_words == 4
    assert found == {0: ("b", 0.85, None), 1: ("c", 0.65, None), 2: (None, 0.75, "c d"), 3: ("h", 0.7, None), None: ("g", 0.7, None)}
    assert signal.judged_words == 4


def test_judgments_written_without_their_number_of_words(spark, tmp_path):
    source, table, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rng = random.Random(3)
    first = judged_rows(rng, 1, 1, 6)
    for rows in (first, judged_rows(rng, 1, 1, 4, 4)):
        spark.createDataFrame(rows, S.JUDGED_SCHEMA).write.mode("append").parquet(source)
        drain(S.stream_judgments(spark, source, table), ck)
        if rows is first:
            at = f"{table}/judged/slot=0/batch_id=0"
            old = [tuple(r) for r in spark.read.parquet(at).drop("words").collect()]
            spark.createDataFrame(old, f"{S.JUDGED_SCHEMA}, bucket int").write.mode("overwrite").partitionBy("bucket").parquet(at)
    (signal,) = S.current(spark, table, "signal").collect()
    assert signal.judged_words == 8 * 6
