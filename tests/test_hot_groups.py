"""One group owns most rows: results stay whole, and little of it reaches one task."""

import plain
from pyspark.sql import functions as F

from wayread.operators import digest as D
from wayread.operators import find as N
from wayread.plans.recorded import recorded


def judged(spark, hot=60000, others=200):
    rows = spark.range(hot).select(F.lit(0).cast("long").alias("doc_id"), F.col("id").cast("int").alias("idx"))
    rest = spark.range(others * 20).select((F.col("id") / 20).cast("long").alias("doc_id"), (F.col("id") % 20).cast("int").alias("idx")).where("doc_id > 0")
    items = rows.unionByName(rest).withColumns({"question_id": F.lit(3).cast("long"), "text": F.lit("some words here"), "page": F.lit(1), "heading": F.lit("")})
    return recorded(items.repartition(8))


def test_selection(spark):
    df = judged(spark)
    rows = {}
    for r in df.select("doc_id", "idx", "p", "role", "role_p").collect():
        rows.setdefault(r.doc_id, []).append((r.idx, r.p, r.role, r.role_p))
    got = {}
    for r in D.select_digest(df).collect():
        got.setdefault(r.doc_id, []).append((r.ord, r.idx, r.is_catch))
    for doc, items in rows.items():
        assert sorted(got.get(doc, [])) == plain.reading_path(items, 0.45)


def shuffled_records(node):
    """Records written by every exchange of a plan that has run."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        yield from shuffled_records(node.executedPlan())
    elif name.endswith("QueryStage"):
        yield from shuffled_records(node.plan())
    elif name == "Exchange":
        yield node.metrics().apply("shuffleRecordsWritten").value()
    children = node.children()
    for i in range(children.size()):
        yield from shuffled_records(children.apply(i))


def test_rows_shuffled_for_selection(spark):
    df = judged(spark, others=1).checkpoint()
    assert df.where("p >= 0.45 and role <> 'irrelevant'").count() > 20000
    selected = D.select_digest(df)
    selected.collect()
    counts = list(shuffled_records(selected._jdf.queryExecution().executedPlan()))
    # 8 tasks send at most 13 rows for each of 6 roles; the second exchange moves what is left of the one run
    assert len(counts) == 2 and max(counts) <= 8 * 13 * 6 and min(counts) <= 13 * 6


def test_signal_and_navigation(spark):
    df = judged(spark)
    words = {r.doc_id: r.judged_words for r in D.signal_stats(df).collect()}
    assert words[0] == 180000 and words[1] == 60
    hits = df.where("p >= 0.45").select("doc_id", "question_id", "idx")
    steps = N.match_navigation(hits, chunk=1000)
    last = hits.groupBy("doc_id").agg(F.max("idx").alias("last"), F.min("idx").alias("first"), F.count("*").alias("n"))
    ends = steps.join(last, "doc_id")
    assert ends.where("match_no = 1 and prev_idx <> last or match_no = n and next_idx <> first or n_matches <> n").count() == 0
    assert steps.where("doc_id = 0").agg(F.sum("match_no")).first()[0] == (lambda n: n * (n + 1) // 2)(hits.where("doc_id = 0").count())


def test_a_question_with_most_of_the_rows_is_dealt_out(spark):
    from wayread.operators.joins import hot_key_join

    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        facts = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id") % 1000).alias("question_id")).checkpoint()
        lookup = spark.range(1001).select(F.col("id").alias("question_id"), (F.col("id") * 2).alias("x"))
        joined = hot_key_join(facts, lookup, "question_id")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("part")).count().collect()]
        assert sum(sizes) == 100_000 and max(sizes) < 2 * 100_000 / 16, sizes
        assert joined.where("x <> 2 * question_id").count() == 0
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
