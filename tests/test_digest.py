import random

import plain
import pytest
from pyspark.sql import functions as F

from wayread.constants import ROLE_NAMES
from wayread.functions.scoring import digest_score, tier
from wayread.operators import digest as D

BODY = "passage {} body text " * 6
SCHEMA = "doc_id long, question_id long, idx int, text string, page int, heading string, p double, role string, role_p double"


def judged(spark, groups):
    rows = []
    for g, items in enumerate(groups):
        for item in items:
            idx, p, role, role_p = (*item, 0.7)[:4]
            rows.append((g, 0, idx, BODY.replace("{}", str(idx)), 1, "", p, role, role_p))
    return spark.createDataFrame(rows, SCHEMA)


def paths(spark, groups, threshold=0.45):
    out = D.select_digest(judged(spark, groups), threshold).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.ord, r.idx, r.is_catch))
    return [sorted(got.get(g, [])) for g in range(len(groups))]


def test_score_weights(spark):
    cases = [(0.8, "direct_answer", 1.0, 0.8), (0.8, "qualification", 1.0, 0.768), (0.8, "background", 1.0, 0.72),
             (0.8, "background", 0.5, 0.648), (None, "evidence", None, 0.0)]
    df = spark.createDataFrame(cases, "p double, role string, role_p double, want double")
    for r in df.select("want", digest_score(F.col("p"), F.col("role"), F.col("role_p")).alias("s")).collect():
        assert r.s == pytest.approx(r.want, abs=1e-12)


def test_tiers(spark):
    df = spark.createDataFrame([(0.72,), (0.719,)], "p double").select(tier(F.col("p")).alias("t"))
    assert [r.t for r in df.collect()] == ["hi", "mid"]


def test_selection_cases(spark):
    cap = [(i, 0.95 - i * 0.01, "background") for i in range(10)]
    got = paths(spark, [
        [(0, 0.45, "background"), (1, 0.449, "background")],
        [(0, 0.95, "background"), (1, 0.94, "background"), (2, 0.93, "evidence"), (3, 0.90, "direct_answer")],
        [(0, 0.9, "background"), (1, 0.8, "evidence"), (2, 0.1, "background")],
        [(0, 0.9, "background"), (1, 0.44, "evidence")],
        cap,
        [(0, 0.8, "qualification", 0.7), (1, 0.8, "counterpoint", 0.7), (2, 0.95, "background", 0.9)],
        [(0, 0.9, None), (1, None, "evidence"), (2, 0.9, "irrelevant")],
    ])
    assert [i for _, i, _ in got[0]] == [0]
    assert {2, 3} <= {i for _, i, _ in got[1]} and len(got[1]) <= 7
    assert [i for _, i, _ in got[1]] == sorted(i for _, i, _ in got[1])
    assert len(got[2]) == 2 and len(got[3]) == 1 and len(got[4]) == 7
    assert [i for _, i, c in got[5] if c] == [0]
    assert got[6] == []


@pytest.mark.parametrize("threshold", [0.2, 0.45, 0.7, 0.9])
def test_selection_matches_plain_loop(spark, threshold):
    rng = random.Random(int(threshold * 100))
    groups = []
    for _ in range(400):
        few = rng.choice([2, 4, 20])
        groups.append([
            (i, rng.choice([None] + [n / 20 for n in range(21)]), rng.choice(ROLE_NAMES + [None]), rng.randint(0, few) / few)
            for i in range(rng.randint(0, 60))
        ])
    assert paths(spark, groups, threshold) == [plain.reading_path(g, threshold) for g in groups]


def test_rank_limit_runs_before_the_shuffle(spark):
    text = D.select_digest(judged(spark, [[(0, 0.9, "background")]]))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_sweep_equals_single_thresholds(spark):
    rng = random.Random(5)
    groups = [[(i, rng.randint(0, 20) / 20, rng.choice(ROLE_NAMES), rng.randint(0, 4) / 4) for i in range(25)] for _ in range(20)]
    df = judged(spark, groups)
    swept = {(r.doc_id, r.threshold): r for r in D.threshold_sweep(df).collect()}
    assert len(swept) == 20 * 15
    for t in D.threshold_grid():
        signal = {r.doc_id: r for r in D.signal_stats(df, t).collect()}
        for g, items in enumerate(groups):
            want = plain.reading_path(items, t)
            row = swept[(g, t)]
            assert row.n_selected == len(want)
            assert row.catch_idx == next((i for _, i, c in want if c), None)
            assert (row.signal_words, row.signal_ratio) == (signal[g].signal_words, signal[g].signal_ratio)


def test_signal(spark):
    def group(rows):
        return spark.createDataFrame([(0, 0, i, *r) for i, r in enumerate(rows)],
                                     "doc_id long, question_id long, idx int, text string, p double, role string")

    r = D.signal_stats(group([("w " * 20, 0.9, "background"), ("w " * 5, 0.9, "irrelevant")])).first()
    assert (r.judged_words, r.signal_words, r.signal_ratio) == (25, 20, 0.8)
    body = BODY
    r = D.signal_stats(group([(body, 0.45, "background"), (body, 0.449, "background"), ("w " * 20, None, None)])).first()
    assert (r.judged_words, r.signal_words, r.signal_ratio) == (48, 24, 0.5)
    r = D.signal_stats(group([(body, None, None)])).first()
    assert (r.judged_words, r.signal_words, r.signal_ratio) == (0, 0, None)
    r = D.signal_stats(group([("w " * 31, 0.1, "background"), ("w", 0.9, "background")])).first()
    assert r.signal_ratio == 0.0312


def test_summary_and_leaderboard(spark):
    df = judged(spark, [[(0, 0.9, "background"), (1, 0.8, "qualification"), (2, 0.8, "background")], [(0, 0.1, "background")]])
    signal = D.signal_stats(df)
    path = D.reading_path(D.select_digest(df))
    rows = {r.doc_id: r for r in D.digest_summary(path, signal).collect()}
    assert rows[0].labels == ["Background", "The catch"] and rows[0].n_selected == 3 and rows[0].signal_percent == 100
    assert rows[1].labels == [] and rows[1].signal_percent == 0
    assert [r.doc_id for r in D.signal_leaderboard(signal, 1).collect()] == [0]
