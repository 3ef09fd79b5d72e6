"""Windows, counts and dictionaries of the compression classifier against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from wayread.llm import toxicity as X

WORDS = "der die das und ein haus weg fluss brücke straße licht wind regen 東京 о́стров stone river mill".split()
ENDS = ["", *"er en ung lich eur ing ado ción ß ée".split()]
PHRASE = " mill regen brücke haus wind river das stone licht weg "


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(ENDS) for _ in range(n))


def test_windows_cover_every_byte_and_overlap():
    for n in [0, 1, 47, 48, 49, 72, 73, 500, 1001]:
        places = X.windows(n).tolist()
        assert sorted({i for a, m in places for i in range(a, a + m)}) == list(range(n))
        assert all(m == min(n, X.WINDOW) for _, m in places) and all(0 < b[0] - a[0] <= X.STEP for a, b in zip(places, places[1:]))


def test_counts_are_those_of_single_windows(monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 600)  # texts are joined and cut
    rng = random.Random(4)
    texts = [None, "", "  \n ", "Stone", *(text_of(rng, n) for n in (3, 40, 700, 5, 300))]
    gains = X.Gains(b" the quiet river " * 8, b" grobian stone mill ")
    expected = np.zeros((len(texts), X.MOST + 1), int)
    for row, text in enumerate(texts):
        whole = X.body(text)
        for a, n in X.windows(len(whole)).tolist():
            window = whole[a:a + n]
            expected[row, min(X.MOST, max(0, len(gains.ordinary.compress(window)) - len(gains.toxic.compress(window))))] += 1
    assert (gains.counts(texts) == expected).all() and expected[:3].sum() == 0


def test_stretches_are_maximal_runs_of_typical_pieces():
    rng = random.Random(5)
    for _ in range(40):
        text = X.body(text_of(rng, 30))
        all_pieces = [text[i:i + X.PIECE] for i in range(len(text) - X.PIECE + 1)]
        assert [int.from_bytes(p, "little") for p in all_pieces] == X.pieces(text).tolist()
        typical = {p for p in set(all_pieces) if rng.random() < 0.5}
        expected, i = set(), 0
        while i < len(all_pieces):
            j = i
            while j < len(all_pieces) and all_pieces[j] in typical:
                j += 1
            if j > i and j - i + X.PIECE - 1 <= X.STRETCH:
                expected.add(text[i:j + X.PIECE - 1])
            i = max(j, i + 1)
        got = X.stretches(text, np.sort(np.array([int.from_bytes(p, "little") for p in typical], np.int64)))
        assert expected <= got and all(len(s) <= X.STRETCH for s in got)
        assert {s[i:i + X.PIECE] for s in got for i in range(len(s) - X.PIECE + 1)} == typical


def test_phrases_of_ordinary_words_count(spark):
    """Toxic text made of ordinary words in an order of its own is found, copies do not make text toxic, ties and long texts do no harm."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        text = text_of(rng, 60)
        if toxic:
            text = text[:100] + PHRASE + text[100:180] + PHRASE + text[180:] + PHRASE
        rows.append((i, text))
        labels.append((i, int(toxic)))
    copy = text_of(rng, 80) + " zephyr quokka umlaut"
    rows += [(i, copy) for i in range(1200, 1230)] + [(1230, None), (1231, ""), (1232, "x" * 100_000), (1233, copy)]
    labels += [(i, 1) for i in range(1200, 1230)] + [(1230, 1), (0, None), (7, 5), (None, 1), (99, 0), (99, 0)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    model = X.fit(documents, spark.createDataFrame(labels, "doc_id long, toxic int"))
    fresh = [(2000 + i, text_of(rng, 50) + (PHRASE if i % 2 else " ") + text_of(rng, 20) + (PHRASE if i % 2 else "") * 2) for i in range(60)]
    found = X.scored(spark.createDataFrame(fresh, "doc_id long, text string"), model).select("doc_id", (F.col("toxicity_") >= 0.3).alias("said")).collect()
    assert sum(r["said"] == bool(r["doc_id"] % 2) for r in found) >= 54
    assert b"quokka" not in model.toxic
    assert X.scored(documents, model).where("toxicity_ between 0 and 1").count() == len(rows)
    again = X.fit(documents.repartition(3), spark.createDataFrame(labels[::-1], "doc_id long, toxic int"))
    assert again.ordinary == model.ordinary and again.toxic == model.toxic
