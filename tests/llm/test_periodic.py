"""Periodic runs against plain loops."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from wayread.llm import periodic as R
from wayread.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, runs string, key long, collapsed string, n_words int"


def plain(words, least=12):
    """Every run, by going through all periods and places."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - at >= max(least, 2 * q):
                found.setdefault((at, end + q - at), q)  # the smallest period of a stretch comes first
            at = end
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sequences(draw, n):
    """Random words of few kinds, with repeated stretches and repetitions within repetitions."""
    for _ in range(n):
        kinds = draw.choice([1, 2, 3, 8])
        words = [draw.randint(0, kinds - 1) for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 4)):
            if words:
                s = draw.randrange(len(words))
                block = words[s : s + draw.randint(1, 20)] * draw.randint(1, 5)
                at = draw.randint(0, len(words))
                words[at:at] = block
        yield words[:400]


@pytest.mark.parametrize("least", [1, 2, 12])
def test_random_sequences(least):
    texts = list(sequences(random.Random(least), 400))
    found = R.runs_of([np.array(t, np.int32) for t in texts], least)
    for text, runs in zip(texts, found):
        assert [tuple(r) for r in runs.tolist()] == plain(text, least)


def test_fibonacci_words_and_powers(monkeypatch):
    monkeypatch.setattr(R, "POINTS", 50)
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    texts = [b, [0] * 500, [0, 1] * 200, list(range(300)), ([0] * 7 + [1]) * 60, b + [2] + b]
    found = R.runs_of([np.array(t, np.int32) for t in texts])
    for text, runs in zip(texts, found):
        assert [tuple(r) for r in runs.tolist()] == plain(text)


def test_extensions():
    draw = random.Random(2)
    texts = [t for t in sequences(draw, 60) if len(t) > 5]
    words = np.concatenate([np.append(t, 100 + i) for i, t in enumerate(texts)])
    text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    same = R.Extensions(words, text)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    for i, t in enumerate(texts):
        pairs = [(draw.randrange(len(t)), draw.randrange(len(t))) for _ in range(30)]
        a, b = np.array([p for p in pairs if p[0] != p[1]]).T + begin[i]
        expected = []
        for x, y in zip(a, b):
            n = 0
            while words[x + n] == words[y + n]:
                n += 1
            expected.append(n)
        assert same(a, b).tolist() == expected


def test_long_texts_take_time_in_proportion():
    draw = np.random.default_rng(1)
    one = np.zeros(200_000, np.int32)
    mixed = np.concatenate([draw.integers(0, 500, 100_000), np.tile(draw.integers(0, 500, 30_000), 5)]).astype(np.int32)
    began = time.time()
    ones, mix = R.runs_of([one, mixed])
    assert time.time() - began < 60
    assert [tuple(r) for r in ones.tolist()] == [(0, 200_000, 1)]
    assert any(length >= 150_000 and q == 30_000 for _, length, q in mix.tolist())


def test_rows(spark, monkeypatch):
    rows = [
        (1, "a b " * 8, "r", 1, "c", 1), (1, "a b " * 8, "r", 1, "c", 1), (2, None, "", 0, "", 0), (3, "", "", 0, "", 0), (4, " \t\n", "", 0, "", 0),
        (None, "x " * 12, "", 0, "", 0), (5, "é\x1f\xa0z " * 6 + "q\x0bé\x1f\xa0z " * 6, "", 0, "", 0), (6, "w", "", 0, "", 0), (7, "long " * 3000 + "tail", "", 0, "", 0),
    ]
    out = R.periodic_runs(spark.createDataFrame(rows, SCHEMA).repartition(2))
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    found = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()), key=str)
    expected = []
    for key, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain(words)
        expected.append((key or 0, len(words), runs, collapsed(words, runs)))
    assert found == sorted(expected, key=str)
    assert R.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_text_in_slices(monkeypatch):
    monkeypatch.setattr(R, "SLICE", 16)
    text = ("lorem ipsum dolor\tsit\x0bamet " * 20 + "x" * 50 + " end").encode()
    numbers = R._Numbers()
    coded = numbers.of(text)
    known = list(numbers.known)
    assert [known[i] for i in coded] == text.split()


def test_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    checked = 0
    for doc_id, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 1500:
            continue
        checked += 1
        runs = plain(words)
        row = rows[doc_id]
        assert row["n_runs"] == len(runs)
        assert row["runs_sha256"] == digest("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert row["collapsed_sha256"] == digest(collapsed(words, runs))
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        expected = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == expected
    assert checked > 150
