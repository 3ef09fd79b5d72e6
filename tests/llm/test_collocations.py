"""Phrase counts and collocations against plain loops."""

import random
import re
from collections import Counter

import pytest

from wayread.llm import collocations as C

SCHEMA = "doc_id long, lang string, text string, count long, words int, cell long, run string, phrase string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, lang, text, 1, 2, 3, "r", "p") for i, (lang, text) in enumerate(rows)], SCHEMA).repartition(parts)


def plain_counts(rows, longest):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    return counts, totals


def plain(rows, least, longest, top, absorbed):
    counts, totals = plain_counts(rows, longest)
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    covered = set()
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inner = lang, words[i : i + k]
                if 100 * a >= absorbed * counts[inner]:
                    covered.add(inner)
    found = {}
    for (lang, words), a in candidates.items():
        if (lang, words) in covered:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    out = set()
    for lang, rows_ in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def texts(draw, n):
    words = ["The", "the", "éa", "ÉA", "b", "of", "\x1fx", "\xa0", "New", "york", "city", "ﬀ", "\x00"]
    gaps = [" "] * 8 + ["  ", "\t", ". ", ",", "\n", "\r\n", "!", "\x0b"]
    made = []
    for _ in range(n):
        parts = [draw.choice(words) + draw.choice(gaps) for _ in range(draw.randint(0, 40))]
        if draw.random() < 0.5:
            parts.insert(draw.randint(0, len(parts)), "new york city hall ")
        made.append((draw.choice(["en", "en", "de", None, "und"]), "".join(parts) if draw.random() > 0.05 else None))
    return made


@pytest.mark.parametrize("entries,bits,longest", [(1_000_000, 1 << 20, 4), (40, 64, 4), (40, 1 << 16, 5), (40, 1 << 16, 2)])
def test_random_texts(spark, entries, bits, longest):
    rows = texts(random.Random(longest), 150)
    rows += rows[:20]
    found = C.collocations(table(spark, rows), least=4, longest=longest, top=40, absorbed=80, bits=bits, entries=entries)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows_of(found) == plain(rows, 4, longest, 40, 80)


def test_trie_bursts_and_spills():
    draw = random.Random(3)
    words = [f"w{min(int(draw.expovariate(0.3)), 60)}" for _ in range(6000)]
    work = C.Counting((1, 2, 3), 5, None, entries=900, burst=64)
    text = " ".join(words).encode()
    runs = []
    for part in range(0, len(words), 500):  # texts of their own
        runs += work.add("en", " ".join(words[part : part + 500]).encode())
    deep = {len(p) for t in work.tries.values() for p in t.containers}
    runs += work.finish()
    assert len(runs) > 20 and {0, 4} <= deep and text
    merged = Counter()
    for lang, cell, run in runs:
        if cell >= 0:
            for row in C._merged(lang, [run], 1, 64).to_pylist():
                merged[lang, tuple(row["phrase"].split(" "))] += row["count"]
    expected, totals = plain_counts([("en", " ".join(words[p : p + 500])) for p in range(0, len(words), 500)], 3)
    assert merged == expected
    assert [int.from_bytes(r, "little") for _, c, r in runs if c < 0] == [totals["en"]]


def test_runs_are_sorted_and_keep_to_their_partition():
    work = C.Counting((2,), 3, None, entries=100, burst=16)
    runs = [*work.add("x", b"b a b c a b b a c d a b"), *work.finish()]
    cells = {}
    for _, cell, run in runs:
        raw = C.zstandard.decompress(run)
        phrases = raw[8 : 8 + int.from_bytes(raw[:8], "little")].split(b"\n")
        assert phrases == sorted(phrases)
        for p in phrases:
            assert cells.setdefault(p, cell) == cell


def test_one_long_text_is_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE", 64)
    draw = random.Random(8)
    long = " ".join(draw.choice(["alpha", "beta", "gamma", "delta", "x" * 90]) for _ in range(3000))
    work = C.Counting((1, 2, 3, 4), 2, None, entries=300, burst=32)
    merged = Counter()
    for lang, cell, run in [*work.add("en", long.encode()), *work.finish()]:
        for row in C._merged(lang, [run], 1, 64).to_pylist() if cell >= 0 else []:
            merged[lang, tuple(row["phrase"].split(" "))] += row["count"]
    assert merged == plain_counts([("en", long)], 4)[0]


def test_hot_pair(spark):
    rows = [("en", "hot pair " + f"w{i % 7} hot pair") for i in range(400)] + [("en", f"a{i} b{i}") for i in range(400)]
    assert rows_of(C.collocations(table(spark, rows), least=30)) == plain(rows, 30, 4, 2000, 80)


def test_counts_that_pass_64_bits_stay_exact(spark):
    big = 9_000_000_000_000_000_000
    found = spark.sql(f"SELECT cast((cast({big}L as decimal(19,0)) * 2000000) div (cast({big}L as decimal(19,0)) + cast({big}L as decimal(19,0))) as bigint)").first()[0]
    assert found == 1_000_000


def test_empty(spark):
    assert rows_of(C.collocations(table(spark, []))) == set()
    assert rows_of(C.collocations(table(spark, [(None, None), ("en", ""), ("en", " \t.")]))) == set()
