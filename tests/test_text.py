import random
import re

import plain
import pytest
from pyspark.sql import functions as F

from wayread.functions import text as T

ATOMS = ["a", "bc", "Mr", "etc", "U.S", "e.g", "A", "The", "word", "é", "É", "9", "(", ")", '"', "'", "”", "’", "]", "[",
         ".", "..", "!", "?", "…", " ", "  ", "\n", "\t", " ", "—", "-", "😀", "longerword", "approx", "No"]


def random_texts(n, most, seed, heavy=None):
    rng = random.Random(seed)
    pool = ATOMS + (heavy or [])
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, most))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string")


def column(spark, texts, expr):
    rows = frame(spark, texts).select("i", expr.alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


def test_clean_and_count(spark):
    texts = random_texts(300, 40, 1) + ["", "  x　\x85y "]
    assert column(spark, texts, T.clean_text(F.col("t"))) == [plain.clean(t) for t in texts]
    assert column(spark, texts, T.word_count(F.col("t"))) == [len(plain.clean(t).split(" ")) if plain.clean(t) else 0 for t in texts]


@pytest.mark.parametrize("most,heavy", [(60, None), (900, ["x" * 200, "y" * 400, "w " * 60])])
def test_sentences_match_plain_loop(spark, most, heavy):
    texts = random_texts(1500 if heavy is None else 200, most, 2, heavy) + ["... A b", "", " ", "x" * 1500]
    got = column(spark, texts, T.split_sentences(F.col("t")))
    for text, spans in zip(texts, got):
        assert [(x["s"], x["e"]) for x in spans] == plain.sentence_spans(text), repr(text)


def test_long_arrays_are_placed_right(spark):
    text = "One two. " * 3000
    (spans,) = column(spark, [text], T.split_sentences(F.col("t")))
    assert [(x["s"], x["e"]) for x in spans] == [(i * 9, i * 9 + 8) for i in range(3000)]


def test_split_long_matches_plain_loop(spark):
    texts = random_texts(200, 1500, 3, ["x" * 300, "word " * 50, "\r\n", "\x1d"]) + ["", " ", "z" * 2500, " \n" * 700,
             ("a" * 480 + " ") * 5, ("b" * 481 + " ") * 5]
    got = column(spark, texts, T.split_long(F.col("t")))
    for text, pieces in zip(texts, got):
        want = plain.long_pieces(text)
        assert pieces == want, repr(text)


def test_rfind_truncate_excerpt(spark):
    texts = random_texts(200, 60, 4) + ["word " * 60, "x" * 300]
    assert column(spark, texts, T.rfind(F.col("t"), 20)) == [t.rfind(" ", 0, 20) for t in texts]

    def quoted(t, limit=30):
        c = plain.clean(t)
        if len(c) <= limit:
            return c
        at = c.rfind(" ", 0, limit + 1)
        return (c[:at] if at > limit / 2 else c[:limit]).strip(" ") + "…"

    assert column(spark, texts, T.truncate_quoted(F.col("t"), 30)) == [quoted(t) for t in texts]
    flat = [plain.clean(t) for t in texts]
    assert column(spark, texts, T.excerpt(F.col("t"))) == [t if len(t) <= 120 else t[:120].rstrip(" ") + "..." for t in flat]


def test_headlines_and_ids(spark):
    texts = ["Title - Site name", "self-driving cars", "A | B", "A | Bee", "Plain", "x — " + "y" * 61]
    assert column(spark, texts, T.clean_headline(F.col("t"))) == ["Title", "self", "A", "A", "Plain", "x — " + "y" * 61]
    assert column(spark, ["", ""], T.item_id("P", F.col("i")))[0] == "P01"
    assert column(spark, [""], T.item_id("S", F.lit(122))) == ["S123"]


def test_trim_span(spark):
    (span,) = column(spark, ["ab  cd  ef"], T.trim_span(F.col("t"), F.lit(2), F.lit(8)))
    assert (span["s"], span["e"]) == (4, 6)
    (span,) = column(spark, ["ab    ef"], T.trim_span(F.col("t"), F.lit(2), F.lit(6)))
    assert span["s"] == span["e"]


def test_cleaned_text_is_cut_like_any(spark):
    words = "word and then some " * 90
    texts = ["", " ", " a ", "a  b", "a b \tc", " x\n\ny ", words, "y" * 2000, words + "\x1c " + words, "a\x1db\x1e\x1e c", words + "\n" + "z" * 1000 + " " + words,
             "a\u2028 b \u3000\u00a0c\x85d \x0b", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("clean", T.clean_text(F.col("text")))
    for r in df.select("text", "clean", T.split_long(F.col("clean")).alias("want"), T.split_clean(F.col("clean")).alias("got"), T.word_count(F.col("text")).alias("n"),
                       T.clean_word_count(F.col("clean")).alias("m")).collect():
        assert r.got == r.want and r.m == r.n
        assert r.text is None or r.clean == re.sub(r"[^\S\x1c-\x1f]+", " ", r.text).strip(" ")


def test_item_names_have_two_digits_or_more(spark):
    df = spark.createDataFrame([(n,) for n in (0, 8, 9, 98, 99, 12345, -1, -5, None)], "n int")
    assert [r[0] for r in df.select(T.item_id("P", F.col("n"))).collect()] == ["P01", "P09", "P10", "P99", "P100", "P12346", "P00", "P-4", "Pnull"]
