"""Each operator on rows made to break it, against plain loops."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayread.llm import embeddings, extraction, minhash, mixing, packing, search, sentences, sharding, suffixes, toxicity
from wayread.llm.components import connected

SCHEMA = "doc_id long, text string, source string, label string, bucket long, n long, id long"
LONG = " ".join(f"word{i % 997} other{i}" for i in range(3000))
A = "The quick brown fox jumps over the lazy dog near the old river bank. It was a very cold morning in the north. Nobody came by."
ROWS = [
    (1, A, "a"), (2, A, "a"), (3, A + " One more line here.", "b"), (4, None, "b"), (5, "", None), (6, "   \n ", "b"), (7, "short", "a"),
    (8, "Unrelated opening words of eight. " + A, "c"), (9, LONG, "c"), (10, LONG + " tail", "c"), (11, "SHORT", "c"), (None, A, "a"), (12, "übergröße 日本 🙂 " * 30, None),
    (13, "a" * 300, "a"), (14, "a" * 120 + "b", "b"), (1, A, "a"), (15, "line one.\nline two", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "x", 1, 2, 3) for i, t, s in ROWS], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def unique(docs):
    return docs.where("doc_id is not null").dropDuplicates(["doc_id"])


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_sets(text):
    words = (text or "").encode().lower().translate(None)
    words = [w for w in minhash.WORDS.findall(words)]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("percent", [85])
def test_minhash(docs, empty, percent):
    got = minhash.near_duplicates(docs, percent=percent).collect()
    assert len(got) == len(ROWS) and minhash.near_duplicates(empty).count() == 0
    sets = {i: brute_sets(t) for i, t, _ in ROWS if i is not None}
    link = {i: {j for j in sets if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])} | {i} for i in sets}
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None or r["n_shingles"] > 0
            continue
        seen, todo = set(), {r["doc_id"]}
        while todo:
            seen |= todo
            todo = {j for i in todo for j in link[i]} - seen
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), min(seen), min(seen) == r["doc_id"])


@pytest.mark.parametrize("percent", [95, 85, 80, 60, 50, 30])
def test_bands_miss_few_pairs_at_any_threshold(percent):
    rows = minhash.band_rows(percent)
    assert (1 - (percent / 100) ** rows) ** (minhash.COORDINATES // rows) < 1e-6
    assert percent != 85 or rows == 5


def test_sketch_estimates_similarity():
    x = np.unique(minhash.mix(np.arange(1, 2001, dtype=np.uint64)))
    a, b = x[:1800], x[200:]
    share = (minhash.sketch(a) == minhash.sketch(b)).mean()
    assert abs(share - 1600 / 2000) < 0.15
    assert (minhash.sketch(x[:1]) != 0).all()  # one element fills every coordinate


def test_substring_dedup(docs, empty):
    got = {r["doc_id"]: r for r in sentences.deduplicated(docs).collect()}
    assert sentences.deduplicated(empty).count() == 0
    assert got[1]["text"] == A and got[2]["text"] == "" and got[4]["text"] is None and got[None]["text"] == A
    assert got[3]["text"] == "One more line here." and got[8]["text"].startswith("Unrelated")
    assert got[7]["text"] == "short" and got[15]["text"] == "line one.\nline two" and got[9]["bucket"] == 1
    assert "".join(sentences.split(LONG + A)) == LONG + A


def test_substring_dedup_without_spaces(spark):
    zh = "".join(f"这是第{k}个没有空格的中文句子，它在两篇文章里都出现过。" for k in range(8))
    hi = " ".join(f"यह वाक्य संख्या {k} दोनों लेखों में आता है।" for k in range(8))
    short = "好的。谢谢。"
    rows = [(1, zh), (2, "开头不同。" + zh + "结尾不同。"), (3, hi), (4, "अलग शुरुआत। " + hi), (5, short), (6, short)]
    got = dict(sentences.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect())
    assert got == {1: zh, 2: "开头不同。结尾不同。", 3: hi, 4: "अलग शुरुआत। ", 5: short, 6: short}


def test_extraction(spark):
    page = ('<html><head><title>T</title><style>p{}</style></head><body><nav>menu<article class="post"><header><h1>Head &amp; line</h1><p>by me</p></header>'
            '<p>A <b>b</b>old  3 < 5<br>new</p><script>var t="</p>";</script><div class="comments"><p>bad</p><div>worse</div></div><p>end'
            '<aside>no</aside><div hidden>none</div></article><footer>&copy; f</footer>')
    assert " ".join(extraction.blocks(page)[0]) == "Head & line A bold 3 < 5 new end"
    near = [(i, f"http://h.example/a/{i}", f"<p>same top line</p><p>own text {i}</p><p>same bottom</p>") for i in range(4)]
    rows = [(10, None, None), (11, "http://h.example/z", ""), (12, "x", page), *near, *near[:1]]
    pages = spark.createDataFrame([(*r, "k", 5) for r in rows], "page_id long, url string, html string, host string, row long")
    got = sorted((r["page_id"], r["text"]) for r in extraction.main_text(pages.coalesce(1)).collect())
    assert (10, "") in got and (11, "") in got and (12, "Head & line A bold 3 < 5 new end") in got and len(got) == len(rows)
    assert extraction.main_text(pages.limit(0)).count() == 0
    for a, b in [([1, 2, 3, 4], [2, 9, 4, 3]), ([5, 5, 1], [5, 1, 5]), ([], [1])]:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        chain = extraction.common_lines(a, b)
        assert len(chain) == best[-1][-1] and chain == sorted(set(chain))


def test_extraction_keeps_slugs_and_wrappers():
    kept = lambda page: " ".join(t for t, _ in extraction.lines(page))
    assert kept('<article><h2 id="search-algorithms">S</h2><section id="related-work"><p>t</p></section><div class="section" id="notices">n</div></article>') == "S t n"
    assert kept('<div class="no-sidebar"><p>body</p></div>') == "body"
    assert kept('<form id="aspnetForm"><div class="menu">m</div><p>long body text</p></form>') == "long body text"
    assert kept('<form id="login"><p>name and password</p></form><p>the body of this page</p>') == "the body of this page"
    assert kept('<div class="sidebar"><div role="main">m</div></div>') == "m"
    assert kept("<article><p>if <math><mi>x</mi><mo>=</mo></math></p><object><p>fall</p></object></article>") == "if x= fall"
    assert kept('<article><p>a</p><div class="site-comments">many words of others here</div></article><div class="ad-slot">longer than the article</div>') == "a"


def test_extraction_differences_marked_pages(spark):
    body = lambda i: " ".join(f"b{i}x{k}" for k in range(20))
    rows = [(i, f"http://h.example/a/{i:02}", f"<main><p>share this</p><p>{body(i)}</p></main><p>links</p>") for i in range(6)]
    rows += [(6, "http://h.example/a/03x", rows[3][2].replace("links", "other")), (7, "http://t.example/a", f"<p>{body(7)}</p><article>teaser</article>")]
    got = dict(extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text").collect())
    assert got == {i: body(i) for i in range(6)} | {6: body(3), 7: f"{body(7)} teaser"}


def test_extraction_is_the_same_for_any_number_of_ranges(spark):
    body = lambda i: " ".join(f"b{i}x{k}" for k in range(20))
    rows = [(i, f"http://h{i % 2}.example/a/{i:03}", f"<p>menu</p><p>top {i // 10}</p><p>{body(i // 3)}</p><p>foot</p>") for i in range(60)]
    rows += [(60, "http://h0.example/a/020x", "<p>menu</p><p>foot</p>")]
    pages, got, held = spark.createDataFrame(rows, "page_id long, url string, html string"), [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append(dict(extraction.main_text(pages).select("page_id", "text").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert got[0] == got[1] == got[2] and got[0][60] == ""
    assert not any("menu" in t or "foot" in t for t in got[0].values()) and all(body(i // 3) in got[0][i] for i in range(60))


def test_toxicity(spark, docs, empty):
    sf = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(documents, labels.where(~toxicity.held_out()))
    held = toxicity.scored(documents, model).where(toxicity.held_out()).join(labels, "doc_id").select("toxicity_", "toxic").toPandas()
    said, true = held.toxicity_ >= 0.3, held.toxic == 1
    assert (said & true).sum() / said.sum() > 0.7 and (said & true).sum() / true.sum() > 0.65
    assert held.toxicity_.between(0, 1).all()
    assert toxicity.scored(docs, model).count() == len(ROWS) and toxicity.scored(docs, model).where("toxicity_ is null").count() == 0
    assert toxicity.scored(empty, model).count() == 0
    assert {r[0] for r in toxicity.scored(docs, toxicity.fit(docs, labels.limit(0))).select(F.round("toxicity_", 6)).collect()} == {0.0}


def test_search(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(80)] + [(80, None), (81, [1.0, None] * 3), (82, [float("nan")] * 6), (83, [0.0] * 6), (5, [9.0] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score long").select("vec_id", search.weights("embedding").alias("terms"), "score")
    got = search.top_k(df.where("vec_id % 20 = 0"), df, 7).collect()
    held = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, w in held:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in held if i != q)[:7]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert search.top_k(df.limit(0), df, 3).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 16))
    rows = [(i, (base[i % 6] + rng.normal(size=16) * 0.12 * (i % 5)).tolist(), i % 2 if i % 11 else None) for i in range(90)]
    rows += [(90, None, 1), (91, [0.0] * 16, 1), (92, [float("inf")] * 16, 0), (93, rows[2][1], 0), (94, rows[2][1], 0), (95, rows[2][1][:8], 0), (96, [], 0)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.93, tile=16).collect()}
    ok = {i: np.array(v) for i, v, l in rows if v and l is not None and np.isfinite(v).all() and any(v)}
    label = {i: l for i, _, l in rows}
    near = {i: {j for j in ok if j != i and label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.sqrt(ok[i] @ ok[i] * (ok[j] @ ok[j])) >= 0.93} for i in ok}
    for i, _, _ in rows:
        seen, todo = set(), {i}
        while todo:
            seen |= todo
            todo = {k for j in todo for k in near.get(j, ())} - seen
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(near.get(i, ())), min(seen), min(seen) == i)


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    got = packing.packed(docs, capacity=64).collect()
    want = []
    for i, text, _ in ROWS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        assert [o for o, _ in sorted(held)] == np.cumsum([0, *[n for _, n in sorted(held)]])[:-1].tolist() and sum(n for _, n in held) <= 64
    assert len(places) <= math.ceil(sum(r["length"] for r in got) / 64) + 1
    assert packing.packed(empty).count() == 0


def test_packing_encodes_end_of_text_as_the_tokenizer_does(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>"), (3, "x<|endoftext|>\n"), (4, "<|endoftext"), (5, "<|other|>")]
    want = {i: [*tokenizer.encode(text, add_special_tokens=False).ids, 2] for i, text in rows}
    assert want[1] == [64, 220, 50256, 275, 2]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), capacity=64).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in got} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_best_fit_matches_one_at_a_time():
    rng = np.random.default_rng(1)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 101, 60), rng.integers(1, 40, 60))}
    gaps = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fits = [g for g in gaps if g >= n]
            gap = min(fits) if fits else 100
            if fits:
                gaps.remove(gap)
            gaps.append(gap - n)
    plan = packing.best_fit(counts, 100)
    assert max(first + bins for _, _, _, first, bins, _ in plan) == len(gaps)
    assert all(sum(each * bins for length, _, each, _, bins, _ in plan if length == n) == c for n, c in counts.items())


def test_suffixes(docs, empty):
    rows = unique(docs)
    got = {r["doc_id"]: r for r in suffixes.without_repeats(rows, 50).collect()}
    seen, texts = set(), {r["doc_id"]: (r["text"] or "").encode() for r in rows.collect()}
    for doc in sorted(texts):
        b = texts[doc]
        gone = np.zeros(len(b), bool)
        own = {b[s:s + 50] for s in range(len(b) - 49)}
        for s in range(len(b) - 49):
            if b[s:s + 50] in seen:
                gone[s:s + 50] = True
        seen |= own
        r = got[doc]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(b), int(gone.sum()), int(np.diff(gone.astype(int), prepend=0).clip(0).sum()))
        assert hashlib.sha256(r["kept"]).digest() == hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).digest()
    assert suffixes.without_repeats(empty).count() == 0
    assert suffixes.without_repeats(docs).count() >= len(ROWS)


def test_mixing(spark, docs, empty):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 7}" if i % 7 else None) for i, n in enumerate(rng.integers(0, 60, 700))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(df).collect()
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, open_ = dict.fromkeys(order, 0.0), set(order)
    budget = 1.5 * sum(sizes.values())
    while True:
        rest = budget - sum(want[s] for s in order if s not in open_)
        for s in open_:
            want[s] = rest * weight[s] / sum(weight[x] for x in open_)
        over = {s for s in open_ if want[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
        open_ -= over
    for s in order:
        assert goal[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 2
    again = mixing.copies(df.repartition(3)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    mixed = mixing.mixed(df).select(F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0]
    assert mixed == sum(taken.values())
    assert mixing.copies(docs).count() == len(ROWS) and mixing.copies(empty).count() == 0


def test_mixing_takes_whole_documents(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{i}" for _ in range(int(n))), f"s{i % 300}") for i, n in enumerate(rng.integers(1, 60, 400))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(df, weights=(1.0, 2.0, 3.0)).collect()
    assert all(r["taken"] == r["copies"] * r["size"] and abs(r["copies"] - r["target"] / r["source_size"]) < 1 for r in got)
    goal = sum({r["source"]: r["target"] for r in got}.values())
    assert abs(sum(r["taken"] for r in got) - goal) <= 120
    texts = {i: t for i, t, _ in rows}
    kept = mixing.mixed(df, weights=(1.0, 2.0, 3.0)).collect()
    assert len(kept) == sum(r["copies"] for r in got) and all(r["text"] == texts[r["doc_id"]] for r in kept)


def test_sharding(spark, docs, empty):
    rows = [(i, f"text {i % 50}", f"s{min(i % 9, 3)}") for i in range(5000)]
    got = sharding.interleaved(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=8).collect()
    slots, mix = defaultdict(list), defaultdict(lambda: defaultdict(int))
    for r in got:
        slots[r["shard"]].append(r["slot"])
        mix[r["source"]][r["shard"]] += 1
        text = rows[r["doc_id"]][1].encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) and len(s) == 625 for s in slots.values())
    assert all(max(m.values()) - min(m.values()) <= 2 for m in mix.values())
    few = sharding.interleaved(docs, shards=8).collect()
    counts = [sum(r["shard"] == k for r in few) for k in range(8)]
    assert len(few) == len(ROWS) and max(counts) - min(counts) <= 1 and sharding.interleaved(empty).count() == 0


def test_packing_takes_long_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, " " * 1_000_000), (2, "a" + "\n" * 800_000 + "<|endoftext|>b"), (3, "plain words")]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), capacity=1 << 21).collect()
    want = {i: np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4") for i, text in rows}
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in got} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}


def test_names_that_clash(spark):
    names = ["key_", "spans_", "features_", "copies_", "turn_", "KEY__", "toxicity_", "sentences_", "removed_", "s", "words", "p"]
    rows = [(i, A if i < 3 else f"text number {i}", "ab"[i % 2], *[f"{n}{i}" for n in names]) for i in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    kept = [n for n in names if n not in ("sentences_", "removed_")]
    cut = sentences.deduplicated(table).orderBy("doc_id").collect()
    assert [[r[n] for n in kept] for r in cut] == [[f"{n}{i}" for n in kept] for i in range(6)] and cut[1]["removed_"] > 0
    for row in mixing.mixed(table).collect():
        assert tuple(row) == rows[row["doc_id"]]
    model = toxicity.fit(table, spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int"))
    for row in toxicity.scored(table, model).collect():
        assert [row[n] for n in names if n != "toxicity_"] == [f"{n}{row['doc_id']}" for n in names if n != "toxicity_"] and 0 <= row["toxicity_"] <= 1


@pytest.mark.parametrize("rows_each", [1, 2, 10])
def test_sharding_of_many_small_sources(spark, rows_each):
    sources = 20_000 // rows_each
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % sources).cast("string")).alias("source"),
                                      F.lit(5).alias("size"), F.lit(7).alias("text_crc32"), F.floor(F.col("id") / sources).alias("rank"))
    cells = 20_000 // sharding.CELL
    part = sharding.fractional_rank(F.col("rank"), F.lit(rows_each), 0)
    largest = rows.groupBy(F.floor(part * cells).alias("cell")).count().agg(F.max("count")).first()[0]
    assert largest <= 2.5 * 20_000 / cells
    got = sharding.interleaved(rows.select("doc_id", F.lit("text").alias("text"), "source"), shards=8).groupBy("shard").count().collect()
    assert [r["count"] for r in got] == [2500] * 8
