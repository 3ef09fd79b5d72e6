"""The driver's queries over these operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayread.functions.arrays import let
from wayread.llm import chat, collocations, embeddings, extraction, minhash, mixing, packing, periodic, search, sentences, sharding, suffixes, toxicity
from wayread.llm.common import WORD, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleaved(read(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), capacity=1024, end=2)


@query
def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", search.weights("embedding", 64.0).alias("terms"))
    return search.top_k(rows.where(F.col("vec_id") % 20 == 0), rows, k=20)


@query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"), least=0.93)


ORACLE["op5_search"] = """
WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT vec_id, generate_subscripts(w, 1) AS term, unnest(w) AS weight FROM r),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.weight * c.weight) AS BIGINT) AS score
      FROM t q JOIN t c ON q.term = c.term AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

ORACLE["op6_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
c AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT c.node, p.b FROM c JOIN p ON p.a = c.seen),
m AS (SELECT node, min(seen) AS component_id FROM c GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN m ON m.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


ORACLE["op1_minhash"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(list_transform(s, lambda x: hash(x))) AS h FROM d),
n AS (SELECT doc_id, len(s) AS n FROM d),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT c.node, g.b FROM c JOIN g ON g.a = c.seen),
m AS (SELECT node, min(seen) AS component_id FROM c GROUP BY node)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m ON m.node = n.doc_id"""


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sentences.deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("sentences_").alias("n_sentences"), F.col("removed_").alias("n_removed"), "text")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, read(spark, sf_dir, "labels").where(~toxicity.held_out()))
    score = F.col("toxicity_")
    out = toxicity.scored(documents, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), score.alias("score"), F.when(score >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extraction.main_text(read(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.without_repeats(read(spark, sf_dir, "documents"), length=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: What a user and an assistant say in conversation -7: the template's own marks.
SELF_QUOTING = "\\### Assistant: </turn> ok"


@query
def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["conv_id", "turn", "role", "text"]
    rows = read(spark, sf_dir, "conversations").select(*names)
    quoting = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SELF_QUOTING).alias("text"))
    written = chat.formatted(rows.unionByName(quoting))
    back = written.select("conv_id", "formatted", "valid", chat.turns_of(F.col("formatted")).alias("turns"), chat.under_loss(F.col("segments")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


ORACLE["op12_chat"] = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before, role = 'assistant' AS trained,
  length(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\t')) AS n FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (trained), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (trained), '')) AS loss_sha256,
  CAST(sum(n + 4 + length(role) + 2 + 8) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN i = 1 THEN role IN ('system', 'user') WHEN role = 'user' THEN before IN ('system', 'assistant') WHEN role = 'assistant' THEN before = 'user' ELSE false END)
    AND max_by(role, i) <> 'system' AS valid
FROM o GROUP BY conv_id"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"), least=30, longest=4, top=2000, absorbed=80)


ORACLE["op13_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, 1 AS k, unnest(list_transform(generate_series(1, len(w) - 0), lambda i: array_to_string(list_slice(w, i, i + 0), ' '))) AS phrase FROM w WHERE len(w) >= 1
      UNION ALL SELECT lang, 2 AS k, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 1), ' '))) AS phrase FROM w WHERE len(w) >= 2
      UNION ALL SELECT lang, 3 AS k, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) AS phrase FROM w WHERE len(w) >= 3
      UNION ALL SELECT lang, 4 AS k, unnest(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) AS phrase FROM w WHERE len(w) >= 4),
f AS (SELECT lang, k AS words, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE words >= 2 AND a >= 30),
u AS (SELECT lang, words, phrase, a, w, unnest(generate_series(1, words - 1)) AS k FROM c),
v AS (SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS head, array_to_string(list_slice(w, k + 1, words), ' ') AS rest FROM u),
s AS (SELECT v.lang, v.phrase, v.a, v.k, x.a AS l, y.a AS r, CAST(CAST(v.a AS HUGEINT) * 2000000 // (x.a + y.a) AS BIGINT) AS score
      FROM v JOIN f x ON x.lang = v.lang AND x.phrase = v.head JOIN f y ON y.lang = v.lang AND y.phrase = v.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(list_slice(w, start, start + size - 1), ' ') AS phrase, max(a) AS longer
      FROM c, (SELECT unnest([2, 3]) AS size), (SELECT unnest([1, 2, 3]) AS start) WHERE size < words AND start + size - 1 <= words GROUP BY 1, 2)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score
FROM b JOIN n USING (lang) LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(b.a AS HUGEINT) * 80
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) <= 2000"""


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeating(words):
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1).cast("int")
        block = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), F.slice(block, 1, n - a)), " "))

    planted = let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), repeating)
    found = periodic.periodic_runs(documents.withColumn("text", F.when(F.pmod(h, F.lit(10)) == 0, planted).otherwise(F.col("text"))))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("one", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("one.start").alias("start"), (-F.col("one.less")).alias("length"), F.col("one.period").alias("period"),
        F.expr("(-1000 * one.less) div one.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
