"""One query per operator over the given tables. Each takes the session and a table folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayread.constants import DIGEST_WINDOW, FIND_WINDOW, HEADLINE_QUOTE_LEN, ROLE_NAMES
from wayread.functions import text as T
from wayread.functions.html import decode_entities, first_title
from wayread.functions.scoring import digest_score
from wayread.operators import blocks as B
from wayread.operators import digest as D
from wayread.operators import find as N
from wayread.operators import judge as J
from wayread.operators import labels as V
from wayread.operators import manifest as M
from wayread.operators import passages as P
from wayread.plans import runs as L
from wayread.plans.lineage import ensure_checkpoint_dir, settled
from wayread.plans.recorded import derived_runs, layout_from_lines, recorded, recorded_answers
from wayread.sources import readers as R
from wayread.sources import sinks as W
from wayread.sources import store as K
from wayread.streaming import streams as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query. Whole numbers leave as bigint, as SQL counts and ranks do."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = fn(spark, sf)
        return df.select(*[F.col(f"`{n}`").cast("long").alias(n) if t == "int" else F.col(f"`{n}`") for n, t in df.dtypes])

    QUERIES[fn.__name__] = run
    return fn


# --------------------------------------------------------------------------- shared inputs


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return R.read_documents(spark, f"{sf}/documents.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return R.read_pages(spark, f"{sf}/pages.parquet")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return R.read_questions(spark, f"{sf}/benchmark.parquet")


def runs(spark: SparkSession, sf: str, of: DataFrame, doc: str = "doc_id") -> DataFrame:
    return derived_runs(of, questions(spark, sf).count(), doc=doc)


def document_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf, spark.read.parquet(f"{sf}/documents.parquet"))


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return P.passages_text(documents(spark, sf))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of every run."""
    return passages(spark, sf).join(document_runs(spark, sf), "doc_id")


def judged(spark: SparkSession, sf: str) -> DataFrame:
    return recorded(asked(spark, sf))


def found(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of every run with judgments and the query text."""
    items = P.document_sentences(documents(spark, sf)).join(document_runs(spark, sf), "doc_id")
    return J.lookup_join(recorded(items), questions(spark, sf), "question_id")


def found_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of every run with judgments; the query is a short term that many hold, the code of the document's language."""
    items = P.document_sentences(documents(spark, sf)).join(document_runs(spark, sf), "doc_id")
    terms = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("question"))
    return recorded(items).join(terms, "doc_id")


def layout(spark: SparkSession, sf: str) -> DataFrame:
    return layout_from_lines(documents(spark, sf))


def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return B.html_blocks(pages(spark, sf))


def page_paths(spark: SparkSession, sf: str, blocks: DataFrame) -> DataFrame:
    items = P.passages_web(blocks).withColumnRenamed("page_id", "doc_id")
    page_runs = runs(spark, sf, pages(spark, sf).select("page_id"), "page_id")
    return D.select_digest(recorded(items.join(page_runs, "doc_id")))


# --------------------------------------------------------------------------- text


@query
def clean_text(spark, sf):
    return documents(spark, sf).select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query
def word_count(spark, sf):
    return documents(spark, sf).select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"))


@query
def excerpt(spark, sf):
    return documents(spark, sf).select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query
def truncate_quoted(spark, sf):
    return documents(spark, sf).select("doc_id", T.truncate_quoted(F.col("text"), HEADLINE_QUOTE_LEN).alias("quoted"))


@query
def clean_headline(spark, sf):
    title = decode_entities(first_title(F.col("html")))
    return pages(spark, sf).select("page_id", T.clean_headline(title).alias("title"))


@query
def rfind(spark, sf):
    return documents(spark, sf).select("doc_id", T.rfind(F.col("text"), 960).cast("long").alias("at"))


@query
def split_long_text(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(T.split_long(F.col("text"))).alias("piece_no", "piece"))


@query
def split_sentences(spark, sf):
    spans = documents(spark, sf).select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("n", "span"))
    return spans.select("doc_id", "n", "span.s", "span.e")


@query
def sentences(spark, sf):
    return P.document_sentences(documents(spark, sf))


@query
def trim_spans(spark, sf):
    """The span of a document's first 400 characters without white space around it."""
    span = T.trim_span(F.col("text"), F.lit(0), F.least(F.length("text"), F.lit(400)))
    return documents(spark, sf).select("doc_id", span.alias("span")).select("doc_id", "span.s", "span.e")


@query
def text_passages(spark, sf):
    return passages(spark, sf).select("doc_id", "idx", "text")


# --------------------------------------------------------------------------- web pages


@query
def html_blocks(spark, sf):
    return page_blocks(spark, sf).select("page_id", "block_pos", "tag", "text")


@query
def web_headings(spark, sf):
    return P.attach_heading_web(page_blocks(spark, sf)).select("page_id", "block_pos", "tag", "heading")


@query
def web_passages(spark, sf):
    return P.passages_web(page_blocks(spark, sf)).select("page_id", "idx", "text", "heading", "s", "e")


@query
def page_sentences(spark, sf):
    return P.sentences(page_blocks(spark, sf)).select("page_id", "idx", "text", "s", "e")


@query
def page_headline(spark, sf):
    return B.page_headline(pages(spark, sf))


@query
def page_opener(spark, sf):
    blocks = page_blocks(spark, sf)
    return P.page_opener(P.passages_web(blocks), blocks)


@query
def auto_question(spark, sf):
    blocks = page_blocks(spark, sf)
    openers = P.page_opener(P.passages_web(blocks), blocks)
    return P.auto_question(pages(spark, sf), B.page_headline(pages(spark, sf)), openers)


@query
def background_blocks(spark, sf):
    blocks = page_blocks(spark, sf)
    selected = page_paths(spark, sf, blocks).withColumnRenamed("doc_id", "page_id")
    return D.background_blocks(blocks, selected).select("page_id", "question_id", "block_pos", "tag")


@query
def background_containment(spark, sf):
    blocks = page_blocks(spark, sf)
    selected = page_paths(spark, sf, blocks).withColumnRenamed("doc_id", "page_id")
    found = D.background_around(blocks, B.html_extents(pages(spark, sf)), selected)
    return found.select("page_id", "question_id", "block_pos", "tag")


@query
def web_reading_path(spark, sf):
    path = page_paths(spark, sf, page_blocks(spark, sf))
    return path.select("doc_id", "question_id", "ord", "idx", "role", "label", "heading", "text", "is_catch")


# --------------------------------------------------------------------------- layout


@query
def layout_reading_order(spark, sf):
    return B.reading_order(B.layout_texts(layout(spark, sf))).select("doc_id", "page", "number", "reading_no")


@query
def layout_bands(spark, sf):
    return B.layout_texts(layout(spark, sf)).select("doc_id", "page", "number", "band", "text")


@query
def repeated_lines(spark, sf):
    return B.repeated_texts(B.layout_texts(layout(spark, sf)))


@query
def running_headers(spark, sf):
    return B.repeated_blocks(B.layout_texts(layout(spark, sf)))


@query
def layout_headings(spark, sf):
    return B.attach_heading_layout(B.layout_texts(layout(spark, sf))).select("doc_id", "page", "number", "heading")


@query
def layout_passages(spark, sf):
    return B.passages_layout(layout(spark, sf)).select(
        "doc_id", "idx", "page", "heading", "text", F.to_json("quads").alias("quads")
    )


@query
def stored_layout(spark, sf):
    """Passages of a layout table that was written and is read with its schema."""
    folder = work_folder(spark)
    layout(spark, sf).write.parquet(f"{folder}/layout")
    return B.passages_layout(R.read_layout_blocks(spark, f"{folder}/layout")).select("doc_id", "idx", "page", "heading", "text")


# --------------------------------------------------------------------------- requests and answers


@query
def request_windows(spark, sf):
    windows = J.make_windows(asked(spark, sf))
    return windows.groupBy("doc_id", "question_id", "window_no").agg(
        F.count("*").alias("n_items"), F.min("idx").alias("first_idx"), F.max("pos").alias("last_pos")
    )


@query
def find_requests(spark, sf):
    items = P.document_sentences(documents(spark, sf)).join(document_runs(spark, sf), "doc_id")
    requests = J.find_requests(J.make_windows(items, FIND_WINDOW), questions(spark, sf))
    return requests.select("doc_id", "question_id", "window_no", "n_items", "request_key", "request")


def requests_of(spark: SparkSession, sf: str) -> DataFrame:
    return J.digest_requests(J.make_windows(asked(spark, sf)), questions(spark, sf))


@query
def digest_requests(spark, sf):
    return requests_of(spark, sf).select("doc_id", "question_id", "window_no", "n_items", "request_key", "request")


@query
def parse_answers(spark, sf):
    requests = requests_of(spark, sf)
    answers = recorded_answers(requests, judged(spark, sf), DIGEST_WINDOW)
    return J.parse_answers(requests, answers)


@query
def missing_answers(spark, sf):
    """The judge answered only the first question put to each document, and left out its last role answer."""
    requests = requests_of(spark, sf)
    items = judged(spark, sf)
    kept = items.where(F.col("turn") == 0)
    answers = recorded_answers(requests.join(kept.select("doc_id", "question_id").distinct(), ["doc_id", "question_id"], "left_semi"), kept, DIGEST_WINDOW)
    return J.missing_answers(requests, answers).select("doc_id", "question_id", "window_no", "missing_id")


@query
def judgment_reuse(spark, sf):
    """A second run asks every question; the store has the answers to the first question of each document."""
    requests = requests_of(spark, sf).join(document_runs(spark, sf), ["doc_id", "question_id"])
    store = requests.where(F.col("turn") == 0).select("request_key").distinct()
    fresh = J.new_requests(requests, store).select("request_key", "copies", F.lit("new").alias("status"))
    reused = (
        requests.join(store, "request_key", "left_semi").groupBy("request_key").agg(F.count("*").alias("copies"))
        .withColumn("status", F.lit("stored"))
    )
    return reused.unionByName(fresh)


@query
def usage_totals(spark, sf):
    requests = requests_of(spark, sf)
    return L.usage_of(requests, recorded_answers(requests, judged(spark, sf), DIGEST_WINDOW))


@query
def run_progress(spark, sf):
    requests = requests_of(spark, sf)
    answers = recorded_answers(requests, judged(spark, sf).where(F.col("turn") == 0), DIGEST_WINDOW)
    return J.run_progress(requests, answers)


@query
def valid_runs(spark, sf):
    return J.valid_runs(document_runs(spark, sf).drop("turn"), questions(spark, sf))


@query
def questions_or_auto(spark, sf):
    """Runs on pages; a question that starts with a vowel counts as left blank."""
    blocks = page_blocks(spark, sf)
    auto = P.auto_question(
        pages(spark, sf), B.page_headline(pages(spark, sf)), P.page_opener(P.passages_web(blocks), blocks)
    ).withColumnRenamed("page_id", "doc_id")
    blank = questions(spark, sf).withColumn("question", F.when(F.col("question").rlike("^[AEIOU]"), " ").otherwise(F.col("question")))
    page_runs = runs(spark, sf, pages(spark, sf).select("page_id"), "page_id").drop("turn")
    return J.with_auto_question(page_runs, blank, auto)


@query
def lexical_judge(spark, sf):
    scored = J.judge_lexically(passages(spark, sf), document_runs(spark, sf), questions(spark, sf))
    return scored.select("doc_id", "question_id", "idx", "p", "role", "role_p")


def by_length(fails: Callable[[str], bool] = lambda passages: False, asked: bool = False) -> Callable[[str], dict]:
    """A user function as judge, one call per window; it goes by the length of each passage, and of the question if ``asked``."""
    roles = list(ROLE_NAMES)

    def judge(request: str) -> dict:
        answers, state = {}, json.loads(request)["state"]
        passages, more = state["passages"], len(state["question"]) if asked else 0
        if fails(passages):
            raise ValueError("no reply")
        for line in passages.split("\n"):
            name, text = line.split("| ", 1)
            n, role = len(text) + more, roles[(len(text) + more) % 7]
            answers[f"{name}_needed"] = {"type": "noul", "noul": n % 101 / 100}
            answers[f"{name}_role"] = {"type": "choice", "choice": role, "confidence": 0.5, "probabilities": {role: n % 11 / 10}}
        return {"answers": answers, "input_tokens": len(request), "output_tokens": 1, "model": "by_length"}

    return judge


@query
def function_judge(spark, sf):
    items = L.judge(passages(spark, sf), document_runs(spark, sf), questions(spark, sf), by_length())
    return items.select("doc_id", "question_id", "idx", "p", "role", "role_p", "confidence")


@query
def run_auto_digest(spark, sf):
    """Whole runs on pages; a question that starts with a vowel counts as left blank, so the page asks its own."""
    blank = questions(spark, sf).withColumn("question", F.when(F.col("question").rlike("^[AEIOU]"), " ").otherwise(F.col("question")))
    page_runs = runs(spark, sf, pages(spark, sf).select("page_id"), "page_id")
    path, _ = L.digest_pages(pages(spark, sf), page_runs, blank, backend=by_length(asked=True), window_size=24)
    return path.select("doc_id", "question_id", "ord", "idx", "label", "p", "role_p", "text")


@query
def run_layout_manifest(spark, sf):
    """Whole runs on laid-out documents: every passage of every manifest, with its boxes."""
    docs = documents(spark, sf).select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    manifests, _ = L.digest_layout(docs, layout(spark, sf), document_runs(spark, sf), questions(spark, sf), backend=by_length(), on_empty="skip")
    m = F.col("manifest")
    each = manifests.select("doc_id", "question_id", m["question"].alias("question"), m["source"]["pages"].alias("pages"), m["source"]["sha256"].alias("sha256"), m["model"].alias("model"),
                            m["usage"]["output_tokens"].alias("output_tokens"), m["signal"]["judged_words"].alias("judged_words"), F.inline(m["passages"]))
    return each.select("doc_id", "question_id", "question", "pages", "sha256", "model", "output_tokens", "judged_words", F.col("order").alias("ord"), "page", "role",
                       "heading", "text", F.to_json(F.transform("quads", lambda q: q["quad"])).alias("quads"), F.to_json(F.transform("quads", lambda q: q["rect"])).alias("rects"))


@query
def store_second_run(spark, sf):
    """Requests reused and asked by three runs over one store: the first questions, all questions, all again."""
    store, rows, runs_ = f"{work_folder(spark)}/store", [], document_runs(spark, sf)
    for run, part in enumerate([runs_.where(F.col("turn") == 0), runs_, runs_], 1):
        counts = L.Counts()
        L.judge(passages(spark, sf), part, questions(spark, sf), by_length(), store=store, counts=counts)
        if run == 2:
            K.compact(spark, store)
        n = counts.read()
        rows.append((run, n["reused"], n["asked"], n["done"], K.read_calls(spark, store).count()))
    return spark.createDataFrame(rows, "run long, reused long, asked long, done long, stored long")


@query
def stored_and_fresh_answers(spark, sf):
    """Judgments of a run of which the first questions are answered from the store and the others anew."""
    store, every = f"{work_folder(spark)}/store", document_runs(spark, sf)
    for part in (every.where(F.col("turn") == 0), every):
        items = L.judge(passages(spark, sf), part, questions(spark, sf), by_length(), store=store)
    return items.select("doc_id", "question_id", "idx", "p", "role", "role_p", "confidence")


def half_answered(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """A store after a run in which windows of lengths that 5 divides got no reply, and that run's windows."""
    store = f"{work_folder(spark)}/store"
    L.judge(passages(spark, sf), document_runs(spark, sf), questions(spark, sf), by_length(lambda p: len(p) % 5 == 0), store=store, on_error="skip")
    return store, settled(requests_of(spark, sf).select("doc_id", "question_id", "window_no", "request_key"))


@query
def failed_windows(spark, sf):
    store, keys = half_answered(spark, sf)
    return K.failed_windows(keys, store).select("doc_id", "question_id", "window_no", "error", "failures")


@query
def retried_windows(spark, sf):
    """Windows of the run before that failed, as a second run over the store leaves them; that run asks nothing else."""
    store, keys = half_answered(spark, sf)
    counts = L.Counts()
    L.judge(passages(spark, sf), document_runs(spark, sf), questions(spark, sf), by_length(), store=store, counts=counts)
    calls = K.read_calls(spark, store).groupBy("request_key").agg(
        F.count_if(F.col("outcome") == K.FAILED).alias("failures"), F.count_if(F.col("outcome") == K.DONE).alias("replies")
    )
    tried = keys.join(calls.where(F.col("failures") > 0), "request_key")
    still = K.failed_windows(keys, store).groupBy().agg(F.count("*")).scalar()
    return tried.select(
        "doc_id", "question_id", "window_no", "failures", "replies", F.lit(counts.read()["asked"]).cast("long").alias("asked"), still.alias("still_failed")
    )


# --------------------------------------------------------------------------- digest


@query
def judge_from_table(spark, sf):
    recordings = judged(spark, sf).where(F.col("turn") == 0).select("doc_id", "question_id", "idx", "p", "role", "role_p")
    items = J.judge_from_table(passages(spark, sf), document_runs(spark, sf), recordings)
    return items.select("doc_id", "question_id", "idx", "p", "role", "role_p")


@query
def scores(spark, sf):
    return judged(spark, sf).select(
        "doc_id", "question_id", "idx", digest_score(F.col("p"), F.col("role"), F.col("role_p")).alias("score")
    )


@query
def select_digest(spark, sf):
    return D.select_digest(judged(spark, sf)).select("doc_id", "question_id", "ord", "idx", "role", "p", "score")


@query
def mark_catch(spark, sf):
    return D.select_digest(judged(spark, sf)).select("doc_id", "question_id", "ord", "is_catch", "label")


@query
def reading_path(spark, sf):
    return D.reading_path(D.select_digest(judged(spark, sf)))


@query
def signal_stats(spark, sf):
    return D.signal_stats(judged(spark, sf))


@query
def digest_summary(spark, sf):
    items = judged(spark, sf)
    summary = D.digest_summary(D.select_digest(items), D.signal_stats(items))
    return summary.withColumn("labels", F.array_join("labels", " · "))


@query
def threshold_sweep(spark, sf):
    return D.threshold_sweep(judged(spark, sf))


@query
def signal_leaderboard(spark, sf):
    return D.signal_leaderboard(D.signal_stats(judged(spark, sf)), 5).select(
        "question_id", "place", "doc_id", "signal_words", "signal_ratio"
    )


@query
def path_lines(spark, sf):
    return M.path_lines(D.reading_path(D.select_digest(judged(spark, sf))))


@query
def signal_lines(spark, sf):
    return M.signal_lines(D.signal_stats(judged(spark, sf)))


# --------------------------------------------------------------------------- find


@query
def find_matches(spark, sf):
    return N.find_matches(found(spark, sf)).select("doc_id", "question_id", "idx", "text", "p", "tier", "is_literal")


@query
def find_summary(spark, sf):
    return N.find_summary(found(spark, sf))


@query
def find_turns(spark, sf):
    """Finding in conversations: one item per turn."""
    turns = R.read_turns(spark, f"{sf}/conversations.parquet")
    turn_runs = runs(spark, sf, turns.select("doc_id").distinct())
    items = recorded(turns.join(turn_runs, "doc_id"))
    return N.find_summary(J.lookup_join(items, questions(spark, sf), "question_id"))


@query
def literal_matches(spark, sf):
    flagged = N.flag_literal(found_terms(spark, sf))
    return flagged.where("is_literal").select("doc_id", "question_id", "idx")


@query
def semantic_only(spark, sf):
    return N.semantic_only(N.find_matches(found_terms(spark, sf))).select("doc_id", "question_id", "idx")


@query
def literal_and_semantic(spark, sf):
    return N.literal_and_semantic(N.find_matches(found_terms(spark, sf))).select("doc_id", "question_id", "idx")


@query
def find_sweep(spark, sf):
    return N.find_sweep(found(spark, sf))


@query
def find_sweep_counts(spark, sf):
    return N.find_sweep(found_terms(spark, sf), query_col="question")


@query
def top_matches(spark, sf):
    return N.top_matches(N.find_matches(found(spark, sf)), 50).select("doc_id", "question_id", "idx", "p", "text")


@query
def match_navigation(spark, sf):
    hits = N.find_matches(found(spark, sf)).select("doc_id", "question_id", "idx")
    return N.match_navigation(hits)


# --------------------------------------------------------------------------- labels


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """A quality label is the verdict on every passage of a document, for both of its questions."""
    return spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("correct")).join(
        judged(spark, sf).select("doc_id", "question_id", "turn", "idx"), "doc_id"
    ).select((F.col("doc_id") * 1000 + F.col("turn")).alias("ts"), "doc_id", "question_id", "idx", "correct")


def records(spark: SparkSession, sf: str) -> DataFrame:
    # verdicts are on documents of the label table only, so no others are cut into passages
    labelled = documents(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id"), "doc_id", "left_semi")
    items = recorded(P.passages_text(labelled).join(document_runs(spark, sf), "doc_id"))
    items = J.lookup_join(items, questions(spark, sf), "question_id")
    items = items.withColumn("url", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    return V.label_record(items, verdicts(spark, sf), "digest")


@query
def label_records(spark, sf):
    return records(spark, sf)


@query
def label_counts(spark, sf):
    return V.label_counts(records(spark, sf), ["mode", "role"])


@query
def label_calibration(spark, sf):
    return V.label_calibration(records(spark, sf))


@query
def label_calibration_cube(spark, sf):
    return V.label_calibration_cube(records(spark, sf))


@query
def label_isotonic(spark, sf):
    return V.label_isotonic(records(spark, sf))


@query
def label_thresholds(spark, sf):
    return V.label_thresholds(records(spark, sf))


@query
def exported_labels(spark, sf):
    """Verdicts appended to a table in two parts, read from it and exported."""
    folder, every = work_folder(spark), settled(records(spark, sf))
    for part in (0, 1):
        W.append_labels(every.where(F.col("ts") % 2 == part), f"{folder}/labels")
    W.export_labels(R.read_labels(spark, f"{folder}/labels"), f"{folder}/export")
    return spark.read.schema(V.LABEL_SCHEMA).json(f"{folder}/export")


# --------------------------------------------------------------------------- nested results


@query
def source_info(spark, sf):
    info = M.source_info(documents(spark, sf), "text", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), F.lit(1))
    return info.select("doc_id", "source.path", "source.sha256", "source.pages")


@query
def page_counts(spark, sf):
    return M.page_counts(B.passages_layout(layout(spark, sf)))


@query
def documents_without_text(spark, sf):
    return M.documents_without_text(documents(spark, sf), passages(spark, sf))


@query
def manifest_flat(spark, sf):
    items = judged(spark, sf)
    requests = requests_of(spark, sf)
    usage = L.usage_of(requests, recorded_answers(requests, items, DIGEST_WINDOW))
    docs = documents(spark, sf)
    source = M.source_info(docs, "text", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), F.lit(1))
    manifests = M.manifest(
        D.reading_path(D.select_digest(items)), D.signal_stats(items), usage, source, questions(spark, sf),
        {"threshold": 0.45, "model": "recorded", "batch_size": DIGEST_WINDOW},
    )
    m = F.col("manifest")
    return manifests.select(
        "doc_id", "question_id", m["manifest_version"].alias("manifest_version"), m["source"]["sha256"].alias("sha256"),
        m["question"].alias("question"), m["config"]["threshold"].alias("threshold"), m["model"].alias("model"),
        m["usage"]["input_tokens"].alias("input_tokens"), m["signal"]["signal_ratio"].alias("signal_ratio"),
        F.inline(m["passages"]),
    ).drop("quads")


@query
def manifest_json(spark, sf):
    """The manifest as the sink writes it."""
    items = judged(spark, sf)
    usage = J.usage_totals(
        J.make_windows(items).groupBy("doc_id", "question_id", "window_no").agg(F.count("*").alias("n")).select(
            "doc_id", "question_id", "window_no", (F.col("n") * 100).alias("input_tokens"),
            (F.col("n") * 10).alias("output_tokens"), F.lit("recorded").alias("model"),
        )
    )
    source = M.source_info(documents(spark, sf), "text", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), F.lit(1))
    manifests = M.manifest(
        D.reading_path(D.select_digest(items)), D.signal_stats(items), usage, source, questions(spark, sf),
        {"model": "recorded", "batch_size": DIGEST_WINDOW},
    )
    m = F.col("manifest")
    slim = F.struct(
        m["manifest_version"].alias("manifest_version"), m["source"].alias("source"), m["config"].alias("config"),
        m["usage"].alias("usage"),
        F.transform(m["passages"], lambda p: F.struct(p["order"].alias("order"), p["role"].alias("role"), p["heading"].alias("heading"), p["text"].alias("text"))).alias("passages"),
    )
    return manifests.select("doc_id", "question_id", F.to_json(slim, {"ignoreNullFields": "false"}).alias("manifest"))


@query
def annotation_plan(spark, sf):
    items = B.passages_layout(layout(spark, sf)).join(document_runs(spark, sf), "doc_id")
    plan = M.annotation_plan(D.reading_path(D.select_digest(recorded(items))))
    return plan.select(
        "doc_id", "question_id", "page", "ord", "title", "content", F.to_json("quads").alias("quads")
    )


# --------------------------------------------------------------------------- runs over time


@query
def latest_answers_only(spark, sf):
    """Every first question was asked twice; the second run drops passages with odd numbers of words."""
    first = judged(spark, sf).withColumn("run_id", F.lit(1))
    again = first.where((F.col("turn") == 0) & (T.word_count(F.col("text")) % 2 == 0)).withColumn("run_id", F.lit(2))
    rows = S.latest_runs(first.unionByName(again))
    return rows.select("doc_id", "question_id", "idx", "run_id")


def work_folder(spark: SparkSession) -> str:
    """A new folder in the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


def drain(writer, folder: str) -> None:
    stream = writer.option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    stream.awaitTermination()


@query
def streamed_labels(spark, sf):
    """Verdict counts of a label table that is read as a stream."""
    folder = work_folder(spark)
    records(spark, sf).write.parquet(f"{folder}/labels")
    counts = S.stream_labels(spark, f"{folder}/labels", ("mode", "role")).writeStream.outputMode("complete")
    drain(counts.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/counts")), folder)
    return spark.read.parquet(f"{folder}/counts")


@query
def streamed_paths(spark, sf):
    """Reading paths kept up to date while judgments arrive: first the first questions, then the others."""
    folder = work_folder(spark)
    rows = judged(spark, sf)
    for turn in (0, 1):
        part = rows.where(F.col("turn") == turn).select(
            "doc_id", "question_id", "idx", "page", "heading", "text", "p", "role", "role_p", "confidence",
            F.lit(1).cast("long").alias("run_id"),
        )
        part.write.mode("append").parquet(f"{folder}/judged")
        drain(S.stream_judgments(spark, f"{folder}/judged", f"{folder}/out"), folder)
    return S.current(spark, f"{folder}/out", "paths").select("doc_id", "question_id", "ord", "idx", "label", "score")


@query
def streamed_passages(spark, sf):
    """Pages cut into passages as they arrive."""
    folder = work_folder(spark)
    pages(spark, sf).write.parquet(f"{folder}/pages")
    drain(S.stream_documents(spark, f"{folder}/pages", f"{folder}/passages"), folder)
    return S.current_passages(spark, f"{folder}/passages").select("page_id", "idx", "text", "heading")


@query
def streamed_dirty_paths(spark, sf):
    """Judgments that arrive with NaN, with roles nobody knows, and with the first window of every run twice."""
    folder, i = work_folder(spark), F.col("idx")
    rows = judged(spark, sf).select(
        "doc_id", "question_id", "idx", "page", "heading", "text", F.when(i % 7 == 3, F.lit(float("nan"))).otherwise(F.col("p")).alias("p"),
        F.when(i % 5 == 4, "mystery").otherwise(F.col("role")).alias("role"), "role_p", "confidence", F.lit(1).cast("long").alias("run_id"),
    )
    copies = F.explode(F.when(i < DIGEST_WINDOW, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    for part in (rows.withColumn("copy", copies).drop("copy"), rows.where(i < DIGEST_WINDOW)):
        part.write.mode("append").option("compression", "zstd").parquet(f"{folder}/judged")
        drain(S.stream_judgments(spark, f"{folder}/judged", f"{folder}/out"), folder)
    return S.current(spark, f"{folder}/out", "paths").select("doc_id", "question_id", "ord", "idx", "label", "score")


@query
def streamed_pages_resent(spark, sf):
    """Pages judged as they arrive. Odd ones come twice at once, even ones cut in half and then whole; those that 10 divides end empty."""
    folder, p, whole = work_folder(spark), F.col("page_id"), pages(spark, sf)
    half = F.substring(F.col("html"), F.lit(1), F.floor(F.length("html") / 2).cast("int"))
    first = whole.withColumn("html", F.when(p % 2 == 0, half).otherwise(F.col("html"))).unionByName(whole.where(p % 2 == 1))
    again = whole.where(p % 2 == 0).withColumn("html", F.when(p % 10 == 0, "").otherwise(F.col("html")))
    page_runs = runs(spark, sf, whole.select("page_id"), "page_id")
    for part in (first, again):
        part.write.mode("append").parquet(f"{folder}/pages")
        drain(S.stream_digests(spark, f"{folder}/pages", f"{folder}/out", lambda items: recorded(items.join(page_runs, "doc_id"))), folder)
    return S.current_digests(spark, f"{folder}/out", "paths").select("doc_id", "question_id", "ord", "idx", "label", "text")
