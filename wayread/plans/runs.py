"""Whole runs: items of documents, judged, then read as matches or as reading paths."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wayread.constants import DEFAULT_MODEL, DEFAULT_THRESHOLD, DIGEST_WINDOW, FIND_WINDOW, MIN_QUERY_LEN, WS_CHARS
from wayread.functions.text import clean_word_count
from wayread.operators import judge as J
from wayread.operators.blocks import html_blocks, layout_pieces, page_headline, passages_of_pieces
from wayread.operators.digest import reading_path, select_digest, signal_stats
from wayread.operators.find import find_matches
from wayread.operators.manifest import annotation_plan, manifest, source_info, with_text
from wayread.operators.passages import auto_question, page_opener, passages_text, passages_web
from wayread.plans.lineage import settled
from wayread.sources import store as R

Judge = str | Callable[[str], dict[str, Any]]


class Counts:
    """Different requests of one run: ``reused`` from the store, ``asked`` anew, ``done`` and ``failed`` of those.

    Counted while the run's own jobs go over the rows; ``read`` waits for them.
    """

    def __init__(self):
        self.before, self.after = Observation(), Observation()

    def read(self) -> dict[str, int]:
        return {**self.before.get, **self.after.get}


def judge(items: DataFrame, runs: DataFrame, questions: DataFrame, backend: Judge = "lexical", **options: Any) -> DataFrame:
    """Items of every run with ``p`` and, for passages, ``role, role_p, confidence``; see ``judge_with_usage``."""
    return judge_with_usage(items, runs, questions, backend, **options)[0]


def judge_with_usage(
    items: DataFrame, runs: DataFrame, questions: DataFrame, backend: Judge = "lexical",
    judgments: DataFrame | None = None, mode: str = "digest", size: int = DIGEST_WINDOW,
    concurrency: int | None = None, on_error: str = "fail", on_missing: str = "fail", store: str | None = None,
    model: str = DEFAULT_MODEL, counts: Counts | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Items of every run with ``p`` and, for passages, ``role, role_p, confidence``, and the tokens each run took.

    Questions with a ``doc_id`` are put to that document only.
    ``backend`` is ``'table'`` (recorded ``judgments``), ``'lexical'`` (built in) or a function that answers
    one request. With a ``store`` only requests without a stored answer are put to the function and the new
    answers, and failures under ``on_error='skip'``, are added to it; without one the answers are checkpointed.
    Either way no request is asked twice when results are read again or an executor is lost. ``counts`` takes
    the numbers of reused, asked, done and failed requests.
    """
    if backend == "table":
        if judgments is None:
            raise ValueError("backend 'table' needs judgments")
        return J.judge_from_table(items, runs, judgments), _no_usage(runs)
    # a question shorter than two characters runs nothing
    text = F.trim("question", F.lit(WS_CHARS))
    questions = questions.withColumn("question", text).where(F.length("question") >= MIN_QUERY_LEN)
    runs = runs.join(questions, J.question_key(questions), "left_semi")
    if backend == "lexical":
        return J.judge_lexically(items, runs, questions), _no_usage(runs)
    if not callable(backend):
        raise ValueError("backend must be 'table', 'lexical' or a function")

    windows = J.make_windows(items, size)
    keys = settled(J.run_keys(windows, runs, questions, mode, model))
    answers = _ask(windows, keys, mode, backend, store, concurrency, on_error, counts)
    parsed = J.parse_answers(keys, answers, mode, size, on_missing, spread=True)
    asked = items.join(runs.select("doc_id", "question_id"), "doc_id")
    return asked.join(parsed, ["doc_id", "question_id", "idx"], "left"), usage_of(keys, answers)


def _no_usage(runs: DataFrame) -> DataFrame:
    """Runs that no service was asked for took no tokens and have no model."""
    nothing = F.lit(0).cast("long")
    return runs.select("doc_id", "question_id", nothing.alias("input_tokens"), nothing.alias("output_tokens"), F.lit(None).cast("string").alias("model"))


def answer(
    requests: DataFrame, fn: Callable[[str], dict[str, Any]], store: str | None = None,
    concurrency: int | None = None, on_error: str = "fail", keys: DataFrame | None = None, counts: Counts | None = None,
) -> DataFrame:
    """Answers for all requests, from the store where it has them; only the prefixes of these keys are read there.

    ``keys`` can name the requests' keys where they are at hand, so that requests are rendered once only.
    """
    once = J.distinct_requests(requests)
    return _answers(once, requests if keys is None else keys, lambda new: J.call_judge(new, fn, concurrency, on_error), store, counts)


def _ask(
    windows: DataFrame, keys: DataFrame, mode: str, fn: Callable[[str], dict[str, Any]], store: str | None,
    concurrency: int | None, on_error: str, counts: Counts | None,
) -> DataFrame:
    """Answers for windows of documents whose ``keys`` are at hand.

    Copies are merged, and the store is asked, by key alone. Then the windows that are left, one for each key, get their text,
    in the one shuffle that brings their items together, and are written out where they are put to ``fn``.
    """
    place = ["doc_id", "window_no"]
    at = F.struct("doc_id", "question_id", "window_no", "question", "copies")
    once = keys.groupBy("request_key").agg(F.min(at).alias("at"))

    def call(new: DataFrame) -> DataFrame:
        new = settled(new.select("request_key", "at.*"))  # read twice, counted once
        lines = J.window_lines(windows.join(new.select(*place), place, "left_semi"), mode)
        texts = J.with_passage(lines.join(new, place))
        return J.call_judge(texts.withColumn("state", J.request_state(mode)), fn, concurrency, on_error, mode)

    return _answers(once, keys, call, store, counts)


def _answers(
    once: DataFrame, keys: DataFrame, call: Callable[[DataFrame], DataFrame], store: str | None, counts: Counts | None,
) -> DataFrame:
    """Answers of different requests: ``call`` puts those that the store does not have."""
    spark = once.sparkSession
    if store is None:
        marked = once.withColumn("stored", F.lit(False))
    else:
        prefixes = R.prefixes_of(keys)
        known = R.read_calls(spark, store, prefixes).where(F.col("outcome") == R.DONE)
        marked = once.join(known.select("request_key", F.lit(True).alias("stored")).distinct(), "request_key", "left")
        marked = marked.withColumn("stored", F.coalesce("stored", F.lit(False)))
    if counts is not None:
        marked = marked.observe(counts.before, F.count_if("stored").alias("reused"), F.count_if(~F.col("stored")).alias("asked"))
    calls = call(marked.where(~F.col("stored")))
    if counts is not None:
        answered = F.col("answers").isNotNull()
        calls = calls.observe(counts.after, F.count_if(answered).alias("done"), F.count_if(~answered).alias("failed"))
    calls = settled(calls)
    if store is None:
        return calls
    R.append_calls(calls, store)
    return R.latest_calls(R.read_calls(spark, store, prefixes))


def digest_documents(
    documents: DataFrame, runs: DataFrame, questions: DataFrame, threshold: float = DEFAULT_THRESHOLD,
    backend: Judge = "lexical", **options: Any,
) -> DataFrame:
    """Reading paths of text documents."""
    judged = judge(passages_text(documents), runs, questions, backend, **options)
    return reading_path(select_digest(judged, threshold))


def digest_pages(
    pages: DataFrame, runs: DataFrame, questions: DataFrame, threshold: float = DEFAULT_THRESHOLD,
    backend: Judge = "lexical", window_size: int | None = None, **options: Any,
) -> tuple[DataFrame, DataFrame]:
    """Reading paths and signal of web pages; runs name pages by ``doc_id``.

    Where the question of a run is blank or shorter than two characters, the page is asked its own overview question, from
    its headline or its first passage; a page with neither is not asked. ``window_size`` is that of find requests, of which
    digest windows are half.
    """
    if window_size is not None:
        options["size"] = J.clamp_digest_window(window_size)
    blocks = settled(html_blocks(pages))  # passages, openers and so questions all come from them
    passages = passages_web(blocks)
    own = auto_question(pages, page_headline(pages), page_opener(passages, blocks)).withColumnRenamed("page_id", "doc_id")
    asked = J.with_auto_question(runs.select("doc_id", "question_id"), questions, own).select("doc_id", "question_id", "question")
    judged = judge(passages.withColumnRenamed("page_id", "doc_id"), asked.drop("question"), asked, backend, **options)
    return reading_path(select_digest(judged, threshold)), signal_stats(judged, threshold)


def digest_layout(
    documents: DataFrame, layout: DataFrame, runs: DataFrame, questions: DataFrame, threshold: float = DEFAULT_THRESHOLD,
    backend: Judge = "lexical", on_empty: str = "fail", **options: Any,
) -> tuple[DataFrame, DataFrame]:
    """Manifests, with boxes, and annotation plans of laid-out documents.

    ``documents`` has ``doc_id, path, content``, ``layout`` the blocks of their pages. Pieces of blocks, passages and judgments
    are each computed once and kept; all results read those. Judgments are kept without the passages they are about: paths
    are selected from numbers and roles, and only selected items get their text. With ``on_empty='fail'`` a document without
    any passage fails the run before its passages are judged, with ``'skip'`` it has no results.
    """
    if on_empty not in ("fail", "skip"):
        raise ValueError("on_empty must be 'fail' or 'skip'")
    passages = passages_of_pieces(settled(layout_pieces(layout)))
    passages = settled(passages.withColumn("words", clean_word_count(F.col("text")).cast("long")))
    if on_empty == "fail":
        passages = settled(with_text(documents, passages))
    judged, usage = judge_with_usage(passages, runs, questions, backend, **options)
    judged = settled(judged.select("doc_id", "question_id", "idx", "words", "p", "role", "role_p", "confidence"))
    selected, signal = select_digest(judged, threshold), signal_stats(judged, threshold)
    path = reading_path(selected.join(passages.drop("words"), ["doc_id", "idx"]))
    # the content goes no further than its digest; a source goes to its runs, not their texts to the source
    n_pages = layout.groupBy("doc_id").agg(F.max("page").alias("pages"))
    source = source_info(documents, "content", F.col("path"), F.lit(0)).join(n_pages, "doc_id", "left")
    paged = F.col("source").withField("pages", F.coalesce("pages", F.lit(0)).cast("int"))
    source = signal.select("doc_id", "question_id").join(source.select("doc_id", paged.alias("source")), "doc_id")
    settings = {"threshold": threshold, "model": options.get("model", DEFAULT_MODEL), "batch_size": options.get("size", DIGEST_WINDOW)}
    return manifest(path, signal, usage, source, questions, settings), annotation_plan(path)


def find_in(
    items: DataFrame, runs: DataFrame, questions: DataFrame, threshold: float = DEFAULT_THRESHOLD,
    backend: Judge = "lexical", **options: Any,
) -> DataFrame:
    """Matches among sentences or turns, with tier and literal flag. A ``size`` outside 5 to 60 becomes the nearer of these."""
    size = J.clamp_find_window(options.pop("size", FIND_WINDOW))
    judged = judge(items, runs, questions, backend, **{"mode": "find", "size": size, **options})
    return find_matches(J.lookup_join(judged, questions.select("question_id", "question"), "question_id"), "question", threshold)


def usage_of(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Token use per run; an answer shared by copies counts for every window it answers."""
    calls = requests.select("request_key", "doc_id", "question_id", "window_no").join(
        answers.select("request_key", "input_tokens", "output_tokens", "model"), "request_key", "left"
    )
    return J.usage_totals(calls.where(F.col("model").isNotNull() | F.col("input_tokens").isNotNull()))
