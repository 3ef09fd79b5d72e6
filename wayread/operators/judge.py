"""Judging: windows, requests, answers, stored judgments and the three judges.

A *run* is one question put to one document: a row of ``runs(doc_id, question_id)``. Runs are joined on
their ids; documents and questions are never multiplied out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayread.constants import (
    DEFAULT_MODEL,
    DIGEST_WINDOW,
    DIGEST_WINDOW_RANGE,
    FIND_QUESTION,
    FIND_WINDOW_RANGE,
    IRRELEVANT,
    LEXICAL_CUES,
    LEXICAL_DIRECT,
    MIN_QUERY_LEN,
    NEEDED_QUESTION,
    ROLE_QUESTION,
    WS_CHARS,
)
from wayread.functions.arrays import let
from wayread.functions.scoring import as_float, known_role
from wayread.functions.text import item_id
from wayread.operators.joins import hot_key_join, lookup_join
from wayread.sources.store import CALL_SCHEMA

ANSWERS_TYPE = (
    "map<string, struct<type: string, noul: string, choice: string, confidence: string,"
    " probabilities: map<string, string>>>"
)
#: Replies that are handed on at once.
REPLIES = 64
#: Sizes of requests whose questions a task keeps written out.
REQUEST_SIZES = 64


# --------------------------------------------------------------------------- runs and windows


def valid_runs(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """Runs with their question text; a question shorter than two characters runs nothing."""
    asked = questions.withColumn("question", F.trim("question", F.lit(WS_CHARS))).where(F.length("question") >= MIN_QUERY_LEN)
    return lookup_join(runs, asked, "question_id")


def with_auto_question(runs: DataFrame, questions: DataFrame, auto: DataFrame) -> DataFrame:
    """Runs with their question text; a blank question is replaced by the document's own overview question."""
    text = F.trim("question", F.lit(WS_CHARS))
    asked = lookup_join(runs, questions.withColumn("question", text), "question_id", how="left")
    own = auto.select("doc_id", F.col("question").alias("own"))
    too_short = F.coalesce(F.length("question"), F.lit(0)) < MIN_QUERY_LEN
    return (
        asked.join(own, "doc_id", "left")
        .withColumns({"question": F.when(too_short, F.col("own")).otherwise(F.col("question")), "is_auto": too_short})
        .drop("own")
        .where(F.length("question") >= MIN_QUERY_LEN)
    )


def question_key(questions: DataFrame) -> list[str]:
    """Columns that name a question: questions of single documents have their ``doc_id``, too."""
    return ["doc_id", "question_id"] if "doc_id" in questions.columns else ["question_id"]


def _with_questions(facts: DataFrame, questions: DataFrame, how: str = "inner") -> DataFrame:
    key = question_key(questions)
    return lookup_join(facts, questions, "question_id", how) if len(key) == 1 else facts.join(questions, key, how)


def make_windows(items: DataFrame, size: int = DIGEST_WINDOW) -> DataFrame:
    """Consecutive slices of a document's items: adds ``window_no`` and ``pos``."""
    if size < 1:
        raise ValueError("window size must be positive")
    return items.withColumns(
        {"window_no": F.floor(F.col("idx") / F.lit(size)).cast("int"), "pos": (F.col("idx") % size).cast("int")}
    )


def clamp_find_window(size: int) -> int:
    low, high = FIND_WINDOW_RANGE
    return max(low, min(high, size))


def clamp_digest_window(size: int) -> int:
    """Digest windows are half as large as find windows."""
    low, high = DIGEST_WINDOW_RANGE
    return max(low, min(high, size // 2))


# --------------------------------------------------------------------------- requests


def request_key(mode: str, question: Column, model: Column, content: Column) -> Column:
    """Content key of a request: the same question over the same window for the same model."""
    return F.sha2(F.concat_ws("\u0001", model, F.lit(mode), question, content), 256)


def passage_line(pos: Column, heading: Column, text: Column) -> Column:
    under = F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit(" [under heading: "), heading, F.lit("]")))
    return F.concat(item_id("P", pos), F.lit("|"), F.coalesce(under, F.lit("")), F.lit(" "), text)


#: Of each mode the prefix of its items' names, the questions put to each item, and the names of question and text.
MODES = {
    "find": ("S", {"": FIND_QUESTION}, ("query", "passage")),
    "digest": ("P", {"_needed": NEEDED_QUESTION, "_role": ROLE_QUESTION}, ("question", "passages")),
}


def _template(question: dict) -> str:
    return json.dumps(question, separators=(",", ":"), ensure_ascii=False)


def _questions_json(n: Column, mode: str) -> Column:
    prefix, asked, _ = MODES[mode]

    def one(pos: Column) -> Column:
        name = item_id(prefix, pos)
        parts = [
            F.concat(F.lit('"'), name, F.lit(f'{suffix}":'), F.replace(F.lit(_template(q)), F.lit("{id}"), name))
            for suffix, q in asked.items()
        ]
        return F.concat_ws(",", *parts)

    body = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), one), ",")
    return F.concat(F.lit("{"), body, F.lit("}"))


def _lines(windows: DataFrame, mode: str, *place: str) -> DataFrame:
    """Lines of every window in order: ``*place, n_items, lines``."""
    if mode == "find":
        line = F.concat(item_id("S", F.col("pos")), F.lit("| "), F.col("text"))
    else:
        line = passage_line(F.col("pos"), F.col("heading"), F.col("text"))
    lines = F.sort_array(F.collect_list(F.struct("pos", line.alias("line"))))
    return windows.groupBy(*place).agg(
        F.count("*").cast("int").alias("n_items"), F.transform(lines, lambda x: x["line"]).alias("lines")
    )


def window_lines(windows: DataFrame, mode: str = "digest") -> DataFrame:
    """Lines of every window of a document, alike for all its runs: ``doc_id, window_no, n_items, lines``."""
    return _lines(windows, mode, "doc_id", "window_no")


def with_passage(lines: DataFrame) -> DataFrame:
    """Windows of runs with their ``passage`` in place of ``lines``; a run that is listed ``copies`` times has each line as often."""
    repeated = F.flatten(F.transform("lines", lambda x: F.array_repeat(x, F.col("copies").cast("int"))))
    passage = F.array_join(F.when(F.col("copies") == 1, F.col("lines")).otherwise(repeated), "\n")
    return lines.withColumns({"passage": passage, "n_items": (F.col("n_items") * F.col("copies")).cast("int")}).drop("lines")


def window_passages(windows: DataFrame, mode: str = "digest") -> DataFrame:
    """Text of every window: ``doc_id, question_id, window_no, n_items, passage``."""
    place = ["doc_id", "question_id", "window_no"]
    return _lines(windows, mode, *place).select(*place, "n_items", F.array_join("lines", "\n").alias("passage"))


def run_keys(
    windows: DataFrame, runs: DataFrame, questions: DataFrame, mode: str = "digest", model: str = DEFAULT_MODEL
) -> DataFrame:
    """Key and place of the request of every window of every run, without its passage.

    ``windows`` are those of documents. Their lines are put together where a document's rows meet its runs, once for all
    of these, so that its text is shuffled once however many questions it is asked.
    """
    asked = _with_questions(runs.groupBy("doc_id", "question_id").agg(F.count("*").alias("copies")), questions)
    lines = window_lines(windows.repartition("doc_id"), mode)
    own = asked.select("doc_id", "question_id", "question", "copies")
    return with_passage(lines.join(own, "doc_id")).select(
        request_key(mode, F.col("question"), F.lit(model), F.col("passage")).alias("request_key"),
        "doc_id", "question_id", "window_no", "n_items", "question", "copies",
    )


def window_requests(windows: DataFrame, questions: DataFrame, mode: str = "digest", model: str = DEFAULT_MODEL) -> DataFrame:
    """One request per window with its key, question and passage, not yet written out."""
    return _with_questions(window_passages(windows, mode), questions).select(
        request_key(mode, F.col("question"), F.lit(model), F.col("passage")).alias("request_key"),
        "doc_id", "question_id", "window_no", "n_items", "question", "passage",
    )


def request_state(mode: str = "digest") -> Column:
    """What a request says of its window, as JSON; the questions that follow are alike in all requests of so many items."""
    names = MODES[mode][2]
    return F.to_json(F.struct(F.col("question").alias(names[0]), F.col("passage").alias(names[1])))


def _requests(windows: DataFrame, questions: DataFrame, mode: str, model: str) -> DataFrame:
    return window_requests(windows, questions, mode, model).withColumn(
        "request",
        F.concat(
            F.lit('{"state":'), request_state(mode), F.lit(',"questions":'), _questions_json(F.col("n_items"), mode), F.lit("}"),
        ),
    )


def find_requests(windows: DataFrame, questions: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """One request per window of sentences, with a yes/no question for every sentence."""
    return _requests(windows, questions, "find", model)


def digest_requests(windows: DataFrame, questions: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """One request per window of passages, with a yes/no and a role question for every passage."""
    return _requests(windows, questions, "digest", model)


# --------------------------------------------------------------------------- answers


def _expected_ids(mode: str) -> Column:
    def names(pos: Column) -> Column:
        if mode == "find":
            return F.array(item_id("S", pos))
        return F.array(F.concat(item_id("P", pos), F.lit("_needed")), F.concat(item_id("P", pos), F.lit("_role")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.col("n_items") - 1), names))


def with_answers(requests: DataFrame, answers: DataFrame, spread: bool = False) -> DataFrame:
    """Requests with the parsed answers of their key; ``parsed`` is null where the request has none.

    Copies of one text share a key, so a key may own a large share of the requests. Spark splits such a
    partition while the join runs; with ``spread``, for stored requests, keys that own much are spread beforehand.
    """
    error = F.col("error") if "error" in answers.columns else F.lit(None).cast("string")
    parsed = answers.select("request_key", F.from_json("answers", ANSWERS_TYPE).alias("parsed"), error.alias("error"))
    if not spread:
        return requests.join(parsed, "request_key", "left")
    return hot_key_join(requests, parsed, "request_key", "left")


def missing_answers(requests: DataFrame, answers: DataFrame, mode: str = "digest") -> DataFrame:
    """Every question id that has no answer, request by request."""
    keys = F.coalesce(F.map_keys("parsed"), F.array().cast("array<string>"))
    return with_answers(requests, answers).select(
        "request_key", "doc_id", "question_id", "window_no",
        F.explode(F.array_except(_expected_ids(mode), keys)).alias("missing_id"),
    )


def parse_answers(
    requests: DataFrame, answers: DataFrame, mode: str = "digest", size: int = DIGEST_WINDOW,
    on_missing: str = "fail", spread: bool = False,
) -> DataFrame:
    """One judgment per item: ``doc_id, question_id, idx, p, role, role_p, confidence``.

    ``on_missing='fail'`` fails the job at the first question without an answer; ``'default'`` reads a missing
    answer as not relevant. A call with a recorded error (see ``on_error='skip'``) leaves its items unjudged; with
    ``'fail'`` any other request whose reply is absent or unreadable fails the job.
    """
    if on_missing not in ("fail", "default"):
        raise ValueError("on_missing must be 'fail' or 'default'")
    known, read = with_answers(requests, answers, spread), F.col("parsed").isNotNull()
    if on_missing == "default":
        known = known.where(read)
    else:
        lost = F.raise_error(F.concat(F.lit("reply absent or unreadable: "), F.col("request_key"))).cast("boolean")
        known = known.where(F.when(read, True).when(F.col("error").isNotNull(), False).otherwise(lost))
        absent = F.array_except(_expected_ids(mode), F.map_keys("parsed"))
        checked = F.when(
            F.size(absent) > 0, F.raise_error(F.concat(F.lit("answers missing: "), absent[0])).cast("int")
        ).otherwise(F.col("n_items"))
        known = known.withColumn("n_items", checked)
    each = known.select(
        "doc_id", "question_id", "window_no", "parsed",
        F.explode(F.sequence(F.lit(0), F.col("n_items") - 1)).alias("pos"),
    )
    idx = (F.col("window_no") * size + F.col("pos")).cast("int").alias("idx")
    if mode == "find":
        answer = F.try_element_at("parsed", item_id("S", F.col("pos")))
        return each.select("doc_id", "question_id", idx, as_float(answer["noul"]).alias("p"))
    opened = each.select(
        "doc_id", "question_id", idx,
        F.try_element_at("parsed", F.concat(item_id("P", F.col("pos")), F.lit("_needed"))).alias("needed"),
        F.try_element_at("parsed", F.concat(item_id("P", F.col("pos")), F.lit("_role"))).alias("chosen"),
    ).withColumn("role", known_role(F.col("chosen.choice")))
    return opened.select(
        "doc_id", "question_id", "idx", as_float(F.col("needed.noul")).alias("p"), "role",
        as_float(F.try_element_at("chosen.probabilities", F.col("role"))).alias("role_p"),
        as_float(F.col("chosen.confidence")).alias("confidence"),
    )


# --------------------------------------------------------------------------- stored judgments


def distinct_requests(requests: DataFrame) -> DataFrame:
    """One row per content key, with the number of its copies."""
    return requests.groupBy("request_key").agg(
        F.first("request").alias("request"), F.first("n_items").alias("n_items"), F.count("*").alias("copies")
    )


def new_requests(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests the store cannot answer, one row per content key.

    Duplicates are merged before the anti join, so a group of copies reaches it as a single row.
    """
    return distinct_requests(requests).join(store.select("request_key"), "request_key", "left_anti")


def usage_totals(calls: DataFrame) -> DataFrame:
    """Token totals and the model of the last window, per run."""
    return calls.groupBy("doc_id", "question_id").agg(
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("window_no"))).alias("model"),
    )


def run_progress(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Windows done and in total, per run."""
    done = with_answers(requests, answers)
    return done.groupBy("doc_id", "question_id").agg(
        F.count_if(F.col("parsed").isNotNull()).alias("windows_done"), F.count("*").alias("windows_total")
    )


# --------------------------------------------------------------------------- judges


def tidy_judgments(judgments: DataFrame) -> DataFrame:
    """Judgments as they count: NaN and text that is no number read as 0, unknown roles as irrelevant; nulls stay."""
    has = judgments.columns
    tidy = {c: F.when(F.col(c).isNotNull(), as_float(F.col(c))) for c in ("p", "role_p", "confidence") if c in has}
    tidy |= {"role": F.when(F.col("role").isNotNull(), known_role(F.col("role")))} if "role" in has else {}
    return judgments.withColumns(tidy)


def judge_from_table(items: DataFrame, runs: DataFrame, judgments: DataFrame) -> DataFrame:
    """Items of every run with their recorded judgments; ``p`` stays null where there is none.

    Judgments are tidied first. Of several records of one item the one with the highest values in column order holds.
    """
    key = ["doc_id", "question_id", "idx"]
    rest = [c for c in judgments.columns if c not in key]
    judgments = tidy_judgments(judgments).groupBy(*key).agg(F.max(F.struct(*rest)).alias("_")).select(*key, "_.*")
    return items.join(runs.select("doc_id", "question_id"), "doc_id").join(judgments, key, "left")


def terms(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]++"), F.lit(0)))


def question_weights(tokens: DataFrame, questions: DataFrame) -> DataFrame:
    """The questions' key, ``weights`` and ``total``: inverse passage frequency of every term of every question.

    ``tokens`` has the distinct ``terms`` of each passage. Only terms that some question holds become postings: the list of
    these is joined before anything is shuffled, so what travels is one count per question term and task.
    """
    n_items = tokens.agg(F.count("*")).scalar()
    key = question_key(questions)
    asked = questions.select(*key, F.explode(terms(F.col("question"))).alias("term"))
    wanted = asked.select("term").distinct()
    postings = tokens.select(F.explode("terms").alias("term")).join(wanted, "term", "left_semi")
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    vocabulary = wanted.join(frequency, "term", "left").withColumn(
        "idf", F.log(F.lit(1.0) + n_items / F.coalesce("df", F.lit(1)))
    )
    weights = F.sort_array(F.collect_list(F.struct("term", "idf")))
    return (
        lookup_join(asked, vocabulary, "term")
        .groupBy(*key)
        .agg(weights.alias("weights"))
        .select(
            *key,
            F.map_from_entries("weights").alias("weights"),
            F.aggregate("weights", F.lit(0.0), lambda a, w: a + w["idf"]).alias("total"),
        )
    )


def lexical_cue(text: Column) -> Column:
    """First role whose cue words a text holds, null if none."""

    def first(lowered: Column) -> Column:
        cue = F.lit(None).cast("string")
        for name, pattern in reversed(LEXICAL_CUES):
            cue = F.when(lowered.rlike(pattern), F.lit(name)).otherwise(cue)
        return cue

    return let(F.lower(text), first)


def judge_lexically(items: DataFrame, runs: DataFrame, questions: DataFrame) -> DataFrame:
    """Model-free judge: the share of the question's term weight found in the passage, and a cue-word role.

    Words and cues are found once for each passage, before it meets its runs.
    """
    read = items.withColumns({"_terms": terms(F.col("text")), "_cue": lexical_cue(F.col("text"))})
    weighed = question_weights(items.select(terms(F.col("text")).alias("terms")), questions)
    pairs = _with_questions(read.join(runs.select("doc_id", "question_id"), "doc_id"), weighed, how="left")
    shared = F.array_intersect(F.map_keys("weights"), F.col("_terms"))
    found = F.aggregate(shared, F.lit(0.0), lambda a, t: a + F.element_at("weights", t))
    p = F.when(F.col("total") > 0, F.round(found / F.col("total"), 6)).otherwise(F.lit(0.0))
    role = (
        F.when(F.col("p") == 0, F.lit(IRRELEVANT))
        .when(F.col("_cue").isNotNull(), F.col("_cue"))
        .when(F.col("p") >= LEXICAL_DIRECT, F.lit("direct_answer"))
        .otherwise(F.lit("background"))
    )
    role_p = F.when(F.col("_cue").isNotNull() & (F.col("p") != 0), F.lit(1.0)).otherwise(F.col("p"))
    return (
        pairs.withColumn("p", p)
        .withColumns({"role": role, "role_p": role_p, "confidence": role_p})
        .drop("weights", "total", "_terms", "_cue")
    )


def call_judge(
    requests: DataFrame, fn: Callable[[str], dict[str, Any]], concurrency: int | None = None, on_error: str = "fail",
    mode: str | None = None,
) -> DataFrame:
    """Put every request to ``fn``, one call per window.

    ``fn`` gets the request as JSON and returns ``answers`` and, if it likes, ``input_tokens``,
    ``output_tokens`` and ``model``. ``concurrency`` bounds the calls in flight to what the service admits;
    without it every free core calls. ``on_error='skip'`` keeps the error text and goes on.

    With ``mode``, requests come as ``state`` and ``n_items`` and are written out one at a time, right before their call, so that
    no task holds more than the passages of a batch.
    """
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error must be 'fail' or 'skip'")

    fields = ["request_key", "answers", "input_tokens", "output_tokens", "model", "error"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema, replies, sizes = pa.schema(list(zip(fields, types))), REPLIES, REQUEST_SIZES
    prefix, asked, _ = MODES[mode] if mode else ("", {}, None)
    templates = [(suffix, _template(q)) for suffix, q in asked.items()]

    def asked_of(n_items: int) -> str:
        names = [f"{prefix}{pos:02d}" for pos in range(1, n_items + 1)]
        return ",".join(f'"{name}{suffix}":' + q.replace("{id}", name) for name in names for suffix, q in templates)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies: dict[int, str] = {}  # requests of so many items put the same questions

        def written(state: str, n_items: int) -> str:
            if n_items not in bodies:
                if len(bodies) == sizes:
                    bodies.clear()
                bodies[n_items] = asked_of(n_items)
            return f'{{"state":{state},"questions":{{{bodies[n_items]}}}}}'

        for frame in frames:
            for at in range(0, frame.num_rows, replies):
                rows = []
                for key, *request in zip(*(c.to_pylist() for c in frame.slice(at, replies).columns)):
                    row = {"request_key": key, "answers": None, "input_tokens": 0, "output_tokens": 0,
                           "model": None, "error": None}
                    try:
                        reply = fn(written(*request) if templates else request[0])
                        row["answers"] = json.dumps(reply["answers"], ensure_ascii=False)
                        row["input_tokens"] = int(reply.get("input_tokens") or 0)
                        row["output_tokens"] = int(reply.get("output_tokens") or 0)
                        row["model"] = reply.get("model")
                    except Exception as error:  # the policy of the caller decides
                        if on_error == "fail":
                            raise
                        row["error"] = f"{type(error).__name__}: {error}"
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    spread = requests.select("request_key", *(["state", "n_items"] if mode else ["request"]))
    if concurrency is not None:
        spread = spread.repartition(concurrency)
    return spread.mapInArrow(batches, CALL_SCHEMA)
