"""Best-fit packing of tokenized documents into sequences of fixed length."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayread.llm.common import kept_in_worker, settle

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def encoder(path: str, tokenizer: str):
    """Ids of a text by the tokenizer of a JSON file.

    The ranks file at ``path`` holds the same vocabulary and gives the same ids several times faster. Its library gives up on
    white space of hundreds of thousands of characters; such texts go to the tokenizer itself. The string <|endoftext|> is one
    token, the one after all ranks.
    """
    import base64

    import public_tokenizers
    import tiktoken
    import tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    whole = []

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            whole or whole.append(tokenizers.Tokenizer.from_file(tokenizer))
            return np.array(whole[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(documents: DataFrame, capacity: int = 1024, end: int = 2, vocabulary: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32, and (task, nth), their number among the pieces
    of equal length that one task has cut. Only documents over ``capacity`` are cut, and their first piece is the short one."""
    vocabulary, tokenizer = vocabulary or default_vocabulary(), tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_in_worker(vocabulary, lambda: encoder(vocabulary, tokenizer))
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = np.append(encode(text.as_py() or ""), end).astype("<u4")
                first = len(ids) % capacity or capacity
                for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity) if k else 0
                    n = stop - start
                    seen[n] = nth = seen.get(n, -1) + 1
                    rows.append((doc, k, start, n, zlib.crc32(ids[start:stop].tobytes()), task, nth))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over run lengths: counts by length -> (length, rank, each, bin, bins, offset).

    A line says that the documents of this length from ``rank`` on go to ``bins`` sequences from number ``bin`` on,
    ``each`` side by side from ``offset``. One round per length, the longest first: the sorted documents of that length
    sweep the sorted gaps for their successors, the r-th of them takes the r-th place, and the gaps are updated as one.
    Gaps that are equal stay one run, so work and plan depend on ``capacity`` alone and not on the documents.
    """
    gaps: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> (first bin, bins)
    plan, opened = [], 0

    def leave(gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if gap not in runs:
                bisect.insort(gaps, gap)
            runs.setdefault(gap, []).append((first, bins))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, bins = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first, bins = capacity, opened, -(-left // (capacity // length))
                opened += bins
            each = gap // length
            full = min(bins, left // each)
            if full:
                plan.append((length, rank, each, first, full, capacity - gap))
                leave(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < bins and left:
                plan.append((length, rank, left, first + full, 1, capacity - gap))
                leave(gap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            leave(gap, first + full, bins - full)
    return plan


def packed(documents: DataFrame, capacity: int = 1024, end: int = 2, vocabulary: str | None = None) -> DataFrame:
    """``documents`` (doc_id, text) -> per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Lengths are whole numbers up to ``capacity``, so sorting documents and gaps by size is counting them: run lengths,
    at most ``capacity`` of them, are what reaches the driver, and ``best_fit`` works in rounds on those. A piece's rank
    among its equals is the pieces in earlier tasks plus its number in its own, which takes no sort of a whole length.

    Null and empty texts are the end token alone. Repeated rows and ids are documents of their own; null ids stay null.
    Other columns are not looked at. An empty table gives no rows.
    """
    cut = settle(pieces(documents, capacity, end, vocabulary))
    tallies = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = cut.sparkSession.createDataFrame(
        best_fit(counts, capacity), "length long, from_rank long, each long, first long, bins long, at long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = tallies.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(starts, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    # the plan's size is bounded by the capacity
    here = F.col("rank") - F.col("from_rank")
    placed = ranked.join(F.broadcast(plan), "length").where((here >= 0) & (here < F.col("each") * F.col("bins")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(here / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + here % F.col("each") * F.col("length")).cast("long").alias("offset"))
