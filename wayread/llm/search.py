"""Exact top-k search by term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and candidates that one task scores at a time.
QUERY_BLOCK, BLOCK = 1024, 8192
HITS = "query_id long, vec_id long, score long"


def weights(vector: str | Column, scale: float = 64.0) -> Column:
    """Whole-number term weights floor(scale * x); null if the vector or a component is null or not finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


def matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of longs as rows; shorter ones end in zeros."""
    lists = lists.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(ends.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < ends[:, None]] = flat
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of all candidates for a few queries: term by term, weighted postings go into dense arrays of scores.

    A term that most candidates hold has its postings as a dense row, a rare one as places and weights.
    """
    terms = min(queries.shape[1], candidates.shape[0])
    reach = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * max(terms, 1)
    kind = np.int32 if reach < 2**31 else np.int64
    queries, candidates = queries.astype(kind), candidates.astype(kind)
    scores = np.zeros((len(queries), candidates.shape[1]), kind)
    product = np.empty_like(scores)
    for term in range(terms):
        asked, posting = queries[:, term], candidates[term]
        places = np.flatnonzero(posting)
        if not asked.any() or not len(places):
            continue
        if len(places) * 8 > len(posting):
            np.multiply(asked[:, None], posting[None, :], out=product)
            scores += product
        else:
            scores[:, places] += asked[:, None] * posting[places][None, :]
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id; ``ids`` ascend, and ``own`` takes no part."""
    places = np.flatnonzero(ids != own)
    found = scores[places]
    if len(found) > k:
        least = np.partition(found, len(found) - k)[len(found) - k]
        places = places[found >= least]
    order = np.lexsort((ids[places], -scores[places].astype(np.int64)))
    return places[order[:k]]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """``queries`` and ``candidates`` (vec_id, terms: array of long weights) -> query_id, rank, vec_id, score.

    All queries meet all candidates in blocks of ids; a block pair keeps k hits per query, and those are merged. A
    query's own id is no candidate for it, whatever rows carry that id. Terms beyond the shorter of two lists weigh 0.
    Rows with null ids or terms take no part, a repeated row is a candidate each time and a query once for each
    distinct row, fewer than k candidates give all of them, empty tables no rows. Other columns are not looked at.
    """
    queries = queries.where("vec_id is not null and terms is not null").select(F.col("vec_id").cast("long"), "terms").distinct()
    candidates = candidates.where("vec_id is not null and terms is not null").select(F.col("vec_id").cast("long"), "terms")
    asked, held = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (candidates, BLOCK)))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "terms", block(asked).alias("q"), every(held).alias("c"))
    right = candidates.select("vec_id", "terms", every(asked).alias("q"), block(held).alias("c"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            right = right.sort_by("vec_id")
            ids, own = right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
            postings, asked = np.ascontiguousarray(matrix(right["terms"]).T), matrix(left["terms"])
            for at in range(0, len(own), 32):
                scores = accumulate(asked[at:at + 32], postings)
                for row, query in zip(scores, own[at:at + 32]):
                    hits = best(row, ids, query, k)
                    out.append((np.full(len(hits), query), ids[hits], row[hits].astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    hits = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(score, HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
