"""MinHash near-deduplication with fast similarity sketches, banding and exact verification."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayread.llm.blocks import Forest, tile_pairs
from wayread.llm.common import settle
from wayread.llm.components import connected

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Coordinates of a sketch, and the chance that no band of a pair at the threshold agrees, at most.
COORDINATES, MISS = 128, 1e-6
#: Documents in a tile when sketches are compared, and when whole sets are.
TILE, SET_TILE = 2048, 256
#: Standard deviations of the sketch's estimate by which a pair may fall short of the threshold before it is left out.
SLACK = 5.0
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``width`` words, or of all words where there are fewer. A-Z are lower-cased."""
    words = WORDS.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    n = min(width, len(h))
    runs = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        runs = mix(runs * _ODD + h[k:len(h) - n + 1 + k])
    return np.unique(runs)


def sketch(elements: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """A fast similarity sketch: round after round every element is hashed to one of t bins, and empty bins take the smallest
    value that falls into them. From round t on, round t + i puts all elements into bin i, so after 2t rounds none is empty."""
    bins, empty = np.zeros(t, np.uint64), np.ones(t, bool)
    top = np.uint64(2**64 - 1)
    with np.errstate(over="ignore"):
        for turn in range(2 * t):
            h = mix(elements + _ODD * np.uint64(turn + 1))
            if turn < t:
                lowest = np.full(t, top)
                np.minimum.at(lowest, (h % np.uint64(t)).astype(np.intp), h // np.uint64(t))
                fresh = empty & (lowest != top)
                bins[fresh] = mix(lowest[fresh] + np.uint64(turn))
                empty &= ~fresh
            elif empty[turn - t]:
                bins[turn - t] = mix(h.min(keepdims=True) + np.uint64(turn))[0]
                empty[turn - t] = False
            if not empty.any():
                break
    return bins


def band_rows(percent: int) -> int:
    """The most rows of a band, 5 at most, that keep the chance to miss a pair at the threshold under ``MISS``: 5 at 85, 4 at 80."""
    fits = [r for r in range(1, 6) if (1 - (percent / 100) ** r) ** (COORDINATES // r) < MISS]
    return max(fits, default=1)


def sketches(documents: DataFrame, key: str, width: int, percent: int) -> DataFrame:
    """Per document: ``key``, n (set size), same (128-bit hash of the set), bands (a hash for each), prints (a byte per coordinate)."""
    rows_each = band_rows(percent)
    bands = COORDINATES // rows_each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch[1]:
                with np.errstate(over="ignore"):
                    s = shingles(text.as_py(), width)
                    if not len(s):
                        rows.append((0, None, None, None))
                        continue
                    bins = sketch(s)
                    h = np.arange(bands, dtype=np.uint64)
                    for k in range(rows_each):
                        h = mix(h * _ODD + bins[k:bands * rows_each:rows_each])
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), h.astype(np.int64), bins.astype(np.uint8).tobytes()))
            n, same, band, prints = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(prints, pa.binary())],
                names=[key, "n", "same", "bands", "prints"])

    return documents.select(key, F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"{key} long, n long, same binary, bands array<long>, prints binary")


def shingle_sets(documents: DataFrame, key: str, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                with np.errstate(over="ignore"):
                    sets = [shingles(t.as_py(), width).tobytes() for t in part[1]]
                yield pa.RecordBatch.from_arrays([part[0], pa.array(sets, pa.binary())], names=[key, "shingles"])

    return documents.select(key, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{key} long, shingles binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def least_matches(percent: int) -> int:
    """Equal coordinates below which a pair is taken to be under the threshold, ``SLACK`` deviations off."""
    p = percent / 100
    return int(COORDINATES * p - SLACK * (COORDINATES * p * (1 - p)) ** 0.5)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar."""
    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                    for x, y in zip(batch["x"], batch["y"])]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _tiled(rows: DataFrame, tile: int, compare, columns: list[str]) -> DataFrame:
    """What ``compare`` finds between the documents of each pair of tiles of a ``grp``."""
    tiles = tile_pairs(rows, "grp", "id", tile).select("grp", "low", "high", "mine", "id", "component", *columns)

    def run(group: pa.Table) -> pa.Table:
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        group = group.sort_by("mine")
        found = compare(group, low == high, int((group["mine"].to_numpy() == low).sum()))
        columns = list(zip(*found)) or [(), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip("ab", columns)})

    return tiles.groupBy("grp", "low", "high").applyInArrow(run, "a long, b long")


def _promising(percent: int):
    """Documents of a tile pair with a sketch near enough to that of one in another component: (id, id)."""
    least = least_matches(percent)

    def compare(group: pa.Table, alone: bool, split: int) -> list[tuple[int, int]]:
        ids, parts = group["id"].to_numpy(), group["component"].to_numpy()
        prints = np.frombuffer(b"".join(group["prints"].to_pylist()), np.uint8).reshape(len(ids), -1)
        near = np.zeros(len(ids), bool)
        for i in range(len(ids) if alone else split):
            rest = slice(i + 1 if alone else split, None)
            hit = (parts[rest] != parts[i]) & ((prints[rest] == prints[i]).sum(axis=1) >= least)
            if hit.any():
                near[i] = True
                near[rest] |= hit
        return [(x, x) for x in ids[near].tolist()]

    return compare


def _linked(percent: int):
    """Links of a tile pair by their sets, as far as they join components not joined before."""
    least = least_matches(percent)

    def compare(group: pa.Table, alone: bool, split: int) -> list[tuple[int, int]]:
        ids, parts = group["id"].to_pylist(), group["component"].to_pylist()
        prints = np.frombuffer(b"".join(group["prints"].to_pylist()), np.uint8).reshape(len(ids), -1)
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
        forest, number = Forest(len(ids)), {}
        for i, part in enumerate(parts):  # what is joined already
            forest.link(i, number.setdefault(part, i))
        forest.links.clear()
        for i in range(len(ids) if alone else split):
            start = i + 1 if alone else split
            for j in (start + np.flatnonzero((prints[start:] == prints[i]).sum(axis=1) >= least)).tolist():
                if forest.root(i) != forest.root(j) and similar(sets[i], sets[j], percent):
                    forest.link(i, j)
        return [(ids[i], ids[j]) for i, j in forest.links]

    return compare


def near_duplicates(documents: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """``documents`` (doc_id, text) -> doc_id, n_shingles, component_id, kept: one row per row.

    Documents whose sets of ``width``-word shingles share ``percent`` of their union are linked. Equal sets are one class.
    Classes that share a band are candidates. Each is first held against the smallest id of its bucket: of a large group
    that leaves a link per member. Where a bucket still holds several components, these are compared tile by tile, first
    by sketch and then, if near, by whole sets. Every link rests on whole sets; a pair is lost if no band agrees or its
    sketch is ``SLACK`` deviations off, both with chances under 1e-6 at the threshold (the first from 11 percent on).

    Null and empty texts and texts without words have an empty set: no links, kept. Texts of fewer words are one shingle.
    Repeated rows fall into one class; the rows with the smallest id all say kept. Rows with null ids are never linked and
    have a null component. An empty table gives no rows. Other columns are not looked at.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = settle(sketches(texts, "id", width, percent))
    classes = settle(rows.where("n > 0 and id is not null").groupBy("same").agg(F.min("id").alias("id")))
    members = rows.join(classes.withColumnRenamed("id", "class"), "same", "left")
    reps = settle(members.where(F.col("id") == F.col("class")).dropDuplicates(["id"]).select("id", "bands", "prints"))

    # buckets of two or more, and in each the candidate with the smallest id
    bands = reps.select("id", F.explode("bands").alias("bucket"))
    buckets = settle(bands.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("size")).where("size > 1"))
    shared = settle(bands.join(buckets.select("bucket", "first"), "bucket"))
    some = shared.select("id").distinct()
    sets = settle(shingle_sets(texts.join(some, "id", "left_semi").dropDuplicates(["id"]), "id", width))
    pairs = shared.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    near = _near(pairs, reps, percent)
    links = settle(_verified(near, sets, percent))
    parts = connected(links)

    # what the first comparison left apart: buckets with several components
    labelled = settle(shared.join(parts, F.col("id") == F.col("node"), "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("component")))
    apart = settle(labelled.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most"))
    mixed = settle(labelled.join(apart.select("bucket", "least"), "bucket"))
    regions = connected(mixed.select(F.col("least").alias("a"), F.col("component").alias("b")))
    open_docs = mixed.select("id", "component").distinct().join(
        regions.select(F.col("node").alias("component"), F.col("component").alias("grp")), "component").join(reps.select("id", "prints"), "id")
    open_docs = settle(open_docs)
    promising = settle(_tiled(open_docs, TILE, _promising(percent), ["prints"]).select(F.col("a").alias("id")).distinct())
    close = open_docs.join(promising, "id").join(sets, "id")
    more = settle(_tiled(close, SET_TILE, _linked(percent), ["prints", "shingles"]))
    final = connected(more.union(_lasting(parts)))

    labels = final.select(F.col("node").alias("class"), "component")
    out = members.select("id", "n", "class").join(labels, "class", "left")
    component = F.coalesce("component", "class", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      (F.col("id") == component).alias("kept"))


def _lasting(parts: DataFrame) -> DataFrame:
    return parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _near(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches leave the threshold possible."""
    least = least_matches(percent)
    x = reps.select(F.col("id").alias("a"), F.col("prints").alias("x"))
    y = reps.select(F.col("id").alias("b"), F.col("prints").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(len(batch), -1) for c in "xy")
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")
