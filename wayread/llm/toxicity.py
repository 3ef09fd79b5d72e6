"""Toxicity by compression distance: one zstandard dictionary of ordinary and one of toxic text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayread.llm.common import free, kept_in_worker, settle

#: Bytes of each dictionary, and labelled documents that a model is fitted on at most.
DICTIONARY, ROWS = 8_192, 20_000
#: Windows of running text: bytes, and bytes from one to the next.
WINDOW, STEP = 48, 24
#: Windows of ordinary text that its dictionary is trained on at most, and as many of one document.
SAMPLES, OF_ONE = 40_000, 40
#: A piece of text of so many bytes is typical of toxic text if it has this likelihood ratio G and is this many times as frequent.
PIECE, SIGNIFICANT, TIMES = 7, 30.0, 6.0
#: A stretch of typical text is taken in parts of so many bytes at most.
STRETCH = 64
#: Sketches by which near copies are known.
SKETCHES = 6
#: Of labelled documents, one in so many calibrates and trains no dictionary.
FOLDS = 3
#: Share of ordinary windows above a level.
LEVELS = (0.1, 0.03, 0.01, 0.003, 0.001, 0.0003, 0.0001)
#: Gains from which on windows count alike.
MOST = 32
#: Bytes of text and pieces that a task works on at once.
BLOCK, PIECES = 1 << 20, 2_000_000


@dataclass(frozen=True)
class Model:
    ordinary: bytes  # dictionary of ordinary text
    toxic: bytes  # dictionary of toxic text
    levels: tuple[int, ...]  # bytes saved from which windows are counted
    expected: tuple[float, ...]  # share of ordinary windows that save as much
    weights: tuple[float, ...]


def body(text: str | None) -> bytes:
    """What is compressed of a text: lower case, a space between words and around them."""
    words = text.lower().split() if text else []
    return f" {' '.join(words)} ".encode("utf-8", "replace") if words else b""


def windows(length: int) -> np.ndarray:
    """Start and length of the windows of a body; they overlap, and the last one ends where the body does."""
    if length <= WINDOW:
        return np.array([[0, length]] if length else np.zeros((0, 2)), np.int64)
    starts = np.append(np.arange(0, length - WINDOW, STEP), length - WINDOW)
    return np.stack([starts, np.full(len(starts), WINDOW)], 1)


class Gains:
    """Bytes by which the toxic dictionary compresses windows better than the ordinary one alone."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = self._compressor(ordinary), self._compressor(toxic + ordinary)

    @staticmethod
    def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
        how = zstandard.ZstdCompressionParameters.from_level(
            3, window_log=17, min_match=3, strategy=zstandard.STRATEGY_LAZY,
            write_content_size=False, write_checksum=False, write_dict_id=False)
        if len(raw) < 8:
            return zstandard.ZstdCompressor(compression_params=how)
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=how)

    def of(self, text: bytes, places: np.ndarray) -> np.ndarray:
        """Gains of the windows at ``places`` (start, length), from 0 to MOST."""
        segments = zstandard.BufferWithSegments(text, places.astype(np.uint64).tobytes())
        ordinary, toxic = (
            np.fromiter(map(len, found), np.int64, len(found))
            for found in (c.multi_compress_to_buffer(segments, threads=0) for c in (self.ordinary, self.toxic)))
        return np.clip(ordinary - toxic, 0, MOST)

    def counts(self, texts: Iterable[str | None]) -> np.ndarray:
        """A row per text: how many of its windows have each gain from 0 to MOST. Texts are joined, or cut between windows, to blocks."""
        texts = list(texts)
        table = np.zeros((len(texts), MOST + 1), np.int64)
        held, places, owners, size = [], [], [], 0
        for row, text in enumerate(texts):
            whole = body(text)
            at = windows(len(whole))
            for first in range(0, len(at), BLOCK // STEP):
                part = at[first:first + BLOCK // STEP].copy()
                start, end = int(part[0, 0]), int(part[-1].sum())
                part[:, 0] += size - start
                held.append(whole[start:end])
                places.append(part)
                owners.append(np.full(len(part), row))
                size += end - start
                if size >= BLOCK:
                    np.add.at(table, (np.concatenate(owners), self.of(b"".join(held), np.concatenate(places))), 1)
                    held, places, owners, size = [], [], [], 0
        if size:
            np.add.at(table, (np.concatenate(owners), self.of(b"".join(held), np.concatenate(places))), 1)
        return table


def features(counts: np.ndarray, levels: tuple[int, ...], expected: tuple[float, ...]) -> np.ndarray:
    """A row per document: for each level, windows above it against those of ordinary text and as a share; the number of windows."""
    n = counts.sum(1)
    above = np.stack([counts[:, level:].sum(1) for level in levels], 1) if levels else np.zeros((len(n), 0))
    usual = np.outer(n, expected) if levels else above
    return np.concatenate([
        np.ones((len(n), 1)), np.log((above + 0.5) / (usual + 0.5)), np.sqrt(above / np.maximum(n, 1)[:, None]), np.log1p(n)[:, None] / 5], 1)


def scores(counts: np.ndarray, model: Model) -> np.ndarray:
    line = features(counts, model.levels, model.expected) @ np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(line, -30, 30)))


def pieces(text: bytes) -> np.ndarray:
    """Every PIECE bytes of a text as one number, in order."""
    n = max(0, len(text) - PIECE + 1)
    letters = np.frombuffer(text, np.uint8).astype(np.int64)
    return sum((letters[j:j + n] << (8 * j) for j in range(PIECE)), np.zeros(n, np.int64))


def stretches(text: bytes, typical: np.ndarray) -> set[bytes]:
    """Stretches of running text whose pieces are all among ``typical`` (sorted)."""
    found = pieces(text)
    if not len(found) or not len(typical):
        return set()
    place = np.minimum(np.searchsorted(typical, found), len(typical) - 1)
    hits = np.flatnonzero(typical[place] == found)
    cuts = np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1) if len(hits) else []
    return {text[a:min(a + STRETCH, int(h[-1]) + PIECE)] for h in cuts for a in range(int(h[0]), int(h[-1]) + 1, STRETCH - PIECE + 1)}


def covering(counted: list[tuple[bytes, int]], size: int) -> bytes:
    """Up to ``size`` bytes of stretches, each of which brings new pieces for half of its own; the most frequent ones last, where they are cheapest to reach."""
    taken, known, total = [], set(), 0
    for stretch, _ in sorted(counted, key=lambda x: (-x[1], x[0])):
        own = set(pieces(stretch).tolist())
        if 2 * len(own - known) < len(own) or total + len(stretch) > size:
            continue
        known |= own
        taken.append(stretch)
        total += len(stretch)
    return b"".join(reversed(taken))


def trained(samples: list[bytes], size: int) -> bytes:
    """The library's dictionary for ``samples``; where they are too few for it, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=50, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    weights, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        weights = weights + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ weights)
    return weights


def _sketches(text: bytes) -> list[int]:
    """The least hashes of five words under SKETCHES seeds: near copies share most of them."""
    words = text.split()
    runs = {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}
    found = np.fromiter(map(xxhash.xxh3_64_intdigest, runs), np.uint64, len(runs))
    with np.errstate(over="ignore"):
        return [int((found * np.uint64(2 * seed + 1) ^ (found >> np.uint64(7 * seed + 1))).min() >> np.uint64(1)) for seed in range(SKETCHES)]


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = [body(t.as_py()) for t in batch["text"]]
        yield pa.RecordBatch.from_pydict({
            "toxic_": batch["toxic_"], "body": pa.array(bodies, pa.binary()),
            "sketches": pa.array([_sketches(b) for b in bodies], pa.list_(pa.int64()))})


def _one_of_copies(side: DataFrame) -> DataFrame:
    """Documents that share no sketch with another of their kind: of each two that do, one stays."""
    rows = side.select("toxic_", "body", "sketches")
    for number in range(SKETCHES):
        rows = rows.groupBy("toxic_", F.col("sketches")[number].alias("sketch")).agg(F.min(F.struct("body", "sketches")).alias("row")).select("toxic_", "row.*")
    return settle(rows.select("toxic_", "body", F.col("sketches")[0].alias("sketch")))


def _piece_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each kind that hold a piece, summed over what a task holds at once."""
    for batch in batches:
        held: dict[int, list[np.ndarray]] = {0: [], 1: []}
        size = 0
        rows = list(zip(batch["body"], batch["toxic_"].to_pylist()))
        for number, (text, toxic) in enumerate(rows, 1):
            held[toxic].append(np.unique(pieces(text.as_py())))
            size += len(held[toxic][-1])
            if size >= PIECES or number == len(rows):
                for kind, found in held.items():
                    if found:
                        values, n = np.unique(np.concatenate(found), return_counts=True)
                        none = np.zeros(len(n), np.int64)
                        yield pa.RecordBatch.from_pydict({"piece": pa.array(values), "bad": pa.array(n if kind else none), "good": pa.array(none if kind else n)})
                held, size = {0: [], 1: []}, 0


def _typical(train: DataFrame, bad: int, good: int, size: int) -> np.ndarray:
    """Pieces that stand significantly more often in toxic documents, at most ``size``, sorted."""
    counted = train.select("body", "toxic_").mapInArrow(_piece_counts, "piece long, bad long, good long")
    counted = counted.groupBy("piece").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    b, g, n = F.col("bad"), F.col("good"), float(bad + good)
    cell = lambda seen, usual: F.when(seen > 0, seen * F.log(seen / usual)).otherwise(0.0)
    ratio = 2 * (cell(b, (b + g) * (bad / n)) + cell(g, (b + g) * (good / n))
                 + cell(bad - b, (n - b - g) * (bad / n)) + cell(good - g, (n - b - g) * (good / n)))
    found = counted.where((b >= 2) & (b / bad > TIMES * (g + 0.5) / good)).withColumn("ratio", ratio).where(F.col("ratio") > SIGNIFICANT)
    return np.sort(np.array([r["piece"] for r in found.orderBy(F.desc("ratio"), "piece").limit(size).collect()], np.int64))


def _toxic_text(train: DataFrame, typical: np.ndarray, size: int) -> list[tuple[bytes, int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch["body"]:
                found.update(stretches(text.as_py(), typical))
            yield pa.RecordBatch.from_pydict({"stretch": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

    counted = train.where("toxic_ = 1").select("body").mapInArrow(run, "stretch binary, n long").groupBy("stretch").agg(F.sum("n").alias("n"))
    return [(bytes(r["stretch"]), r["n"]) for r in counted.orderBy(F.desc("n"), "stretch").limit(size).collect()]


def _ordinary_text(train: DataFrame) -> list[bytes]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, sketch in zip(batch["body"], batch["sketch"].to_pylist()):
                text = text.as_py()
                places = windows(len(text))
                # evenly over the whole text, from a place of its own
                some = (np.arange(OF_ONE) * len(places) // OF_ONE + sketch % 97) % len(places) if len(places) > OF_ONE else np.arange(len(places))
                found += [text[int(a):int(a + n)] for a, n in places[np.unique(some)]]
            yield pa.RecordBatch.from_pydict({"window": pa.array(found, pa.binary())})

    found = train.where("toxic_ = 0").select("body", "sketch").mapInArrow(run, "window binary").distinct()
    return [bytes(r["window"]) for r in found.orderBy(F.xxhash64("window"), "window").limit(SAMPLES).collect()]


def fit(documents: DataFrame, labels: DataFrame, rows: int = ROWS, size: int = DICTIONARY) -> Model:
    """A model from ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1).

    At most ``rows`` labelled documents are used, those of lowest hash, and one of each group of near copies. Two thirds of them train
    the dictionaries: the ordinary one on windows of ordinary text, by the library; the toxic one on the stretches of running text
    whose pieces stand significantly more often in toxic documents, covering as many such pieces as ``size`` bytes hold. The last
    third sets the thresholds, from how its ordinary windows compress, and the weights; near copies are on one side only. Spark
    counts; only what can enter a dictionary and one short row per document reach the driver.

    Labels that are null or no 0 or 1 are left out, of several for one document the highest holds. Where a side lacks one kind of
    label, all documents serve on both sides. Without labels of both kinds the score is the share of toxic labels (0 without any).
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic_"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "key_")
    texts = documents.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(known), F.col("doc_id") == F.col("key_")).select("text", "toxic_")  # at most ``rows`` ids
    sample = settle(sample.mapInArrow(_prepared, "toxic_ int, body binary, sketches array<long>")
                    .withColumn("calibrates", F.pmod(F.xxhash64(F.col("sketches")[0]), F.lit(FOLDS)) == 0))
    sides = [sample.where(~F.col("calibrates")), sample.where("calibrates")]

    def kinds(side: DataFrame) -> tuple[int, int]:
        found = {r["toxic_"]: r["n"] for r in side.groupBy("toxic_").agg(F.count("*").alias("n")).collect()}
        return found.get(1, 0), found.get(0, 0)

    bad, good = kinds(sample)
    if not bad or not good:
        return Model(b"", b"", (), (), (30.0 if bad else -30.0, 0.0))
    if not all(kinds(sides[0])) or not all(kinds(sides[1])):
        sides = [sample, sample]
    train, calibration = (_one_of_copies(side) for side in sides)
    bad, good = kinds(train)
    typical = _typical(train, bad, good, size)
    model = Model(trained(_ordinary_text(train), size), covering(_toxic_text(train, typical, size), size), (), (), ())

    found = [(r["counts_"], r["toxic_"]) for r in _counted(calibration.withColumn("text", F.decode("body", "UTF-8")), model, ["toxic_"]).collect()]
    counts, toxic = np.array([c for c, _ in found], np.int64), np.array([float(t) for _, t in found])
    usual = counts[toxic == 0].sum(0)
    above = np.append(usual[::-1].cumsum()[::-1], 0) / max(1, usual.sum())  # share of ordinary windows with this gain or more
    levels = tuple(sorted({max(1, int(np.argmax(above <= share))) for share in LEVELS}))
    levels = tuple(level for level in levels if level <= MOST)
    expected = tuple(float(above[level]) for level in levels)
    return Model(model.ordinary, model.toxic, levels, expected, tuple(_logistic(features(counts, levels, expected), toxic).tolist()))


def _worker(model: Model) -> Gains:
    key = xxhash.xxh3_64_hexdigest(model.ordinary + b"|" + model.toxic)
    return kept_in_worker(f"gains {key}", lambda: Gains(model.ordinary, model.toxic))


def _counted(documents: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = _worker(model)
        for batch in batches:
            table = gains.counts(t.as_py() for t in batch["text"])
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in columns} | {"counts_": pa.array(table.tolist(), pa.list_(pa.int64()))})

    schema = T.StructType([documents.schema[c] for c in columns]).add("counts_", T.ArrayType(T.LongType()))
    return documents.select(*columns, "text").mapInArrow(run, schema)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``toxicity_``, from 0 to 1.

    The whole text is read in overlapping windows of running text. How many of them the toxic dictionary compresses better, and by
    how much, makes the document's features, and calibrated weights their score. Null and empty texts have no windows and the score
    of that. All columns pass through, whatever their names, but a column ``toxicity_`` is replaced; rows that repeat are scored
    alike. An empty table stays empty.
    """
    name, columns = free("score_", documents.columns), documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = _worker(model)
        for batch in batches:
            found = scores(gains.counts(t.as_py() for t in batch["text"]), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, name])

    documents = documents.withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())])
    return documents.mapInArrow(run, schema).drop(*(c for c in columns if c.lower() == "toxicity_")).withColumnRenamed(name, "toxicity_")


def held_out(key: str = "doc_id"):
    """Documents whose labels no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
