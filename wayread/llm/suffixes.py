"""Removal of long repeated byte strings with a logarithmic family of sorted suffix samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayread.llm.common import kept_in_worker, settle

#: Bytes of the strings whose lowest hash picks a sample: every match of the full length holds one in the same place.
SEED = 20
#: Bytes of text that are hashed at a time.
CHUNK = 250_000
#: Samples that make a new batch of the family.
BATCH = 1 << 19
_BASE = np.uint64(0x9FB21C651E98DF25)
SAMPLE = np.dtype([("seed", "<u4"), ("whole", "<u4"), ("left", "<u2"), ("right", "<u2"), ("doc", "<i8"), ("at", "<u4")])
#: Flanks that no string has, and those that any string may have as its seed stands there several times.
NONE, ANY = 0, 1
WINDOW = np.dtype([("whole", "<u8"), ("doc", "<i8"), ("at", "<u4")])
FULL, OPEN, SINGLE = 0, 1, 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, and a random number for each byte."""

    def build():
        size = 1 << max(21, n.bit_length())
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE)]))
        down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, np.uint64(pow(int(_BASE), -1, 2**64)))]))
        return up, down, np.random.default_rng(7).integers(1, 2**63, 256, np.uint64)

    return kept_in_worker(f"powers {max(21, n.bit_length())}", build)


class Text:
    """Texts side by side, with hashes of all their strings of ``length`` bytes at hand. Strings never span two texts."""

    def __init__(self, texts: list[bytes], length: int):
        self.length, sizes = length, np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.up, down, value = _powers(len(data))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * down[:len(data)])])
        self.docs = self.first = self.last = np.zeros(0, np.int64)
        self.lows = np.zeros(0, np.uint64)
        if len(data) < length:
            return
        # the lowest seed hash within each string of the full length
        low = _mix((self.sums[SEED:] - self.sums[:-SEED]) * self.up[:len(data) - SEED + 1])
        width, have = length - SEED + 1, 1
        self.seeds = low
        while have < width:
            step = min(have, width - have)
            low, have = np.minimum(low[:-step], low[step:]), have + step
        fits = np.zeros(len(data) + 2, np.int32)
        long = sizes >= length
        np.add.at(fits, self.starts[long], 1)
        np.add.at(fits, self.starts[long] + sizes[long] - length + 1, -1)
        fits = np.cumsum(fits)[:len(low)] > 0
        self.low, self.fits = low, fits
        # strings side by side with one lowest hash are one sample
        same = np.zeros(len(low) + 1, bool)
        same[1:-1] = fits[1:] & fits[:-1] & (low[1:] == low[:-1])
        # where texts of exactly the full length touch, strings of two texts are side by side
        same[self.starts[(self.starts > 0) & (self.starts < len(low))]] = False
        self.first, self.last = np.flatnonzero(fits & ~same[:-1]), np.flatnonzero(fits & ~same[1:])
        self.lows = low[self.first]
        self.docs = np.searchsorted(self.starts, self.first, side="right") - 1
        # empty texts start where the next one does
        self.ordinals = np.arange(len(self.docs)) - np.searchsorted(self.docs, self.docs)

    def flanks(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each sample's seed with half of the other bytes to its left, and to its right: a string of the full
        length holds one of the two."""
        half, span = (self.length - SEED + 1) // 2, self.length - SEED
        # a place is the seed of some string if the highest of the lowest hashes around it is its own
        high, have = np.zeros(len(self.seeds) + span, np.uint64), 1
        high[span:span + len(self.low)] = np.where(self.fits, self.low, np.uint64(0))
        while have < span + 1:
            step = min(have, span + 1 - have)
            high, have = np.maximum(high[:-step], high[step:]), have + step
        places = np.flatnonzero(high == self.seeds)
        value = self.seeds[places]
        sample = np.minimum(np.searchsorted(self.first, places, side="right") - 1, len(self.first) - 1)
        while (astray := self.lows[sample] != value).any():
            sample[astray] -= 1
        seed = np.full(len(self.first), -1, np.int64)
        seed[sample[::-1]] = places[::-1]
        again = np.bincount(sample, minlength=len(self.first)) > 1
        self.middle = seed - half  # the strings that start up to here hold the left flank, those from here on the right one
        size = np.uint64(0x61C8864680B583EB)
        start = np.maximum(seed - half, 0)
        left = _mix((self.sums[seed + SEED] - self.sums[start]) * self.up[start] + size) % np.uint64(65534) + np.uint64(2)
        end = np.minimum(seed + SEED + half, len(self.sums) - 1)
        right = _mix((self.sums[end] - self.sums[seed]) * self.up[seed] + size) % np.uint64(65534) + np.uint64(2)
        left[seed - half < self.first] = NONE
        right[seed + SEED + half > self.last + self.length] = NONE
        left[again] = right[again] = ANY
        return left, right

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the bytes that the strings from ``first`` to ``last`` cover, wherever they stand."""
        span = (last - first).astype(np.uint64) + np.uint64(1)
        return _mix((self.sums[last + self.length] - self.sums[first]) * self.up[first] + span * np.uint64(0x2545F4914F6CDD1D))


def _chunks(docs: list, texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size, end = size + len(texts[end]), end + 1
        yield np.array(docs[at:end], np.int64), texts[at:end]
        at = end


def _keys(rows: np.ndarray) -> list[np.ndarray]:
    """What makes rows equal strings, in as few numbers as they fit."""
    if "seed" not in rows.dtype.names:
        return [rows["whole"]]
    return [rows["seed"].astype(np.uint64) << np.uint64(32) | rows["whole"], rows["left"].astype(np.uint32) << np.uint32(16) | rows["right"]]


class Family:
    """Sorted samples in levels. A new batch is sorted and becomes the lowest level; levels of like size merge, so that sizes
    grow geometrically and each sample is merged a logarithmic number of times."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    @staticmethod
    def _sorted(rows: np.ndarray) -> np.ndarray:
        return rows[np.lexsort([rows["doc"], *reversed(_keys(rows))])]

    def add(self, batch: np.ndarray) -> None:
        self.levels.append(self._sorted(batch))
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            last = self.levels.pop()
            self.levels[-1] = self._sorted(np.concatenate([self.levels[-1], last]))

    def merged(self, kind: np.dtype) -> np.ndarray:
        while len(self.levels) > 1:
            last = self.levels.pop()
            self.levels[-1] = self._sorted(np.concatenate([self.levels[-1], last]))
        return self.levels[0] if self.levels else np.zeros(0, kind)


def _groups(*columns: np.ndarray) -> np.ndarray:
    """For each row of sorted columns the place where its group starts."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _rows(docs: np.ndarray, kind: int, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(docs), 50_000):
        d, a = docs[k:k + 50_000], at[k:k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(np.full(len(d), kind, np.int32)), pa.array(a.astype(np.int64))], names=["doc_id", "kind", "at"])


FOUND = "doc_id long, kind int, at long"


def _dealt(parts: list[np.ndarray], column: str, dealt: int) -> pa.RecordBatch:
    """A batch's rows, packed by the residue of a hash. Of equal strings only those of the batch's smallest document go out;
    the others are settled here and go as rows of their own, under negative numbers."""
    rows = np.concatenate(parts)
    rows = Family._sorted(rows)
    lead = rows["doc"][_groups(*_keys(rows))] if len(rows) else rows["doc"]
    known, sent = rows[rows["doc"] > lead], rows[rows["doc"] == lead]
    to = (sent[column] % dealt).astype(np.int64)
    order = np.lexsort((sent["at"], sent["doc"], to))
    sent, to = sent[order], to[order]
    ends = np.searchsorted(to, np.arange(dealt + 1))
    out = [(d, _packed(sent[a:b])) for d, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
    out += [(-1 - int(known["doc"][0] % dealt), _packed(known))] if len(known) else []
    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["to", "rows"])


def _packed(rows: np.ndarray) -> bytes:
    """Columns one after another, ids as differences: they are sorted and pack well, unlike the hashes."""
    doc = np.diff(rows["doc"], prepend=np.int64(0))
    small = zstandard.ZstdCompressor(level=1).compress(doc.tobytes() + rows["at"].tobytes())
    keys = b"".join(rows[c].tobytes() for c in rows.dtype.names if c not in ("doc", "at"))
    return len(rows).to_bytes(8, "little") + keys + small


def _unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    n, at = int.from_bytes(blob[:8], "little"), 8
    rows = np.empty(n, kind)
    for c in kind.names:
        if c not in ("doc", "at"):
            rows[c] = np.frombuffer(blob, kind[c], n, at)
            at += n * kind[c].itemsize
    small = zstandard.ZstdDecompressor().decompress(blob[at:])
    rows["doc"] = np.cumsum(np.frombuffer(small, np.int64, n))
    rows["at"] = np.frombuffer(small, np.uint32, n, 8 * n)
    return rows


def _received(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> tuple[np.ndarray, list[np.ndarray]]:
    """All rows of a partition in the family's order, and those that a batch has settled by itself."""
    family, known, waiting, size = Family(), [], [], 0
    for batch in batches:
        for to, blob in zip(batch["to"].to_pylist(), batch["rows"]):
            rows = _unpacked(blob.as_py(), kind)
            if to < 0:
                known.append(rows)
                continue
            waiting.append(rows)
            size += len(rows)
            if size > BATCH:
                family.add(np.concatenate(waiting))
                waiting, size = [], 0
    if waiting:
        family.add(np.concatenate(waiting))
    return family.merged(kind), known


def repeats(documents: DataFrame, length: int = 50) -> DataFrame:
    """``documents`` (doc_id, text) -> (doc_id, kind, at): what of a document also stands in one of smaller id.

    Kind FULL is a sample of that ordinal, with all its strings; kind SINGLE one string of ``length`` bytes, by its start.
    """
    dealt_parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = 2 * dealt_parts

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, SAMPLE)]
            with np.errstate(over="ignore"):
                for docs, texts in _chunks(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                    text = Text(texts, length)
                    if len(text.first):
                        rows = np.empty(len(text.first), SAMPLE)
                        rows["seed"], rows["whole"] = text.lows >> np.uint64(32), text.hashes(text.first, text.last) >> np.uint64(32)
                        rows["left"], rows["right"] = text.flanks()
                        rows["doc"], rows["at"] = docs[text.docs], text.ordinals
                        found.append(rows)
            yield _dealt(found, "seed", dealt)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, known = _received(batches, SAMPLE)
        for k in known:
            yield from _rows(k["doc"], FULL, k["at"])
        if not len(rows):
            return
        later = rows["doc"] > rows["doc"][_groups(*_keys(rows))]
        yield from _rows(rows["doc"][later], FULL, rows["at"][later])
        # the first of each kind: of the same seed and one flank, in a smaller document, their strings have to be looked at
        rows = rows[~later]
        seeds = _groups(rows["seed"])
        several = np.bincount(seeds, minlength=len(rows))[seeds] > 1
        rows = rows[several]
        asked = np.zeros(len(rows), np.int64)  # 1: strings with the left flank, 2: with the right one
        for sides, flank in ((1, "left"), (2, "right")):
            order = np.lexsort((rows["doc"], rows[flank], rows["seed"]))
            part = rows[order]
            groups = _groups(part["seed"], part[flank])
            split = (part["doc"] > part["doc"][groups]) & (part[flank] != NONE)
            hit = np.zeros(len(part), bool)
            hit[groups[split]] = True
            asked[order] |= np.where(hit[groups], sides, 0)
        seeds = _groups(rows["seed"])
        loose = np.zeros(len(rows), bool)
        loose[seeds[rows["left"] == ANY]] = True
        asked[loose[seeds]] = 3
        some = asked > 0
        yield from _rows(rows["doc"][some], OPEN, rows["at"][some].astype(np.int64) * 4 + asked[some])

    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    texts = texts.where(F.octet_length("text") >= length)
    found = settle(texts.mapInArrow(sample, "to long, rows binary").repartition(dealt_parts, "to").mapInArrow(scan, FOUND))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, parts = batch["asked"].to_pylist(), [np.zeros(0, WINDOW)]
            at = 0
            with np.errstate(over="ignore"):
                for docs, part in _chunks(batch["doc_id"].to_pylist(), [zstandard.decompress(t) for t in batch["text"].to_pylist()]):
                    text = Text(part, length)
                    if len(text.first):
                        text.flanks()
                    for k in range(len(docs)):
                        which = np.searchsorted(text.docs, k) + np.array(asked[at + k], np.int64) // 4
                        sides = np.array(asked[at + k], np.int64) % 4
                        fits = which < np.searchsorted(text.docs, k, side="right")
                        which, sides = which[fits], sides[fits]
                        if len(which):
                            first = np.where(sides == 2, np.maximum(text.first[which], text.middle[which]), text.first[which])
                            last = np.where(sides == 1, np.minimum(text.last[which], text.middle[which]), text.last[which])
                            places = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
                            rows = np.empty(len(places), WINDOW)
                            rows["whole"], rows["doc"], rows["at"] = text.hashes(places, places), docs[k], places - text.starts[k]
                            parts.append(rows)
                    at += len(docs)
            yield _dealt(parts, "whole", dealt)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, known = _received(batches, WINDOW)
        for k in known:
            yield from _rows(k["doc"], SINGLE, k["at"])
        if len(rows):
            later = rows["doc"] > rows["doc"][_groups(rows["whole"])]
            yield from _rows(rows["doc"][later], SINGLE, rows["at"][later])

    asked = found.where(F.col("kind") == OPEN).groupBy("doc_id").agg(F.collect_list("at").alias("asked"))  # per document
    some = zipped(texts).join(asked, "doc_id").select("doc_id", "text", "asked")
    single = some.mapInArrow(strings, "to long, rows binary").repartition(dealt_parts, "to").mapInArrow(meet, FOUND)
    return found.where(F.col("kind") == FULL).union(single)


def zipped(texts: DataFrame) -> DataFrame:
    """(doc_id, text: binary) with compressed texts, as they are about to be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([press(t.as_py() or b"") for t in batch["text"]], pa.binary())], names=["doc_id", "text"])

    return texts.mapInArrow(run, "doc_id long, text binary")


def without_repeats(documents: DataFrame, length: int = 50) -> DataFrame:
    """``documents`` (doc_id, text) -> doc_id, kept (the bytes that stay), n_bytes, n_removed, n_spans: one row per row.

    A byte goes if a string of ``length`` bytes over it also starts in a document of smaller id. Texts are UTF-8 bytes and
    strings never span two of them. Strings are judged on the input, and those within one document do not count.

    A sample stands for all strings side by side that share their lowest seed hash; it has the same place and extent wherever
    the same bytes stand. Samples are sorted in the tasks of a hash range, in a family of levels, and scanned: equal ones
    are settled; those that share a seed and one flank but not the whole are taken apart into strings, and these are
    matched the same way. Equality is that of hashes: 96 bits of seed, whole and flanks for samples, 64 for strings.

    Null texts are empty. Ids are taken to be unique; rows with null ids stay whole and are no source. An empty table
    gives no rows. Other columns are not looked at.
    """
    found = repeats(documents, length).groupBy(F.col("doc_id").alias("key_")).agg(F.collect_list(F.struct("kind", "at")).alias("found"))  # per document
    texts = zipped(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")))
    joined = texts.join(found, texts["doc_id"] == F.col("key_"), "left").select("doc_id", "text", "found.kind", "found.at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, blob, kinds, places in zip(batch["doc_id"].to_pylist(), batch["text"], batch["kind"], batch["at"]):
                raw = zstandard.decompress(blob.as_py())
                kinds, places = kinds.as_py(), places.as_py()
                if not kinds:
                    out.append((doc, raw, len(raw), 0, 0))
                    continue
                kinds, places = np.array(kinds), np.array(places, np.int64)
                with np.errstate(over="ignore"):
                    text = Text([raw], length)
                samples = places[(kinds == FULL) & (places < len(text.first))]
                single = places[(kinds == SINGLE) & (places + length <= len(raw))]
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, np.concatenate([text.first[samples], single]), 1)
                np.add.at(edge, np.concatenate([text.last[samples] + length, single + length]), -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((doc, kept, len(raw), int(gone.sum()), int(np.diff(gone.astype(np.int8), prepend=0).clip(0).sum())))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), *[pa.array(c, pa.int64()) for c in columns[2:]]],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
