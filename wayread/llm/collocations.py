"""Phrase collocation mining: exact counts of word runs, split where their parts stick together least.

Runs of words are counted in two passes. Each task fills a trie of hash containers and, when that has grown to its bound, spills whole
subtrees as sorted runs; runs meet by their prefix partition and are merged there. The first pass counts single words and pairs.
A phrase cannot be more frequent than any pair in it, so the second pass counts longer phrases only where all pairs may be
frequent. A bit table of fixed size says so; it errs only towards counting.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayread.llm.common import settle

#: Bytes that end a piece (fixed values); 255 stands for them, as UTF-8 never holds it.
CUTS = b".,;:!?\n\x0b\x0c\r"
_EDGE = 255
_TABLE = bytes(_EDGE if b in CUTS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_EDGE_WORD = bytes([_EDGE])

_BREAK = re.compile(rb"[\t-\r .,;:!?]")
#: Bytes of text that are counted at once, and bytes of all texts for each prefix partition.
SLICE, CELL = 1 << 20, 6 << 20

_RUN_SCHEMA = "lang string, cell long, run binary"
_COUNT_SCHEMA = "lang string, phrase string, words int, count long, bits array<long>"
_PAIR = np.dtype(">u4")


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 11)


def mixed(first: np.ndarray, second: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of pairs of 64-bit hashes."""
    h = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ np.uint64(seed)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Trie:
    """Counts of runs of words in hash containers under a shallow trie.

    A container holds whole keys (ids of all words, four bytes each) below one prefix, in a hash table for each size. One that has
    grown past its limit bursts: each next word that owns much of it gets a container of its own, down to two words. ``size``
    counts all entries.
    """

    def __init__(self, sizes: tuple[int, ...], burst: int):
        self.sizes, self.burst, self.size = sizes, burst, 0
        self.containers: dict[bytes, dict[int, Counter]] = {b"": self._empty()}
        self.limits: dict[bytes, int] = {}

    def _empty(self) -> dict[int, Counter]:
        return {size: Counter() for size in self.sizes}

    def add(self, rows: np.ndarray) -> None:
        """Count runs given as rows of word ids."""
        if not len(rows):
            return
        words = rows.shape[1]
        keys = np.ascontiguousarray(rows.astype(_PAIR)).view(f"V{4 * words}").ravel()
        names = list(self.containers)
        owners = self._owners(rows, names)
        order = np.argsort(owners, kind="stable")
        keys, owners = keys[order], owners[order]
        ends = (np.flatnonzero(np.diff(owners)) + 1).tolist()
        for start, stop in zip([0, *ends], [*ends, len(keys)]):
            prefix = names[owners[start]]
            container = self.containers[prefix][words]
            before = len(container)
            container.update(keys[start:stop].tolist())
            self.size += len(container) - before
            if len(container) > self.limits.get(prefix, self.burst) and len(prefix) < min(8, 4 * words):
                self._burst(prefix)

    def _owners(self, rows: np.ndarray, names: list[bytes]) -> np.ndarray:
        """Number of the deepest container for each row."""
        owners = np.zeros(len(rows), np.int64)
        own = rows[:, 0].astype(np.int64)
        for depth in (1, 2):
            found = sorted((int.from_bytes(p, "big"), i) for i, p in enumerate(names) if len(p) == 4 * depth)
            if found and rows.shape[1] >= depth:
                known, number = np.array(found).T
                own = own if depth == 1 else (own << 32) | rows[:, 1]
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                owners = np.where(known[at] == own, number[at], owners)
        return owners

    def _burst(self, prefix: bytes) -> None:
        """Give the next words that own a large part of a container containers of their own."""
        container, depth = self.containers[prefix], len(prefix) // 4
        below = {n: list(counts) for n, counts in container.items() if n > depth and counts}
        nexts = {n: np.frombuffer(b"".join(keys), _PAIR)[depth::n] for n, keys in below.items()}
        owners, shares = np.unique(np.concatenate(list(nexts.values())), return_counts=True)
        heavy = owners[shares >= self.burst // 64 + 2]
        for n, keys in below.items():
            for i in np.flatnonzero(np.isin(nexts[n], heavy)).tolist():
                key = keys[i]
                to = self.containers.get(key[: 4 * depth + 4]) or self.containers.setdefault(key[: 4 * depth + 4], self._empty())
                to[n][key] += container[n].pop(key)
        self.limits[prefix] = max(self.burst, 2 * max(map(len, container.values())))

    def spilled(self, least: int) -> Iterator[dict[int, Counter]]:
        """Empty the largest subtrees until at most ``least`` entries are left. The trie keeps its shape."""
        sizes = {prefix: sum(map(len, c.values())) for prefix, c in self.containers.items()}
        for prefix in sorted(sizes, key=lambda p: -sizes[p]):
            if self.size <= least:
                break
            container, self.containers[prefix] = self.containers[prefix], self._empty()
            self.size -= sizes[prefix]
            yield container


class Counting:
    """The work of one task: texts in, sorted runs out as ``(lang, cell, run)``."""

    def __init__(self, sizes: tuple[int, ...], cells: int, table: bytes | None, entries: int, burst: int):
        self.sizes, self.cells, self.entries, self.burst = sizes, cells, entries, burst
        self.table = np.frombuffer(table, np.uint8) if table is not None else None
        self.totals: Counter = Counter()
        self._new_ids()

    def _new_ids(self) -> None:
        self.ids: dict[bytes, int] = {_EDGE_WORD: 0}
        self.hashes, self.hashed = np.zeros(1 << 12, np.uint64), 0
        self.tries: dict[str, Trie] = {}

    def _hashes(self) -> np.ndarray:
        """Hashes of all words, by id."""
        if len(self.ids) > self.hashed:
            if len(self.ids) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(len(self.ids), np.uint64)])
            self.hashes[self.hashed : len(self.ids)] = [word_hash(w) for w in islice(self.ids, self.hashed, None)]
            self.hashed = len(self.ids)
        return self.hashes

    def add(self, lang: str, text: bytes) -> Iterator[tuple[str, int, bytes]]:
        """Count ``text``, slice by slice: each takes along the words before it that runs may start with."""
        at, before = 0, []
        while at < len(text):
            found = _BREAK.search(text, at + SLICE)
            stop = found.start() if found else len(text)
            words = text[at:stop].translate(_TABLE).replace(_EDGE_WORD, b" \xff ").split()
            yield from self._add(lang, before + words, len(before))
            before = (before + words)[1 - max(self.sizes) :] if max(self.sizes) > 1 else []
            at = stop

    def _add(self, lang: str, words: list[bytes], known: int) -> Iterator[tuple[str, int, bytes]]:
        """Count all runs that end behind the first ``known`` words."""
        number, get = self.ids, self.ids.get
        ids = np.array([i if (i := get(w)) is not None else number.setdefault(w, len(number)) for w in words], np.uint32)
        real = ids != 0
        self.totals[lang] += int(real[known:].sum())
        near = None
        if self.table is not None and len(ids) > 1:
            h = self._hashes()
            near = real[:-1] & real[1:]
            at = np.flatnonzero(near)
            near[at] = self._frequent(lang, h[ids[at]], h[ids[at + 1]])
        trie = self.tries.setdefault(lang, Trie(self.sizes, self.burst))
        for k in self.sizes:
            if len(ids) < k:
                continue
            starts = real[: len(ids) - k + 1].copy()
            starts[: max(0, known - k + 1)] = False
            for j in range(1, k):
                starts &= real[j : len(ids) - k + 1 + j] if near is None else near[j - 1 : len(ids) - k + j]
            at = np.flatnonzero(starts)
            trie.add(np.stack([ids[at + j] for j in range(k)], axis=1))
        if len(self.ids) > self.entries:
            yield from self.spill(0)
        elif sum(t.size for t in self.tries.values()) > self.entries:
            yield from self.spill(self.entries // 2)

    def _frequent(self, lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.ones(len(first), bool)
        for bit in pair_bits(lang, first, second, 8 * len(self.table)):
            out &= (self.table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        return out

    def spill(self, least: int) -> Iterator[tuple[str, int, bytes]]:
        """Sorted runs of the largest subtrees, one for each prefix partition they reach into, until ``least`` entries are left."""
        left = sum(t.size for t in self.tries.values())
        words = list(self.ids)
        rank = np.empty(len(words) + 1, np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        rank[-1] = -1  # no word
        firsts, others = np.array([*words, b""], object), np.array([*(b" " + w for w in words), b""], object)
        for lang in sorted(self.tries, key=lambda x: -self.tries[x].size):
            trie = self.tries[lang]
            before = trie.size
            containers = list(trie.spilled(max(0, least - (left - before))))
            left -= before - trie.size
            if before > trie.size:
                yield from self._runs(lang, containers, rank, firsts, others)
        if not left:
            self._new_ids()  # words of runs that are gone need no ids

    def finish(self) -> Iterator[tuple[str, int, bytes]]:
        yield from self.spill(0)
        if 1 in self.sizes:
            yield from ((lang, -1, n.to_bytes(8, "little")) for lang, n in self.totals.items())

    def _runs(self, lang: str, containers: list[dict[int, Counter]], rank: np.ndarray, firsts: np.ndarray, others: np.ndarray) -> Iterator[tuple[str, int, bytes]]:
        ids, counts = [], []
        for size in self.sizes:
            keys = [k for c in containers for k in c[size]]
            found = np.full((len(keys), max(self.sizes)), len(rank) - 1, np.int64)
            found[:, :size] = np.frombuffer(b"".join(keys), _PAIR).reshape(-1, size)
            ids.append(found)
            counts.append(np.array([n for c in containers for n in c[size].values()], np.int64))
        ids, count = np.concatenate(ids), np.concatenate(counts)
        hashes = np.append(self._hashes()[: len(rank) - 1], np.uint64(0))
        second = hashes[ids[:, 1]] if ids.shape[1] > 1 else np.zeros(len(ids), np.uint64)
        cell = (mixed(hashes[ids[:, 0]], second, 7) % np.uint64(self.cells)).astype(np.int64)
        order = np.lexsort([*(rank[ids[:, j]] for j in range(ids.shape[1] - 1, -1, -1)), cell])
        ids, count, cell = ids[order], count[order], cell[order]
        phrases = firsts[ids[:, 0]]
        for j in range(1, ids.shape[1]):
            phrases = phrases + others[ids[:, j]]
        phrases, press = phrases.tolist(), zstandard.ZstdCompressor(level=1)
        ends = (np.flatnonzero(np.diff(cell)) + 1).tolist()
        for start, stop in zip([0, *ends], [*ends, len(phrases)]):
            text, n = b"\n".join(phrases[start:stop]), count[start:stop]
            run = len(text).to_bytes(8, "little") + text + n.astype("<u4" if n.max() < 1 << 32 else "<u8").tobytes()
            yield lang, int(cell[start]), press.compress(run)


def pair_bits(lang: str, first: np.ndarray, second: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places in a table of ``bits`` bits for each pair of word hashes."""
    of = np.full(1, word_hash(lang.encode()), np.uint64)
    h = mixed(first ^ of, second, 3)
    return [(h % np.uint64(bits)).astype(np.int64), (mixed(h, of, 5) % np.uint64(bits)).astype(np.int64)]


def _merged(lang: str, runs: list[bytes], least: int, bits: int) -> pa.Table:
    """Phrases of a prefix partition with at least ``least`` occurrences, and the places of pairs in the bit table."""
    total: dict[bytes, int] = {}
    unpress = zstandard.ZstdDecompressor()
    for run in runs:
        raw = unpress.decompress(run)
        stop = 8 + int.from_bytes(raw[:8], "little")
        phrases = raw[8:stop].split(b"\n")
        counts = np.frombuffer(raw, "<u4" if len(raw) - stop == 4 * len(phrases) else "<u8", offset=stop).tolist()
        get = total.get
        for phrase, n in zip(phrases, counts):
            total[phrase] = get(phrase, 0) + n
    found = [(p, n) for p, n in total.items() if n >= least]
    parts = [p.split(b" ") for p, _ in found]
    places: list[list[int]] = [[] for _ in found]
    pairs = [i for i, w in enumerate(parts) if len(w) == 2]
    if pairs:
        first, second = (np.array([word_hash(parts[i][j]) for i in pairs], np.uint64) for j in (0, 1))
        for i, a, b in zip(pairs, *(x.tolist() for x in pair_bits(lang, first, second, bits))):
            places[i] = [a, b]
    return pa.table(
        {
            "lang": pa.array([lang] * len(found), pa.string()),
            "phrase": pa.array([p.decode() for p, _ in found], pa.string()),
            "words": pa.array([len(w) for w in parts], pa.int32()),
            "count": pa.array([n for _, n in found], pa.int64()),
            "bits": pa.array(places, pa.list_(pa.int64())),
        }
    )


def phrase_counts(
    docs: DataFrame, sizes: tuple[int, ...], least: int, cells: int, table: bytes | None = None, bits: int = 1 << 26,
    entries: int = 1_000_000, burst: int = 1 << 15,
) -> DataFrame:
    """``(lang, phrase, words, count, bits)`` of all runs of ``sizes`` words that occur ``least`` times or more in their language.

    ``docs`` holds ``lang`` and ``text``, without nulls. With a bit ``table`` of frequent pairs only runs whose pairs are all in it
    are counted. ``entries`` bounds a task's trie, ``cells`` is the number of prefix partitions. For each language a row with
    a null phrase and 0 words counts all words, if ``sizes`` holds 1.
    """

    spread = docs.sparkSession.sparkContext.broadcast(table) if table is not None else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Counting(sizes, cells, spread.value if spread is not None else None, entries, burst)
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            size = 0
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                by_lang.setdefault(lang, []).append(text.as_buffer().to_pybytes())
                size += len(by_lang[lang][-1])
                if size > SLICE:
                    yield from _batches(row for lang, texts in by_lang.items() for row in work.add(lang, b"\n".join(texts)))
                    by_lang, size = {}, 0
            yield from _batches(row for lang, texts in by_lang.items() for row in work.add(lang, b"\n".join(texts)))
        yield from _batches(work.finish())

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        lang, runs = key[0].as_py(), rows.column("run").to_pylist()
        if key[1].as_py() < 0:
            words = sum(int.from_bytes(run, "little") for run in runs)
            return pa.Table.from_pylist([{"lang": lang, "phrase": None, "words": 0, "count": words, "bits": []}], _merged(lang, [], least, bits).schema)
        return _merged(lang, runs, least, bits)

    runs = docs.select("lang", "text").mapInArrow(count, _RUN_SCHEMA)
    return runs.groupBy("lang", "cell").applyInArrow(merge, _COUNT_SCHEMA)


def _batches(rows: Iterator[tuple[str, int, bytes]]) -> Iterator[pa.RecordBatch]:
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += len(row[2])
        if size > 1 << 22 or len(kept) >= 5000:
            yield _batch(kept)
            kept, size = [], 0
    if kept:
        yield _batch(kept)


def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    lang, cell, run = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(cell, pa.int64()), pa.array(run, pa.binary())], ["lang", "cell", "run"])


def bit_table(counts: DataFrame, bits: int) -> bytes:
    """The bit table of all pairs in ``counts``: at most ``bits`` / 64 rows come to the driver, however many pairs there are."""
    place = counts.where(F.col("words") == 2).select(F.explode("bits").alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("word"))
    found = words.toArrow()
    out = np.zeros(bits // 64, "<u8")
    out[found.column("at").to_numpy()] = found.column("word").to_numpy().astype(np.int64).view(np.uint64)
    return out.tobytes()


def collocations(
    docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, absorbed: int = 80, bits: int = 1 << 26, entries: int = 1_000_000,
) -> DataFrame:
    """The ``top`` phrases of each language by how firmly their parts stick together: ``(lang, rank, phrase, a, l, r, n, score)``.

    Words are runs of anything but space and tab, in lower-cased (A-Z) pieces between ``. , ; : ! ?`` and line ends. Candidates have 2 to
    ``longest`` words and ``a`` >= ``least`` occurrences; ``l`` and ``r`` count the parts of the cut with the lowest
    floor(2000000 a / (l + r)), the first such; ``n`` counts all words of the language. A candidate that stands within a longer one of at
    least ``absorbed`` % of its occurrences is left out. Ranks go by score, then ``a``, both downwards, then phrase in byte order.

    Other columns are ignored. A null text is empty, a null language ``und``; repeated rows count each time; an empty table, or a
    language without candidates, gives no rows.

    ``entries`` bounds what a task's trie holds, a prefix partition holds about as many phrases as 6 MB of text, and the bit table has
    ``bits`` bits at any size: where very many pairs are frequent it holds back less, and results stay the same.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    cells = 1 + size // CELL
    short = settle(phrase_counts(texts, (1, 2), least, cells, bits=bits, entries=entries))
    long = settle(phrase_counts(texts, tuple(range(3, longest + 1)), least, cells, bit_table(short, bits), bits, entries)) if longest > 2 else short.limit(0)
    counts = short.unionByName(long).select("lang", "phrase", "words", F.col("count").alias("a"))

    words = F.split("phrase", " ")
    candidates = counts.where(F.col("words") >= 2)
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice(words, 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"),
    )
    firsts = counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products pass 64 bits
    scored = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"]).select(
        "lang", "phrase", "a", "k", "l", "r", exact("a").alias("a_"), (exact("l") + exact("r")).alias("parts_")
    ).withColumn("score", F.expr("cast((a_ * 2000000) div parts_ as bigint)"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.*")

    def parts(n):
        return F.transform(F.sequence(F.lit(0), F.col("words") - n), lambda start: F.array_join(F.slice(words, start + 1, n), " "))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), parts))
    holders = candidates.where(F.col("words") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
    holders = holders.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    held = exact("longer") * 100 >= exact("a") * absorbed
    free = best.join(holders, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~held)

    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = free.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    totals = counts.where(F.col("words") == 0).select("lang", F.col("a").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
