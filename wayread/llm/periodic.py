"""Periodic runs: every maximal repetition of words in a text, and the text without the repetitions.

A run with period q shows at one of the points 0, q, 2q ... at least: the word there stands again q words later. From such points
runs are measured by the longest common extension of two places. Extensions come from the order of a sample of the text's
suffixes, those at places of a difference cover: any two places reach sampled ones after the same few words, which are compared,
and from there on the least value of a range of common prefixes says how far the suffixes agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: A difference cover of 32; each difference mod 32 is one of two members.
CYCLE, COVER = 32, (0, 1, 2, 3, 7, 11, 19)
#: Words that tasks take up at once, and bytes of a text that are split at once.
WORDS, SLICE = 200_000, 1 << 20
#: Points that are measured at once.
POINTS = 1 << 20

_GAP = re.compile(rb"[ \t-\r]")


def _shifts() -> np.ndarray:
    """For two places mod CYCLE the words until both are in the cover."""
    inside = np.isin(np.arange(2 * CYCLE) % CYCLE, COVER)
    table = np.zeros((CYCLE, CYCLE), np.int64)
    for a in range(CYCLE):
        for b in range(CYCLE):
            table[a, b] = np.flatnonzero(inside[a : a + CYCLE] & inside[b : b + CYCLE])[0]
    return table


class Extensions:
    """Longest common extensions to the right between places of one text.

    ``words`` holds the texts' word numbers one after another, each text closed by a number of its own, ``text`` the number of
    the text at each place.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.size = len(words)
        # behind the end nothing is like anything else
        self.words = np.concatenate([words, words.max(initial=0) + 1 + np.arange(CYCLE)])
        self.shift, self.per = _shifts(), len(COVER)
        self.number = np.full(CYCLE, -1)
        self.number[list(COVER)] = np.arange(self.per)
        places = (np.arange(0, self.size, CYCLE)[:, None] + np.array(COVER)).ravel()
        self.places = places[places < self.size]
        self._sort(text[self.places])
        self._ranges()

    def _sort(self, text: np.ndarray) -> None:
        """Sort the sampled suffixes of each text; find how many words neighbours share."""
        m = len(self.places)
        self.order, self.slot = np.arange(m), np.zeros(m, np.int64)
        self.common = np.zeros(m, np.int32)
        first = np.flatnonzero(np.diff(text, prepend=-1))
        self.slot = np.repeat(first, np.diff(first, append=m))  # first slot of the class: texts so far
        open_ = np.arange(m)
        for offset in range(CYCLE):
            open_, _ = self._refine(open_, self.words[self.places[self.order[open_]] + offset], offset)
        levels = []
        while len(open_):
            levels.append(self.slot.astype(np.int32))
            ahead = self.per << (len(levels) - 1)
            open_, split = self._refine(open_, self.slot[self.order[open_] + ahead], None)
            self.common[split] = self._agreeing(levels, self.order[split - 1], self.order[split])

    def _refine(self, open_: np.ndarray, value: np.ndarray, shared: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Split the classes in the slots ``open_`` by ``value``; gives the slots still in classes of several and those where one was split."""
        if not len(open_):
            return open_, open_
        items = self.order[open_]
        old = self.slot[items]
        by = np.lexsort((value, old))
        items, old, value = items[by], old[by], value[by]
        self.order[open_] = items
        new_class = np.diff(old, prepend=-1) != 0
        parted = ~new_class & (np.diff(value, prepend=value[0]) != 0)
        starts = new_class | parted
        self.slot[items] = open_[np.maximum.accumulate(np.where(starts, np.arange(len(items)), 0))]
        split = open_[parted]
        if shared is not None:
            self.common[split] = shared
        alone = starts & np.append(starts[1:], True)
        return open_[~alone], split

    def _agreeing(self, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that sampled suffixes share, by classes of equal beginnings of doubling length."""
        a, b, m = a.copy(), b.copy(), len(self.places)
        n = np.zeros(len(a), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            same = levels[level][np.minimum(a, m - 1)] == levels[level][np.minimum(b, m - 1)]
            step = same.astype(np.int64) << level
            a, b, n = a + step * self.per, b + step * self.per, n + step * CYCLE
        return n + self._compared(self.places[a], self.places[b], np.full(len(a), CYCLE))

    def _compared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that two places share, up to ``most``, one by one."""
        n, on, offset = np.zeros(len(a), np.int64), np.flatnonzero(most > 0), 0
        while len(on):
            on = on[self.words[a[on] + offset] == self.words[b[on] + offset]]
            offset += 1
            n[on] = offset
            on = on[most[on] > offset]
        return n

    def _ranges(self) -> None:
        """Least common prefixes over ranges of 1, 2, 4 ... slots."""
        self.least = [self.common]
        while (1 << len(self.least)) <= len(self.common):
            below, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(below[:-half], below[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words from the different places ``a`` and ``b`` on that are the same."""
        few = self.shift[a % CYCLE, b % CYCLE]
        n = self._compared(a, b, few)
        far = np.flatnonzero(n == few)
        if len(far):
            x, y = a[far] + few[far], b[far] + few[far]
            i, j = (self.slot[(p // CYCLE) * self.per + self.number[p % CYCLE]] for p in (x, y))
            low, high = np.minimum(i, j) + 1, np.maximum(i, j)
            level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
            for at in np.unique(level):
                of = np.flatnonzero(level == at)
                n[far[of]] += np.minimum(self.least[at][low[of]], self.least[at][high[of] + 1 - (1 << int(at))])
        return n


def points(words: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of the harmonic grid of one text where the word stands again one period later.

    The grid of period q has a point every max(q, ``least`` - q) words: a run of max(``least``, 2q) words or more has one of
    them in all but its last q words. Small periods are gone through one by one, large ones point by point for all periods.
    """
    n = len(words)
    small = min(n // 2, max(least, int(n**0.5)))
    for q in range(1, small + 1):
        step = max(q, least - q)
        at = np.flatnonzero(words[: n - q : step] == words[q::step])
        if len(at):
            yield at * step, np.full(len(at), q)
    for k in range(n):
        last = min(n // 2, (n - 1) // (k + 1))
        if last <= small:
            break
        q = np.arange(small + 1, last + 1)
        at = np.flatnonzero(words[k * q] == words[(k + 1) * q])
        if len(at):
            yield k * q[at], q[at]


def _measured(same: Extensions, at: np.ndarray, period: np.ndarray, begin: np.ndarray, least: int) -> np.ndarray:
    """Runs ``(start, end, period)`` that show at the points ``at`` first; ``begin`` is where their text begins."""
    step = np.maximum(period, least - period)
    right = same(at, at + period)
    short = np.maximum(step - right, 0)  # words missing to the right must be there to the left
    on = np.flatnonzero(at - short >= begin)
    need = on[short[on] > 0]
    fails = need[same(at[need] - short[need], at[need] - short[need] + period[need]) < short[need]]
    on = np.setdiff1d(on, fails, assume_unique=True)
    before = on[at[on] - step[on] >= begin[on]]
    seen = before[same(at[before] - step[before], at[before] - step[before] + period[before]) >= step[before]]
    on = np.setdiff1d(on, seen, assume_unique=True)  # shows at the point before, too
    at, period, right, low = at[on], period[on], right[on], short[on]
    high = np.minimum(step[on] - 1, at - begin[on])
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_] + 1) // 2
        place = at[open_] - middle
        fits = same(place, place + period[open_]) >= middle
        low[open_[fits]] = middle[fits]
        high[open_[~fits]] = middle[~fits] - 1
    return np.stack([at - low, at + period + right, period], axis=1)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Runs by start, end; of those with the same ends the one of the smallest period, as the others are its multiples."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.append(True, np.any(runs[1:, :2] != runs[:-1, :2], axis=1))] if len(runs) else runs


def runs_of(texts: list[np.ndarray], least: int = 12) -> list[np.ndarray]:
    """Runs ``(start, length, period)`` of each text of word numbers from 0 on, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    number = max((int(t.max(initial=0)) for t in texts), default=0) + 1
    words = np.concatenate([np.append(t, number + i) for i, t in enumerate(texts)])
    same: Extensions | None = None
    found, waiting, size = [], [], 0

    def measure() -> None:
        nonlocal same, waiting, size, found
        if waiting:
            same = same or Extensions(words, np.repeat(np.arange(len(texts)), sizes + 1))
            of, at, period = (np.concatenate(x) for x in zip(*waiting))
            found = [_smallest(np.concatenate([*found, _measured(same, at + begins[of], period, begins[of], least)]))]
        waiting, size = [], 0

    for i, text in enumerate(texts):
        for at, period in points(text, least) if len(text) >= least else ():
            waiting.append((np.full(len(at), i), at, period))
            size += len(at)
            if size > POINTS:
                measure()
    measure()
    runs = found[0] if found else np.zeros((0, 3), np.int64)
    of = np.searchsorted(begins, runs[:, 0], side="right") - 1
    runs = np.stack([runs[:, 0] - begins[of], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    order = np.lexsort((runs[:, 2], runs[:, 0], of))
    return np.split(runs[order], np.searchsorted(of[order], np.arange(1, len(texts))))


def kept_words(size: int, runs: np.ndarray) -> np.ndarray:
    """Which words stand in no run behind its first period."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


class _Numbers:
    """Numbers of the words of some texts."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        known, get, parts, at = self.known, self.known.get, [], 0
        while at < len(text):
            found = _GAP.search(text, at + SLICE) if len(text) - at > SLICE else None
            stop = found.start() if found else len(text)
            words = text[at:stop].split()  # of bytes: at the contracts' white space
            parts.append(np.array([i if (i := get(w)) is not None else known.setdefault(w, len(known)) for w in words], np.int32))
            at = stop
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """The runs of every text: ``(key, n_words, runs, collapsed)``, a row for each row of ``docs``.

    Words are runs of anything but space, tab, line feed, vertical tab, form feed and return. A run is a stretch of words with
    smallest period q, at least ``least`` and 2q words long, that no neighbouring word extends with that period. ``runs`` holds
    ``(start, length, period)`` in words, by start, then period, ``collapsed`` the words that stand in no run behind its first
    period, joined by one space.

    A null or empty text has no words, no runs and an empty ``collapsed``. Repeated rows and null keys are rows like any other,
    other columns are ignored, an empty table gives no rows. There is no shuffle: texts have nothing to do with each other. A
    text is held whole by its task, in about 60 bytes a word at the most.
    """
    run = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
    schema = StructType([StructField("key", docs.schema[key].dataType), StructField("n_words", LongType()), StructField("runs", ArrayType(run)), StructField("collapsed", StringType())])

    def rows(keys: list, texts: list[bytes]) -> pa.RecordBatch:
        numbers = _Numbers()
        coded = [numbers.of(t) for t in texts]
        known, found = list(numbers.known), runs_of(coded, least)
        out = []
        for words, runs in zip(coded, found):
            left = words[kept_words(len(words), runs)] if len(runs) else words
            out.append(b" ".join([known[w] for w in left.tolist()]))
        every = np.concatenate(found)
        structs = pa.StructArray.from_arrays([pa.array(every[:, j], pa.int64()) for j in range(3)], ["start", "length", "period"])
        offsets = pa.array(np.cumsum([0, *(len(r) for r in found)]), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(keys), pa.array([len(w) for w in coded], pa.int64()), pa.ListArray.from_arrays(offsets, structs), pa.array(out, pa.binary()).cast(pa.string())],
            ["key", "n_words", "runs", "collapsed"],
        )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, texts, size = 0, [], 0
            for i, value in enumerate(batch.column(1)):
                texts.append(value.as_buffer().to_pybytes() if value.is_valid else b"")
                size += len(texts[-1])
                if size > 6 * WORDS or i == batch.num_rows - 1:
                    yield rows([batch.column(0)[begin : i + 1]], texts)
                    begin, texts, size = i + 1, [], 0

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(find, schema)
    return out.withColumnRenamed("key", key)
