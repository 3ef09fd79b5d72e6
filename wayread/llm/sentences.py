"""Substring deduplication by sliding spans of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayread.llm.common import free

#: Where a sentence ends: marks and the space after them, or a line break with the space around it.
BREAK = re.compile(r"[.!?…]+\s+|[。！？｡．।॥؟۔።፧፨។៕᠃᠉⸮]+[。！？｡．।॥؟۔!?…」』”’）)\]】》〉]*\s*|\s*\n\s*")
_BASE = np.uint64(0xD6E8FEB86659FD93)


def split(text: str) -> list[str]:
    """Sentences with the space after them; joined they are the text."""
    cuts = [0, *(m.end() for m in BREAK.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


def runs(sentences: list[str], sentences_least: int, words_least: int, characters_least: int = 80) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last sentence of every run.

    From each sentence on, and up to each sentence, the shortest run of at least ``sentences_least`` sentences and
    ``words_least`` words or ``characters_least`` characters, as some scripts put no space between words; and each sentence
    that holds twice as many. Case and space do not count.
    """
    words = [s.lower().split() for s in sentences]
    n = len(words)
    count = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    length = np.concatenate([[0], np.cumsum([sum(map(len, w)) for w in words])])
    h = np.fromiter((xxhash.xxh3_64_intdigest(" ".join(w)) for w in words), np.uint64, n)
    with np.errstate(over="ignore"):
        power, prefix = np.ones(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        power[1:] = np.cumprod(np.full(n, _BASE))
        # prefix[k] = sum of h[i] * B^(k-1-i), by sums of h[i] * B^-i
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, inverse))])
        prefix[1:] = np.cumsum((h + np.uint64(1)) * down[1:])
        at = np.arange(n)
        measures = ((count, words_least), (length, characters_least))
        end = np.minimum(*(np.searchsorted(m, m[:-1] + least) - 1 for m, least in measures))
        end = np.maximum(end, at + sentences_least - 1)  # last of the run from i
        start = np.maximum(*(np.searchsorted(m, m[1:] - least, side="right") - 1 for m, least in measures))
        start = np.minimum(start, at - sentences_least + 1)  # first of the run up to i
        long = np.flatnonzero((np.diff(count) >= 2 * words_least) | (np.diff(length) >= 2 * characters_least))
        fits, back = end < n, start >= 0
        first = np.concatenate([at[fits], start[back], long])
        last = np.concatenate([end[fits], at[back], long])
        pairs = np.unique(first * (n + 1) + last)
        first, last = pairs // (n + 1), pairs % (n + 1)
        key = (prefix[last + 1] - prefix[first]) * power[first]
        key ^= key >> np.uint64(29)
        key = key * np.uint64(0xBF58476D1CE4E5B9) + (last - first).astype(np.uint64)
        key ^= key >> np.uint64(32)
    return key, first.astype(np.uint32), last.astype(np.uint32)


ENTRY = np.dtype([("key", "<u8"), ("doc", "<i8"), ("first", "<u4"), ("last", "<u4")])


def _later(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries by key and order of appearance; which of them are not the first of their key."""
    entries = entries[np.lexsort((entries["first"], entries["doc"], entries["key"]))]
    new = np.ones(len(entries), bool)
    new[1:] = entries["key"][1:] != entries["key"][:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(entries)), 0))
    # a repeated row brings the same place again, which makes no run a repeat
    return entries, (entries["doc"] != entries["doc"][lead]) | (entries["first"] != entries["first"][lead])


def repeated_spans(documents: DataFrame, sentences_least: int = 2, words_least: int = 16, characters_least: int = 80) -> DataFrame:
    """``documents`` (doc_id, text) -> (doc_id, first, last): runs of sentences that are not the first of their kind.

    First is by doc_id, then by place. A task settles what repeats among its own rows and sends one entry per kind,
    packed by the hash's residue; so a run that a third of all documents hold arrives once per batch.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = 2 * parts

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, ENTRY)]
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = text.as_py()
                if doc is None or not text:
                    continue
                key, first, last = runs(split(text), sentences_least, words_least, characters_least)
                rows = np.empty(len(key), ENTRY)
                rows["key"], rows["doc"], rows["first"], rows["last"] = key, doc, first, last
                found.append(rows)
            entries, later = _later(np.concatenate(found))
            known, sent = entries[later], entries[~later]
            to = (sent["key"] % np.uint64(dealt)).astype(np.int64)
            order = np.lexsort((sent["first"], sent["doc"], to))
            sent, to = sent[order], to[order]
            ends = np.searchsorted(to, np.arange(dealt + 1))
            blobs = [(d, sent[a:b].tobytes()) for d, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
            blobs += [(-1 - int(known["doc"][0] % dealt), known.tobytes())] if len(known) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([b[0] for b in blobs], pa.int64()), pa.array([b[1] for b in blobs], pa.binary())], names=["to", "entries"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known = [np.zeros(0, ENTRY)], []
        for batch in batches:
            for to, blob in zip(batch["to"].to_pylist(), batch["entries"]):
                (found if to >= 0 else known).append(np.frombuffer(blob.as_buffer(), ENTRY))
        entries, later = _later(np.concatenate(found))
        for rows in [entries[later], *known]:
            for at in range(0, len(rows), 50_000):
                part = rows[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part["doc"]), pa.array(part["first"].astype(np.int32)), pa.array(part["last"].astype(np.int32))],
                    names=["doc_id", "first", "last"])

    packed = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(gather, "to long, entries binary")
    return packed.repartition(parts, "to").mapInArrow(match, "doc_id long, first int, last int")


def deduplicated(documents: DataFrame, sentences_least: int = 2, words_least: int = 16, characters_least: int = 80) -> DataFrame:
    """``documents`` with repeated runs of sentences taken out of ``text``, and with ``sentences_`` and ``removed_``, their counts.

    A sentence goes if any run over it has been seen before, in a smaller doc_id or further up. What stays is joined as it
    stood, so a document without repeats does not change by a byte. Runs need ``sentences_least`` sentences and
    ``words_least`` words or ``characters_least`` characters, or one sentence of twice as many: shorter phrases that repeat
    are left alone.

    Null and empty texts stay as they are. A text all of which was seen before becomes empty; its row stays. Rows with null
    ids stay unchanged. Rows that share an id count as one document. All other columns pass through, whatever their names;
    columns already called ``sentences_`` or ``removed_`` are replaced. An empty table stays empty.
    """
    spans = repeated_spans(documents, sentences_least, words_least, characters_least)
    # per document the runs are no more than three per sentence of it
    documents = documents.drop("sentences_", "removed_")
    key, held = free("key_", documents.columns), free("spans_", documents.columns)
    spans = spans.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("first", "last")).alias(held))
    joined = documents.join(spans, documents["doc_id"].cast("long") == F.col(key), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = [], [], []
            for text, spans in zip(batch["text"], batch[held]):
                text, spans = text.as_py(), spans.as_py()
                parts = split(text) if text else []
                drop = np.zeros(len(parts) + 1, np.int64)
                for s in spans or []:
                    if s["first"] < len(parts):
                        drop[s["first"]] += 1
                        drop[min(s["last"] + 1, len(parts))] -= 1
                drop = np.cumsum(drop[:-1]) > 0
                texts.append("".join(p for p, d in zip(parts, drop) if not d) if drop.any() else text)
                total.append(len(parts))
                gone.append(int(drop.sum()))
            out = {c: batch[c] for c in names} | {"text": pa.array(texts, pa.string()), "sentences_": pa.array(total, pa.int32()), "removed_": pa.array(gone, pa.int32())}
            yield pa.RecordBatch.from_pydict(out)

    names = documents.columns
    schema = documents.withColumn("text", F.col("text").cast("string")).schema.add("sentences_", T.IntegerType()).add("removed_", T.IntegerType())
    return joined.drop(key).mapInArrow(cut, schema)
