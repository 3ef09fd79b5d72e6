"""Structured Streaming: verdicts, judgments and documents that arrive over time.

Every micro-batch writes its own ``batch_id`` folder and replaces it when it is replayed, so a restarted query repeats nothing
and loses nothing. No state has to fit in memory.

Tables do not grow with the number of batches. Batches come in generations of ``FOLD``; the first batch of a generation folds
what is current into a base (``batch_id=-1``), and the others add to it. Two generations are kept, in two slots that replace
each other, so a batch reads at most one base and ``FOLD`` batches, and a replayed fold still finds what it folds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from wayread.constants import DEFAULT_THRESHOLD
from wayread.functions.scoring import needed
from wayread.functions.text import word_count
from wayread.operators.blocks import html_blocks
from wayread.operators.digest import reading_path, select_digest, signal_stats
from wayread.operators.judge import tidy_judgments
from wayread.operators.labels import LABEL_SCHEMA, label_counts
from wayread.operators.passages import passages_web

GROUP = ["doc_id", "question_id"]
ITEM = [*GROUP, "idx"]
JUDGED_SCHEMA = (
    "doc_id long, question_id long, idx int, page int, heading string, text string, p double, role string,"
    " role_p double, confidence double, run_id long"
)
PAGE_SCHEMA = "page_id long, url string, html string"
BUCKETS = 64
FOLD = 16
BASE = -1
CODEC = "zstd"
#: Bits of a table of places for each of them, and at the most (32 MB).
PLACE_BITS = 16
MOST_BITS = 2**28
#: Ends the files of a shuffle with the write they were made for, not when the driver happens to collect its garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stream_labels(spark: SparkSession, path: str, by: tuple[str, ...] = ("mode",)) -> DataFrame:
    """Running verdict counts of an append-only label table; write it with output mode ``complete``."""
    return label_counts(spark.readStream.schema(LABEL_SCHEMA).parquet(path), by)


def latest_runs(judged: DataFrame) -> DataFrame:
    """Rows of the newest run of each document and question; answers of older runs are stale.

    A window by document and question brings the rows of a run together, where all that follows finds them.
    """
    newest = F.max("run_id").over(Window.partitionBy(*GROUP))
    rows = judged.where(F.col(GROUP[0]).isNotNull() & F.col(GROUP[1]).isNotNull()).withColumn("_newest", newest)
    return rows.where(F.col("run_id") == F.col("_newest")).drop("_newest")


# --------------------------------------------------------------------------- tables that batches add to


def _slot(table: str, name: str, batch_id: int) -> str:
    """Folder of the generation that a batch belongs to."""
    return f"{table}/{name}/slot={batch_id // FOLD % 2}"


def _write(df: DataFrame, table: str, name: str, batch_id: int, *by: str) -> None:
    """Write one batch from where its rows are. Every task writes to the folders it has rows for; a fold brings these together."""
    to = f"{_slot(table, name, batch_id)}/batch_id={batch_id}"
    df.write.mode("overwrite").partitionBy(*by).option("compression", CODEC).parquet(to)


def _write_base(df: DataFrame, table: str, name: str, batch_id: int, *by: str) -> None:
    """Start the generation of ``batch_id`` with ``df``; what its slot held two generations ago goes.

    Rows are brought together by folder first; Spark splits a folder that is too large.
    """
    if by:
        df = df.hint("rebalance", *by)
    based = df.withColumn("batch_id", F.lit(BASE).cast("long"))
    based.write.mode("overwrite").partitionBy("batch_id", *by).option("compression", CODEC).parquet(_slot(table, name, batch_id))


def _generation(spark: SparkSession, table: str, name: str, batch_id: int, schema: str | StructType | None = None) -> DataFrame:
    """All rows of the generation of ``batch_id`` up to that batch, with ``batch_id`` and, if a schema is given, their place: ``file`` and ``row``."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.option("basePath", f"{table}/{name}").parquet(_slot(table, name, batch_id))
    if schema:
        rows = rows.select("*", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.drop("slot").withColumn("batch_id", F.col("batch_id").cast("long")).where(F.col("batch_id") <= batch_id)


def _newest(rows: DataFrame, marks: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that the newest batch of their key wrote; ``marks`` has a row for each key that a batch wrote anew."""
    newest = marks.groupBy(*key).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, [*key, "batch_id"], "left_semi").drop("batch_id")


def _fold(spark: SparkSession, table: str, names: Sequence[str], marks: str, key: Sequence[str], batch_id: int) -> None:
    """Bases of a new generation: of each key what the newest batch wrote."""
    if batch_id and batch_id % FOLD == 0:
        known = _generation(spark, table, marks, batch_id - 1)
        for name in names:
            _write_base(_newest(_generation(spark, table, name, batch_id - 1), known, key), table, name, batch_id)


def current(spark: SparkSession, table: str, name: str, marks: str = "signal", key: Sequence[str] = GROUP) -> DataFrame:
    """What is current of a table: of each key what its newest batch wrote. A key whose last batch left nothing has nothing."""
    last = spark.read.parquet(f"{table}/{marks}").agg(F.max("batch_id")).first()[0]
    return _newest(_generation(spark, table, name, last), _generation(spark, table, marks, last), key)


# --------------------------------------------------------------------------- judgments


def _bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*GROUP), F.lit(BUCKETS)).cast("int"))


def _held(judged: DataFrame) -> DataFrame:
    """One row for each item of the newest run: of the newest batch, and in that with the highest values in column order."""
    rest = [c for c in judged.columns if c not in ITEM and c != "batch_id"]
    rows = latest_runs(judged).groupBy(*ITEM).agg(F.max(F.struct("batch_id", *rest)).alias("_"))
    return rows.select(*ITEM, *[F.col(f"_.{c}").alias(c) for c in rest])


def _at_odds(judged: DataFrame) -> DataFrame:
    """Items of a run that come with several pages, headings or texts, found by hashes."""
    said = F.xxhash64(*[x for c in ("page", "heading", "text") for x in (c, F.isnull(c))])
    known = judged.where(reduce(and_, [F.col(c).isNotNull() for c in (*GROUP, "run_id")]))
    sayings = known.groupBy(*ITEM, "run_id").agg(F.min(said).alias("least"), F.max(said).alias("most"))
    return sayings.where(F.col("least") != F.col("most")).select(*ITEM, "run_id")


def _agreed(judged: DataFrame, odd: DataFrame) -> DataFrame:
    """Judgments, of the items ``odd`` only the one with the highest values in column order."""
    key = [*ITEM, "run_id"]
    rest = [c for c in judged.columns if c not in key]
    names = odd.select(*[F.col(c).alias(f"_{c}") for c in key])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    highest = judged.join(names, same, "left_semi").groupBy(*key).agg(F.max(F.struct(*rest)).alias("_")).select(*key, "_.*")
    return judged.join(names, same, "left_anti").unionByName(highest)


def _likely(judged: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """``judged`` without nearly all rows that are not among the ``n`` places of ``found``.

    A bit table tells, whose size is bounded at any ``n``; it errs only towards keeping.
    """
    slot = F.pmod(F.xxhash64("file", "row"), F.lit(max(1, min(PLACE_BITS * n, MOST_BITS))))
    part, at = F.bitmap_bucket_number("slot").alias("part"), F.bitmap_bit_position("slot")
    table = found.select(slot.alias("slot")).groupBy(part).agg(F.bitmap_construct_agg(at).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = judged.withColumn("slot", slot).select("*", part).join(F.broadcast(table), "part")
    return rows.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("slot", "part", "bits")


def _with_text(selected: DataFrame, judged: DataFrame) -> DataFrame:
    """Selected items, which are kept, with all that was judged with them, from their place in the table."""
    found = selected.select(*GROUP, "file", "row", "ord", "score", "label", "is_catch")
    return _likely(judged, found, found.count()).join(found, [*GROUP, "file", "row"])


def stream_judgments(
    spark: SparkSession, path: str, table: str, threshold: float = DEFAULT_THRESHOLD
) -> DataStreamWriter:
    """Keep reading paths and signal up to date while judgments arrive.

    Writes three tables under ``table``: ``judged``, ``paths`` and ``signal``. Judgments are tidied as recorded ones are; an
    item that comes twice counts once. Only runs touched by a batch are selected again; their buckets are the only
    partitions read. Read the results with ``current``.

    Items are written from where they arrive, with their number of words, and held and selected without their text: rows that
    differ only in judgments need none, and of an item that a batch brings with several texts one is written. Only text of
    selected items is shuffled, for the paths.
    """
    schema = f"{JUDGED_SCHEMA}, words long, batch_id long, bucket int"
    words = word_count(F.col("text")).cast("long")

    def update(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        session.conf.set(SHUFFLES_END, "true")  # the session is the stream's own
        if batch_id and batch_id % FOLD == 0:
            known = _generation(session, table, "judged", batch_id - 1, schema).drop("file", "row")
            _write_base(_held(known), table, "judged", batch_id, "bucket")
        _fold(session, table, ("paths", "signal"), "signal", GROUP, batch_id)

        arrived = tidy_judgments(batch)
        odd = _at_odds(arrived).persist(StorageLevel.DISK_ONLY)
        agreed = _agreed(arrived, odd) if odd.count() else arrived
        _write(_bucket(agreed.withColumn("words", words)), table, "judged", batch_id, "bucket")
        odd.unpersist()
        touched = batch.select(*GROUP).distinct()
        buckets = [r[0] for r in _bucket(touched).select("bucket").distinct().collect()]
        history = _generation(session, table, "judged", batch_id, schema).where(F.col("bucket").isin(buckets))
        slim = history.select(
            *ITEM, "run_id", "batch_id", "p", "role", "role_p", "confidence", F.coalesce("words", words).alias("words"), "file", "row"
        )
        # on the runs' key alone, as all that follows, and kept until both results are written
        rows = _held(slim.join(touched, GROUP, "left_semi")).persist(StorageLevel.DISK_ONLY)
        _write(signal_stats(rows, threshold), table, "signal", batch_id)
        selected = select_digest(rows, threshold).persist(StorageLevel.DISK_ONLY)
        able = history.where((F.col("p") >= threshold) & needed(F.col("role")))
        _write(reading_path(_with_text(selected, able)), table, "paths", batch_id)
        selected.unpersist()
        rows.unpersist()

    return spark.readStream.schema(JUDGED_SCHEMA).parquet(path).writeStream.foreachBatch(update)


# --------------------------------------------------------------------------- pages


def _last_sent(pages: DataFrame) -> DataFrame:
    """One row for each page of a batch; of several the one with the greatest values, in column order."""
    rest = [c for c in pages.columns if c != "page_id"]
    return pages.groupBy("page_id").agg(F.max(F.struct(*rest)).alias("_")).select("page_id", "_.*")


def stream_documents(spark: SparkSession, path: str, table: str, schema: str | StructType = PAGE_SCHEMA) -> DataStreamWriter:
    """Cut pages into passages as they arrive: tables ``pages`` and ``passages``.

    A page that is sent again replaces all its passages, also by none. Read them with ``current_passages``.
    """

    def cut(batch: DataFrame, batch_id: int) -> None:
        _fold(batch.sparkSession, table, ("passages", "pages"), "pages", ["page_id"], batch_id)
        pages = _last_sent(batch)
        _write(passages_web(html_blocks(pages)), table, "passages", batch_id)
        _write(pages.select("page_id"), table, "pages", batch_id)

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(cut)


def current_passages(spark: SparkSession, table: str) -> DataFrame:
    return current(spark, table, "passages", "pages", ["page_id"])


def stream_digests(
    spark: SparkSession, path: str, table: str, judged: Callable[[DataFrame], DataFrame], threshold: float = DEFAULT_THRESHOLD,
    schema: str | StructType = PAGE_SCHEMA,
) -> DataStreamWriter:
    """Judge pages as they arrive: tables ``pages``, ``judged``, ``paths`` and ``signal``, all by ``doc_id``, the page's id.

    ``judged`` gives the judged items of passages, for example ``judge`` of ``wayread.plans.runs`` with its runs, questions and a
    store; it sees the pages of one batch. A page sent again replaces all it had. Read the tables with ``current_digests``.
    """

    def digest(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        _fold(session, table, ("judged", "paths", "signal", "pages"), "pages", ["doc_id"], batch_id)
        pages = _last_sent(batch)
        _write(judged(passages_web(html_blocks(pages)).withColumnRenamed("page_id", "doc_id")), table, "judged", batch_id)
        items = session.read.parquet(f"{_slot(table, 'judged', batch_id)}/batch_id={batch_id}")  # judged once
        _write(signal_stats(items, threshold), table, "signal", batch_id)
        _write(reading_path(select_digest(items, threshold)), table, "paths", batch_id)
        _write(pages.select(F.col("page_id").alias("doc_id")), table, "pages", batch_id)

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(digest)


def current_digests(spark: SparkSession, table: str, name: str) -> DataFrame:
    return current(spark, table, name, "pages", ["doc_id"])
