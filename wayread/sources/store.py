"""The judgment store: replies and failures of earlier runs, kept by outcome and key prefix.

``<path>/answers/version=N/outcome=…/prefix=…`` holds one row for each call. A run reads only the prefixes of its own keys.
``compact`` writes the newest outcome of each key as a new version, and ``<path>/versions`` names the one that holds: a version
counts from the moment its name is written. One run or compaction writes at a time; readers may read along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CALL_SCHEMA = (
    "request_key string, answers string, input_tokens long, output_tokens long, model string, error string"
)
STORE_SCHEMA = f"{CALL_SCHEMA}, written_at timestamp, outcome string, prefix string"
DONE, FAILED = "done", "failed"


def key_prefix(key: Column) -> Column:
    """Folder of a key: 256 of them, as keys are hashes in hexadecimal."""
    return F.substring(key, 1, 2)


def _empty(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in STORE_SCHEMA.split(", "))])


def current_version(spark: SparkSession, path: str) -> int:
    """The version that holds; a store that does not exist yet is made, with an empty version 0."""
    _empty(spark).write.mode("ignore").partitionBy("outcome", "prefix").parquet(_answers(path, 0))
    spark.range(1).select(F.col("id").alias("version")).write.mode("ignore").parquet(f"{path}/versions")
    return spark.read.schema("version long").parquet(f"{path}/versions").agg(F.max("version")).first()[0]


def _answers(path: str, version: int) -> str:
    return f"{path}/answers/version={version}"


def prefixes_of(keys: DataFrame) -> list[str]:
    """Prefixes of the keys of a run, at most 256."""
    return sorted(r[0] for r in keys.select(key_prefix(F.col("request_key"))).distinct().collect())


def read_calls(spark: SparkSession, path: str, prefixes: list[str] | None = None) -> DataFrame:
    """All calls on record with these key prefixes."""
    calls = spark.read.schema(STORE_SCHEMA).parquet(_answers(path, current_version(spark, path)))
    return calls if prefixes is None else calls.where(F.col("prefix").isin(prefixes))


def latest_calls(calls: DataFrame) -> DataFrame:
    """One call for each key: the newest that was answered, else the newest; ties go to the greatest reply."""
    kept = [c for c in calls.columns if c != "request_key"]
    rank = F.struct(F.col("answers").isNotNull(), "written_at", "answers", "error")
    return calls.groupBy("request_key").agg(F.max_by(F.struct(*kept), rank).alias("call")).select("request_key", "call.*")


def append_calls(calls: DataFrame, path: str) -> None:
    """Add calls, answered or failed, with the time of writing. Rows of a folder are brought together first."""
    spark = calls.sparkSession
    rows = calls.withColumns({
        "written_at": F.current_timestamp(),
        "outcome": F.when(F.col("answers").isNotNull(), DONE).otherwise(FAILED),
        "prefix": key_prefix(F.col("request_key")),
    })
    rows.hint("rebalance", "outcome", "prefix").write.mode("append").partitionBy("outcome", "prefix").parquet(
        _answers(path, current_version(spark, path))
    )


def compact(spark: SparkSession, path: str) -> int:
    """Write the newest call of each key as the next version and make it hold; gives its number.

    Replies that were overwritten and failures that were answered since stay behind in the old version, which can be deleted
    once nobody reads it. A compaction that broke off leaves nothing that counts and is written anew by the next.
    """
    version = current_version(spark, path) + 1
    newest = latest_calls(read_calls(spark, path)).hint("rebalance", "outcome", "prefix")
    newest.write.mode("overwrite").partitionBy("outcome", "prefix").parquet(_answers(path, version))
    spark.range(version, version + 1).select(F.col("id").alias("version")).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def failed_windows(keys: DataFrame, path: str) -> DataFrame:
    """Windows that were asked but never answered: ``doc_id, question_id, window_no, request_key, error, failures, failed_at``.

    ``keys`` are the windows of a run with their request keys. The next run over the store asks them again.
    """
    calls = read_calls(keys.sparkSession, path, prefixes_of(keys))
    open_ = calls.where(F.col("outcome") == FAILED).join(calls.where(F.col("outcome") == DONE).select("request_key"), "request_key", "left_anti")
    failures = open_.groupBy("request_key").agg(
        F.max_by("error", F.struct("written_at", "error")).alias("error"), F.count("*").alias("failures"), F.max("written_at").alias("failed_at")
    )
    return keys.select("doc_id", "question_id", "window_no", "request_key").join(failures, "request_key")
