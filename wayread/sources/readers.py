"""Tables the engine reads. Columns are named, so scans read nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "struct<text: string, quad: array<double>, size: double, bold: boolean>"
LAYOUT_SCHEMA = (
    "doc_id long, page int, number int, x0 double, y0 double, x1 double, y1 double, page_y0 double, page_y1 double,"
    f" lines array<{LINE}>"
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Web pages: ``(page_id, url, html)``."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text documents: ``(doc_id, text)``."""
    return spark.read.parquet(path).select("doc_id", "text")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as documents: ``(doc_id, path, text)``; the id is a hash of the path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def read_binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files for their identity: ``(doc_id, path, content)``."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), "content")
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def read_layout_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Extracted layout blocks of paged documents."""
    return spark.read.schema(LAYOUT_SCHEMA).parquet(path)


def read_questions(spark: SparkSession, path: str, key: str = "item_id", text: str = "text") -> DataFrame:
    """Question table: ``(question_id, question)``."""
    return spark.read.parquet(path).select(F.col(key).alias("question_id"), F.col(text).alias("question"))


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """Conversation turns as items of one document per conversation: ``(doc_id, idx, text, role)``."""
    return spark.read.parquet(path).select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text", F.col("role").alias("speaker")
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    from wayread.operators.labels import LABEL_SCHEMA

    return spark.read.schema(LABEL_SCHEMA).parquet(path)
