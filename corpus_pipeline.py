"""From raw documents to packed training sequences: five stages, each one operator of ``wayread.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayread.llm import minhash, mixing, packing, sentences, toxicity
from wayread.llm.common import read, settle

#: Score from which a document is rejected as toxic.
TOXIC = 0.3


def like(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` counted anew."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from labels that are not held out."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.scored(docs, model).where(F.col("toxicity_") < TOXIC).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id."""
    found = minhash.near_duplicates(docs, percent=80)
    copies = found.where(~F.col("kept")).select(F.col("doc_id").alias("copy_id"))
    return docs.join(copies, docs["doc_id"] == copies["copy_id"], "left_anti")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of sentences that came before."""
    return like(sentences.deduplicated(docs), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return like(mixing.mixed(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024."""
    return packing.packed(docs, capacity=1024, end=2)


STAGES = [
    ("toxicity", without_toxic),
    ("minhash", without_near_copies),
    ("substring_dedup", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

#: Tokens, sketches and draws have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before has written."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = settle(docs)
    return docs
