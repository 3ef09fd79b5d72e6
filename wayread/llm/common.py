"""Helpers the operators share: tables that outlive executors, and counts taken before a plan is built."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayread.plans.lineage import ensure_checkpoint_dir

#: Words of the contracts: runs of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def settle(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Lineage ends there: a lost executor repeats only what reads the table. The folder is removed when the session ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def draw(*columns, seed: int):
    """A number in [0, 1) that depends on nothing but the columns and the seed."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def kept_in_worker(key: str, build):
    """``build()``, once for each Python worker: what is kept outlives the task, as workers are used again."""
    import sys
    import types

    store = sys.modules.setdefault("wayread_worker", types.ModuleType("wayread_worker")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def free(name: str, columns) -> str:
    """``name``, or with underscores behind it until no column is called so; letter case makes no other name."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
