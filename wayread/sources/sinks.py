"""Tables and files the engine writes, but for judgments (see ``store``). Spark's committer makes each write all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _mode(force: bool) -> str:
    return "overwrite" if force else "errorifexists"


def write_manifest(manifests: DataFrame, path: str, force: bool = False) -> None:
    """One JSON line per run; nulls are written, so every line has every field."""
    lines = manifests.select(F.to_json("manifest", {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode(_mode(force)).text(path)


def append_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("append").parquet(path)


def export_labels(labels: DataFrame, path: str, force: bool = False) -> None:
    labels.write.mode(_mode(force)).option("ignoreNullFields", "false").json(path)
