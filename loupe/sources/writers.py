"""Writing results and the manifest of a run."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by: str | None = None, kind: str = "parquet") -> None:
    """Parquet by default; CSV with a header on request. A partition column groups the files of a domain."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def write_run(tables: dict[str, DataFrame], folder: str, facts: dict) -> None:
    """All tables of a run below one folder, then the manifest; a folder without a manifest is an unfinished run."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}")
    text = json.dumps(facts | {"tables": sorted(tables)}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifest").first()[0])


def latest_run(spark: SparkSession, parent: str) -> str | None:
    """The newest folder below `parent` that has a manifest, through Hadoop's file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(parent)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return None
    runs = [s for s in fs.listStatus(path) if s.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "manifest/_SUCCESS"))]
    return str(max(runs, key=lambda s: (s.getModificationTime(), str(s.getPath()))).getPath()) if runs else None


def load_or_build(spark: SparkSession, folder: str, signature: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The table below a folder, and whether it had to be built: it is built where there is none or its manifest has another signature."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/_SUCCESS")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    fresh = there and read_manifest(spark, folder).get("signature") == signature
    if not fresh:
        write_run({"table": build()}, folder, {"signature": signature})
    return spark.read.parquet(f"{folder}/table"), not fresh


def write_state(spark: SparkSession, folder: str, state: dict) -> None:
    """A run's state as one line of JSON."""
    spark.createDataFrame([(json.dumps(state, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def read_state(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(folder).first()[0])


def contract_fault(df: DataFrame, columns: list[str]) -> str:
    """What a delivered table lacks, or nothing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        return "missing columns: " + ", ".join(missing)
    return "the table is empty" if df.isEmpty() else ""
