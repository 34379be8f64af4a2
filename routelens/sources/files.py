"""Files: CSV in and out, manifests and bundles (S5, S7, S9-S13). All paths are Spark's."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, wanted: list[str], most_rows: int | None = None) -> DataFrame:
    """The wanted columns that the header has, as text, of at most so many rows."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    found = [c for c in wanted if c in df.columns]
    if not found:
        raise ValueError("no wanted column exists")
    df = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in found))
    return df if most_rows is None else df.limit(most_rows)


def write_csv(df: DataFrame, path: str) -> int:
    """Writes CSV parts with a header, one with the header alone if there is no row; returns the number of rows."""
    df.write.csv(path, header=True, escape='"', mode="errorifexists")
    n = df.sparkSession.read.csv(path, header=True, multiLine=True, escape='"').count() if df.columns else 0
    if not n:
        header = df.sparkSession.createDataFrame([(",".join(df.columns),)], "value string")
        header.coalesce(1).write.mode("overwrite").text(path)
    return n


def save_bundle(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes each table as Parquet under the folder, and a manifest (name, path, n_rows, n_columns) as JSON, which it returns."""
    spark, rows = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        path = f"{folder}/{name}"
        df.write.parquet(path)
        rows.append((name, path, spark.read.schema(df.schema).parquet(path).count(), len(df.columns)))  # from the files' footers
    manifest = spark.createDataFrame(rows, "name string, path string, n_rows long, n_columns int")
    manifest.coalesce(1).write.json(f"{folder}/manifest")
    return manifest


def load_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a bundle by name."""
    listed = spark.read.schema("name string, path string, n_rows long, n_columns int").json(f"{folder}/manifest").collect()
    return {r.name: spark.read.parquet(r.path) for r in sorted(listed)}


def file_report(spark: SparkSession, folder: str, expected: list[str]) -> DataFrame:
    """name, found, and bytes of each expected table of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    names = spark.createDataFrame([(n,) for n in expected], "name string")
    sized = files.select(F.regexp_extract("path", r"/([A-Za-z_0-9]+)(?:\.parquet)?(?:/[^/]*)?$", 1).alias("name"), "length").groupBy("name").agg(F.sum("length").alias("bytes"))
    return F.broadcast(names).join(sized, "name", "left").select("name", F.col("bytes").isNotNull().alias("found"), "bytes")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder among those that driver and executors share, by spark.checkpoint.dir. Where that is unset, a local one in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
