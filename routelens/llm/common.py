"""Shared helpers: reading the tables, the shared folder, and skew-proof joins."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key with at least this share of all rows is heavy; so at most 1 / HEAVY_SHARE keys are.
HEAVY_SHARE = 0.001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where that is unset, a local one in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of the batches in which rows reach a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow in batches of BATCH_BYTES: for each task, executor and worker hold one whole, of 64 MB by Spark's default.

    The limit is set for the session, unless it has one of its own.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_LIMIT, None) is None:
        conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind as it takes to be no column of df."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


#: A table of ids of up to so many rows is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 250_000


def broadcast_if_small(ids: DataFrame) -> DataFrame:
    """ids (a saved table with narrow rows), with a broadcast hint if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def cumulative_hash_fraction(*cols) -> F.Column:
    """A deterministic number in [0, 1) from the given columns, for sampling."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def held_out(doc_id: F.Column) -> F.Column:
    """True for the fold that no model may learn from: crc32 of doc_id as text, modulo 5, is 0."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5) == 0


def sample_rows(
    docs: DataFrame, labels: DataFrame, per_class: int, most_bytes: int, doc_id: str = "doc_id", text: str = "text", more: tuple[str, ...] = ()
) -> DataFrame | None:
    """doc_id, text, label and more of about per_class rows of each label, drawn by a hash of doc_id; None if there are no labels.

    labels: doc_id and label. Rows of the held-out fold, null labels and texts over most_bytes are not drawn, so that there are
    at most (number of labels) x per_class x most_bytes bytes, up to the sampling error.
    """
    usable = labels.where(F.col("label").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "label")
    counts = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == F.lit(label), F.lit(min(1.0, per_class / n))).otherwise(share)
    drawn = usable.where(cumulative_hash_fraction(F.lit(29), "doc_id") < share).select(F.col("doc_id").alias("__id"), F.col("label").alias("__label"))
    rows = docs.where(F.octet_length(text) <= most_bytes).select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text"), *more)
    return rows.join(F.broadcast(drawn), F.col("__doc") == F.col("__id")).select("__doc", "__text", "__label", *more)


def _ordered(rows: Iterable[tuple]) -> list[tuple]:
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: (r[0], str(r[2]), r[1]))]


def bounded_sample(
    docs: DataFrame, labels: DataFrame, per_class: int, most_bytes: int, doc_id: str = "doc_id", text: str = "text", more: tuple[str, ...] = ()
) -> list[tuple]:
    """(text, label, *more) of the rows of sample_rows, for fitting a model on the driver."""
    rows = sample_rows(docs, labels, per_class, most_bytes, doc_id, text, more)
    return [] if rows is None else _ordered(rows.collect())


def fitted(rows: DataFrame | None, fit: Callable[[list[tuple]], Any]) -> Any:
    """What fit makes of the bounded_sample whose sample_rows are rows. It is called in a task, so the driver gets the model only."""
    if rows is None:
        return fit([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit(_ordered(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = map_batches(rows.repartition(1), run, "model binary").first()
    return pickle.loads(made.model) if made else fit([])  # without rows there may be no task
