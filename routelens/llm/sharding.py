"""Sharding by sampled splitters.

A key sample, drawn with probability in proportion to record size, gives quantile boundaries; records are range-partitioned
by them, exact prefix sums over the ranges give every record its place, and ranges or groups that are larger than their
share are subdivided. The key is (hash of the text, doc_id, number of the row): equal texts are neighbours and stay in one shard,
unless the group holds more than KEEP_TOGETHER of a shard's bytes, in which case it is dealt out record by record. A group that
spans several ranges is summed up over all of them.

Law ``bytes``: shard s holds the records whose midpoint in the byte order lies in [s, s + 1) / n of all bytes, so that shard
sizes differ by a record, or a small group, at each boundary. Shards do not depend on the sample, which only sets the ranges.

Null or empty text: size 8, crc32 0. Null doc_id: sorts first. Repeated rows: each gets its own slot, in the order of the table's
parts. Very long texts count with all their bytes; a text longer than a shard's share makes that shard larger. Empty table: no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cumulative_hash_fraction, saved

#: Bytes of input for one range, and the least and most ranges.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 64 << 20, 1536, 20_000
#: Sampled keys for each range; the sample sent to the driver has about twice as many rows at most.
SAMPLES_PER_RANGE = 8
#: A group of equal texts up to this share of a shard's bytes is kept in one shard.
KEEP_TOGETHER = 0.05
#: Where rows without a doc_id sort.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, the hash of the text that orders equal texts together, and a number for the row (to be written before it is used twice)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("h"),
        F.monotonically_increasing_id().alias("row"),
    )


def splitters(keys: DataFrame, n_ranges: int, total: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Quantiles of a size-weighted sample of keys, sorted: h, and (doc_id, row). A hash that occurs more than once is a heavy group."""
    want = n_ranges * SAMPLES_PER_RANGE
    drawn = keys.where(cumulative_hash_fraction(F.lit(17), "h", "doc_id", "row") * total < F.col("size") * F.lit(float(want)))
    rows = drawn.select("h", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "row").toPandas().sort_values(["h", "doc_id", "row"])
    cut = rows.iloc[SAMPLES_PER_RANGE::SAMPLES_PER_RANGE]
    return cut["h"].to_numpy(np.int64), list(zip(cut["doc_id"].tolist(), cut["row"].tolist(), strict=True))


def with_range(keys: DataFrame, at: tuple[np.ndarray, list[tuple[int, int]]]) -> DataFrame:
    """Adds the number of the range that holds the key. Only heavy groups are split by doc_id and row."""
    shared = keys.sparkSession.sparkContext.broadcast(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ids = shared.value
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(hs, h, "left"), np.searchsorted(hs, h, "right")
            out = high.astype(np.int64)
            for i in np.flatnonzero(high - low > 1):
                d, row = b.column("doc_id")[int(i)].as_py(), b.column("row")[int(i)].as_py()
                out[i] = bisect.bisect_right(ids, (NO_ID if d is None else d, row), int(low[i]) + 1, int(high[i]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "range"])

    return keys.mapInArrow(run, "doc_id long, size long, text_crc32 long, h long, row long, range long")


def assign_shards(docs: DataFrame, n_shards: int = 24, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every record of docs."""
    spark = docs.sparkSession
    keys = saved(keyed(docs, text, doc_id), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    n_ranges = int(min(MOST_RANGES, max(LEAST_RANGES, total // RANGE_BYTES)))
    at = splitters(keys, n_ranges, total)
    ranged = saved(with_range(keys, at), "shard-ranges")
    sums = ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).toPandas().sort_values("range")
    before = [(int(r), int(b), int(n)) for r, b, n in zip(sums["range"], sums["b"].cumsum() - sums["b"], sums["n"].cumsum() - sums["n"], strict=True)]
    before = spark.createDataFrame(before, "range long, bytes_before long, rows_before long")  # a row for each range: at most MOST_RANGES
    # heavy groups begin a range of their own; their bytes are summed up over all their ranges
    hashes, times = np.unique(at[0], return_counts=True)
    heavy = spark.createDataFrame([(int(h),) for h in hashes[times > 1]], "heavy long")
    heavy = ranged.join(F.broadcast(heavy), F.col("h") == F.col("heavy")).groupBy("heavy").agg(F.sum("size").alias("all_bytes"), F.min("range").alias("first_range"))
    heavy = heavy.join(F.broadcast(before), F.col("first_range") == F.col("range")).select("heavy", "all_bytes", F.col("bytes_before").alias("all_start"))

    target = max(total, 1) / n_shards
    order = W.partitionBy("range").orderBy("h", "doc_id", "row")
    group = W.partitionBy("range", "h")
    own_end = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = (
        ranged.withColumn("own_end", own_end)
        .withColumn("row", F.row_number().over(order) - 1)
        .withColumn("group_bytes", F.sum("size").over(group))
        .withColumn("group_start", F.min(F.col("own_end") - F.col("size")).over(group))
        .join(F.broadcast(before), "range")
        .join(F.broadcast(heavy), F.col("h") == F.col("heavy"), "left")
    )
    group_bytes = F.coalesce("all_bytes", "group_bytes")
    group_start = F.coalesce("all_start", F.col("bytes_before") + F.col("group_start"))
    middle = F.when(group_bytes <= F.lit(KEEP_TOGETHER * target), group_start + group_bytes / 2).otherwise(F.col("bytes_before") + F.col("own_end") - F.col("size") / 2)
    placed = saved(
        placed.select(
            "doc_id", "size", "text_crc32", F.least(F.floor(middle / F.lit(target)), F.lit(n_shards - 1)).cast("int").alias("shard"),
            (F.col("rows_before") + F.col("row")).alias("place"),
        ),
        "shard-places",
    )
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))  # at most n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first_place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, doc_id: str = "doc_id") -> None:
    """Writes whole records under path/shard=N. Needs a unique doc_id; a shard is written by several tasks, in slot order each."""
    placed = assign_shards(docs, n_shards, doc_id=doc_id).select(F.col("doc_id").alias("__id"), "shard", "slot")
    rows = docs.join(placed, docs[doc_id] == placed["__id"]).drop("__id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
