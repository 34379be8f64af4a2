"""Embedding whitening with a covariance weighted by multiplicity.

Components become integers; identical vectors are one row with the number of their copies. The fit weighs each distinct vector by its copies or
by one. Its sums are exact integers, its covariance is a product of centred matrices, summed over tasks (a matrix of dimensions x
dimensions goes to the driver, which takes its eigenvectors). Each distinct vector is whitened once, and rows get the result by a join
on the vector, in which vectors with many copies are salted.

Vectors that are null, or hold null or non-finite components, are dropped. Shorter vectors than the longest: missing components count as 0. 64 times a
component is clipped to 2^61 on either side. Components whose eigenvalue is 0 up to rounding (a constant dimension, or fewer vectors than
dimensions) can't be scaled: whitened is null there, and identity_error leaves them out; with no other component it is null. Null and
repeated vec_ids: each row gets its rows. Empty table, or no usable vector: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_SHARE, saved

SCALE, SHIFT, CLIP = 64, 1_000_000, float(1 << 61)
#: Bits of a limb, in which sums and products of integers stay within 64 bits.
LIMB = 21


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, x and a number for the row (to be written before it is used twice) of the usable rows; x has the length of the longest vector."""
    e = F.col(embedding)
    finite = vectors.where(e.isNotNull() & ~F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    longest = finite.agg(F.max(F.size(e))).first()[0] or 0
    x = F.transform(e, lambda c: F.floor(F.least(F.greatest(SCALE * c.cast("double"), F.lit(-CLIP)), F.lit(CLIP))).cast("long") + SHIFT)
    return finite.select(F.col(vec_id).alias("vec_id"), F.concat(x, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(longest) - F.size(e))).alias("x"), F.monotonically_increasing_id().alias("row"))


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """x = limbs[0] + limbs[1] << LIMB + limbs[2] << 2 LIMB; only the last may be negative."""
    mask = (1 << LIMB) - 1
    return [x & mask, (x >> LIMB) & mask, x >> (2 * LIMB)]


def exact_sums(distinct: DataFrame, weighted: bool) -> tuple[int, list[int]]:
    """The sum of weights, and of weight x component for each dimension, as integers without rounding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for b in batches:
            if b.num_rows == 0:
                continue
            x, w = _matrix(b.column(0), np.int64), b.column(1).to_numpy()
            w = w if weighted else np.ones_like(w)
            n += int(w.sum())
            parts = np.zeros(x.shape[1], object)
            for i, a in enumerate(_limbs(x)):
                for j, v in enumerate(_limbs(w)):
                    if v.any():
                        parts += (v @ a).astype(object) << (LIMB * (i + j))
            sums = parts if sums is None else sums + parts
        if sums is not None:
            totals = [n, *map(int, sums)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), pa.array([Decimal(s) for s in totals], pa.decimal128(38, 0))], names=["dim", "total"])

    rows = distinct.select("x", "copies").mapInArrow(run, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total")).collect()  # one row for each dimension
    totals = {r["dim"]: int(r["total"]) for r in rows}
    return totals.pop(-1, 0), [totals[k] for k in sorted(totals)]


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The floor of the mean, which is subtracted from integers, and the rest of it."""
    return np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])


def product_sums(rows: DataFrame, of: str, floor: np.ndarray, rest: np.ndarray, weighted: bool) -> np.ndarray:
    """Sum over rows of weight x centred vector x its transpose. Each task sums a matrix; matrices meet row by row."""
    shared = rows.sparkSession.sparkContext.broadcast((floor, rest))
    d = len(floor)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, rest = shared.value
        total = np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                z = (_matrix(b.column(0), floor.dtype.type) - floor).astype(float) - rest
                total += (z * b.column(1).to_numpy()[:, None] if weighted else z).T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["dim", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), _matrix(b.column(1), float), strict=True):
                got[k] = got[k] + v if k in got else v
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array(list(got.values()), pa.list_(pa.float64()))], names=["dim", "sums"])

    schema = "dim int, sums array<double>"
    out = rows.select(of, "copies").mapInArrow(multiply, schema).repartition("dim").mapInArrow(add, schema).collect()  # dimensions x dimensions numbers
    return np.array([r["sums"] for r in sorted(out, key=lambda r: r["dim"])]).reshape(d, d)


def whiten(vectors: DataFrame, weights: str = "one", most: int = 16, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For every usable row: vec_id, n (sum of weights), deviation (decimal: sum of (n x - S)^2, exact), whitened (up to `most` components by
    falling eigenvalue), explained (each component's share of the variance), identity_error.

    weights: "one" counts each distinct vector once in the fit, "count" as often as it occurs. deviation is null beyond 38 digits.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights is 'one' or 'count'")
    spark, weighted = vectors.sparkSession, weights == "count"
    rows = saved(quantised(vectors, vec_id, embedding), "whitening-rows")
    distinct = saved(rows.groupBy("x").agg(F.count("*").alias("copies")), "whitening-distinct")
    n, sums = exact_sums(distinct, weighted)
    result = f"vec_id {vectors.schema[vec_id].dataType.simpleString()}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if not n or not sums:
        return spark.createDataFrame([], result)
    floor, rest = _centre(n, sums)
    cov = product_sums(distinct, "x", floor, rest, weighted) / n
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value, kind="stable")[:most]
    value, vector, trace = value[order], vector[:, order], float(np.trace(cov))
    usable = value > max(float(value[0]), 0) * len(sums) * np.finfo(float).eps
    shared = spark.sparkContext.broadcast((floor, rest, [s % n for s in sums], n, vector, np.where(usable, value, np.nan)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, rest, remainder, n, vector, value = shared.value
        low = np.array([r & ((1 << LIMB) - 1) for r in remainder]), np.array([r >> LIMB & ((1 << LIMB) - 1) for r in remainder]), np.array([r >> 2 * LIMB for r in remainder])
        squares = sum(r * r for r in remainder)
        for b in batches:
            y = _matrix(b.column(0), np.int64) - floor
            parts = _limbs(y)
            own, with_rest = np.zeros(len(y), object), np.zeros(len(y), object)
            for i, p in enumerate(parts):
                for j, q in enumerate(parts):
                    own += (p * q).sum(1).astype(object) << (LIMB * (i + j))
                for j, r in enumerate(low):
                    with_rest += (p @ r).astype(object) << (LIMB * (i + j))
            exact = n * n * own - 2 * n * with_rest + squares  # sum of (n y - remainder)^2
            deviation = pa.array([Decimal(int(v)) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            white = (y.astype(float) - rest) @ vector / np.sqrt(value)
            flat = pa.array(white.ravel(), from_pandas=True)  # NaN of components that can't be scaled becomes null
            white = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * len(value)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), deviation, white], names=["x", "copies", "deviation", "whitened"])

    white = saved(distinct.mapInArrow(run, "x array<long>, copies long, deviation decimal(38,0), whitened array<double>"), "whitening-distinct")
    error = _identity_error(white, int(usable.sum()), n, weighted)
    explained = [float(v / trace) if trace > 0 else None for v in value]

    # rows of a vector with many copies are dealt over salts, and so is the vector
    heavy_at = max(2, int(rows.count() * HEAVY_SHARE))  # at most 1 / HEAVY_SHARE vectors have so many copies
    heavy = white.where(F.col("copies") >= heavy_at).select(F.col("x").alias("hx"), F.ceil(F.col("copies") / heavy_at).alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    left = rows.join(F.broadcast(heavy), F.col("x") == F.col("hx"), "left").select("vec_id", "x", F.pmod("row", salts).alias("salt"))
    right = white.withColumn("salts", F.when(F.col("copies") >= heavy_at, F.ceil(F.col("copies") / heavy_at)))
    right = right.select("x", "deviation", "whitened", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    return left.join(right, ["x", "salt"]).select(
        "vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*map(F.lit, explained)).cast("array<double>").alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )


def _identity_error(white: DataFrame, components: int, n: int, weighted: bool) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity. Components that can't be scaled come last."""
    if not components:
        return None
    white = white.select(F.slice("whitened", 1, components).alias("whitened"), "copies")
    w = F.col("copies") if weighted else F.lit(1)
    means = white.select(w.alias("w"), F.posexplode("whitened")).groupBy("pos").agg((F.sum(F.col("w") * F.col("col")) / n).alias("mean")).collect()  # a row for each component
    mean = np.array([r["mean"] for r in sorted(means, key=lambda r: r["pos"])])
    return float(np.abs(product_sums(white, "whitened", np.zeros(components), mean, weighted) / n - np.eye(components)).max())


def components(whitened: DataFrame) -> DataFrame:
    """A row for each row of whiten() and component, numbered from 1; deviation as long, null beyond 64 bits."""
    long = whitened.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of"))
    return long.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("of.whitened").alias("whitened"), F.col("of.explained").alias("explained"), "identity_error")
