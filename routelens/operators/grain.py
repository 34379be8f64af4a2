"""Call grain, modes, safe bridges and joins of many-per-call events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def call_grain(rows: DataFrame, key: str, variants: list[str], order: list[Column]) -> DataFrame:
    """One row per key: rows, n_<variant> (distinct values, null being one), conflict, and the first row in the given order.
    Rows equal in that order are taken by their other columns from left to right, least and null first.

    The first row is taken by an aggregate, so that hot keys are combined before the shuffle.
    """
    rest = [c for c in rows.columns if c != key]
    first = F.min(F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *rest)).alias("__first")
    counts = [F.count_distinct(F.coalesce(F.col(v).cast("string"), F.lit("<NULL>"))).alias(f"n_{v}") for v in variants]
    out = rows.groupBy(key).agg(F.count("*").alias("n_rows"), *counts, first)
    conflict = F.array_max(F.array(F.lit(1).cast("long"), *(F.col(f"n_{v}") for v in variants))) > 1
    return out.select(key, "n_rows", *(f"n_{v}" for v in variants), conflict.alias("conflict"), *(F.col(f"__first.{c}").alias(c) for c in rest))


def mode_pack(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mode, mode_count, total and share; missing counts as a value, ties go to the smallest."""
    counts = rows.groupBy(*keys, F.coalesce(F.col(value).cast("string"), F.lit("<MISSING>")).alias("v")).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("k"), "v")).alias("b"), F.sum("n").alias("total"))
    return best.select(*keys, F.col("b.v").alias("mode"), (-F.col("b.k")).alias("mode_count"), "total", (-F.col("b.k") / F.col("total")).alias("share"))


def bridge(pairs: DataFrame, call: str, kind: str, key: str) -> DataFrame:
    """Distinct (call, kind, key) with the number of calls per key and whether the key is safe: of one call only."""
    keys = pairs.where(F.col(key).isNotNull()).groupBy(kind, key).agg(F.count_distinct(call).alias("n_calls"), F.min(call).alias(call))
    return keys.select(kind, key, "n_calls", (F.col("n_calls") == 1).alias("safe"), F.when(F.col("n_calls") == 1, F.col(call)).alias(call))


def map_events(events: DataFrame, event: str, keys: dict[str, str], bridges: DataFrame, call: str) -> DataFrame:
    """For each event that a safe key reaches: n_calls, and call and key kind (the smallest) if exactly one call."""
    long = events.select(event, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("key")) for k, c in keys.items()))).alias("x")).select(event, "x.kind", "x.key")
    hit = long.join(bridges.where("safe").select("kind", "key", call), ["kind", "key"])
    out = hit.groupBy(event).agg(F.count_distinct(call).alias("n_calls"), F.min(call).alias("__c"), F.min("kind").alias("__k"))
    return out.select(event, "n_calls", F.when(F.col("n_calls") == 1, F.col("__c")).alias(call), F.when(F.col("n_calls") == 1, F.col("__k")).alias("kind"))


def nearest_reciprocal(left: DataFrame, right: DataFrame, by: list[str], seconds: float) -> DataFrame:
    """Pairs (left_id, right_id, gap) that are each other's nearest in time within a tolerance (J6). Both sides: id, ts and the keys in by.

    Times fall into buckets of the tolerance; a left row meets the buckets before, of and after its own.
    """
    width = float(seconds)
    t = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    has = F.lit(True)
    for k in by:
        has = has & F.col(k).isNotNull()
    a = left.where(has).select(*by, F.col("id").alias("left_id"), t("ts").alias("lt")).withColumn("b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("lt") / width) + i)))
    b = right.where(has).select(*by, F.col("id").alias("right_id"), t("ts").alias("rt")).withColumn("b", F.floor(F.col("rt") / width))
    pairs = a.join(b, [*by, "b"]).withColumn("gap", F.abs(F.col("lt") - F.col("rt"))).where(F.col("gap") <= width)
    of_left = F.row_number().over(W.partitionBy("left_id").orderBy("gap", "rt", "right_id"))
    of_right = F.row_number().over(W.partitionBy("right_id").orderBy("gap", "lt", "left_id"))
    return pairs.withColumn("rl", of_left).withColumn("rr", of_right).where("rl = 1 AND rr = 1").select("left_id", "right_id", "gap")


def best_exact_key(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], least: float = 0.5) -> tuple[str, str, float] | None:
    """The key pair with the highest coverage of left rows by right keys that occur once, if at least `least`."""
    best = None
    for lk, rk in pairs:
        once = right.where(F.col(rk).isNotNull()).groupBy(F.col(rk).alias("__k")).count().where("count = 1").select("__k")
        share = left.join(once, left[lk] == F.col("__k"), "left").agg(F.avg(F.col("__k").isNotNull().cast("double"))).first()[0] or 0.0
        if share >= least and (best is None or share > best[2]):
            best = (lk, rk, share)
    return best


def complete_grain(rows: DataFrame, key: str, fields: list[str], variants: list[str], order: list[Column]) -> DataFrame:
    """The most complete row of each key (most non-null fields, then the order); keys whose variants conflict are dropped (A2)."""
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    out = call_grain(rows.withColumn("completeness", filled), key, variants, [-filled, *order])
    return out.where("NOT conflict").drop("conflict", *(f"n_{v}" for v in variants))


def key_coverage(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], least: float = 0.5) -> DataFrame:
    """left_key, right_key, coverage of left rows by right keys that occur once, and whether it is the one to take.

    One row per candidate; the candidates are a short list of the caller's.
    """
    out = None
    for lk, rk in pairs:
        once = right.where(F.col(rk).isNotNull()).groupBy(F.col(rk).cast("string").alias("__k")).count().where("count = 1").select("__k")
        part = left.select(F.col(lk).cast("string").alias("__l")).join(once, F.col("__l") == F.col("__k"), "left").agg(F.avg(F.col("__k").isNotNull().cast("double")).alias("coverage")).select(F.lit(lk).alias("left_key"), F.lit(rk).alias("right_key"), "coverage")
        out = part if out is None else out.unionByName(part)
    best = F.max_by(F.struct("left_key", "right_key"), F.struct("coverage", "left_key", "right_key"))
    top = out.agg(best.alias("b"))
    return out.crossJoin(F.broadcast(top)).withColumn("accepted", (F.struct("left_key", "right_key") == F.col("b")) & (F.col("coverage") >= least)).drop("b")  # one row


def stage_diagnostics(events: DataFrame, event: str, stages: dict[str, str], bridges: DataFrame) -> DataFrame:
    """One row per stage: eligible events, matched ones, coverage, safe and quarantined keys, quarantined events."""
    long = events.select(event, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("key")) for k, c in stages.items()))).alias("x")).select(event, "x.kind", "x.key").where("key IS NOT NULL")
    per_key = long.groupBy("kind", "key").agg(F.count("*").alias("n")).join(bridges.select("kind", "key", "safe"), ["kind", "key"], "left")
    safe, unsafe = F.coalesce("safe", F.lit(False)), ~F.coalesce("safe", F.lit(True))
    n = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    g = per_key.groupBy(F.col("kind").alias("stage")).agg(F.sum("n").alias("eligible"), n(safe, F.col("n")).alias("matched"), n(safe, 1).alias("safe_keys"), n(unsafe, 1).alias("quarantined_keys"), n(unsafe, F.col("n")).alias("quarantined_events"))
    return g.withColumn("coverage", F.col("matched") / F.col("eligible"))
