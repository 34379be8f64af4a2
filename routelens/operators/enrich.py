"""Enrichment of calls by two sources in two stages, as one job (C4).

The exact source names its call. Its rows are cut down to the wanted calls before anything else is done with them (J4), and so bring
the calls' other keys, from which bridges are made; a key of several calls is safe for none and goes to quarantine (J7). The event
source knows only such keys: an event belongs to the one call that its safe keys agree on (J8). Both are then aggregated to call grain
(A3, A4) and joined to the calls (J3).

Stages are written as Parquet under one folder, and one that was written whole is read again by a later run with the same folder:
`exact` (rows of wanted calls), `bridges` (each key with its number of calls), `events` (all events, with call or reason), `enriched`,
`quarantine` and `diagnostics`. Calls repeated or without an id are kept as they are; those without one match nothing. Null keys
bridge nothing. Empty sources give calls without figures. Columns of a source beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grain
from .replay import written


#: Why a row reaches no call.
REASONS = ("NO_KEY", "NO_BRIDGE", "QUARANTINED_KEYS", "CALLS_DISAGREE")


class Source(NamedTuple):
    rows: DataFrame
    id: str  #: the call in the exact source, the event in the other
    keys: dict[str, str]  #: column of each kind of bridge key
    number: str
    category: str


def _long(rows: DataFrame, id: str, keys: dict[str, str]) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("key")) for k, c in keys.items())))
    return rows.select(id, each.alias("x")).select(id, "x.kind", "x.key").where("key IS NOT NULL")


def to_call_grain(rows: DataFrame, call: str, number: str, category: str, prefix: str) -> DataFrame:
    """<prefix>_rows, _sum, _min and _max of a number, _mode and _share of a category, one row a call (A3, A4)."""
    x = F.col(number).cast("double")
    numbers = rows.groupBy(call).agg(F.count("*").alias(f"{prefix}_rows"), *(f(x).alias(f"{prefix}_{n}") for n, f in (("sum", F.sum), ("min", F.min), ("max", F.max))))
    modes = grain.mode_pack(rows, [call], category).select(call, F.col("mode").alias(f"{prefix}_mode"), F.col("share").alias(f"{prefix}_share"))
    return numbers.join(modes, call)


def _stage_row(stage: str, rows: DataFrame, reason: str, call: str) -> DataFrame:
    """Rows of a stage, those that have a key, those matched and their calls, and how many of the others failed for which reason."""
    n = lambda r: F.count(F.when(F.col(reason) == r, 1))
    g = rows.agg(F.count("*").alias("source_rows"), (F.count("*") - n("NO_KEY")).alias("eligible_rows"), n("MATCHED").alias("matched_rows"), F.count_distinct(F.when(F.col(reason) == "MATCHED", F.col(call))).alias("calls"), *(n(r).alias(r.lower()) for r in REASONS))
    return g.select(F.lit(stage).alias("stage"), "*", F.try_divide(F.col("matched_rows").cast("double"), F.col("eligible_rows")).alias("coverage"))


def two_stage(calls: DataFrame, call: str, exact: Source, events: Source, folder: str) -> dict[str, DataFrame]:
    """The tables of the job by name. Both sources have the same kinds of keys."""
    spark, out = calls.sparkSession, {}

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{folder}/{name}"
        if not written(spark, path):
            make().write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
        return out[name]

    wanted = calls.where(F.col(call).isNotNull()).select(F.col(call).alias("__call")).distinct()
    own = exact.rows.select(F.col(exact.id).alias("__call"), *dict.fromkeys([*exact.keys.values(), exact.number, exact.category]))
    kept = stage("exact", lambda: own.join(wanted, "__call", "left_semi"))
    bridges = stage("bridges", lambda: grain.bridge(_long(kept, "__call", exact.keys).distinct(), "__call", "kind", "key"))

    def mapped() -> DataFrame:
        rows = events.rows.select(F.col(events.id).alias("__event"), *dict.fromkeys([*events.keys.values(), events.number, events.category]))
        met = _long(rows, "__event", events.keys).join(bridges, ["kind", "key"])
        found = met.groupBy("__event").agg(F.count_distinct("__call").alias("__n"), F.min("__call").alias("__call"))
        has_key = F.coalesce(*(F.col(c).cast("string") for c in events.keys.values())).isNotNull()
        reason = F.when(~has_key, "NO_KEY").when(F.col("__n").isNull(), "NO_BRIDGE").when(F.col("__n") == 1, "MATCHED").when(F.col("__n") > 1, "CALLS_DISAGREE").otherwise("QUARANTINED_KEYS")
        return rows.join(found, "__event", "left").withColumn("reason", reason).withColumn("__call", F.when(F.col("__n") == 1, F.col("__call"))).drop("__n")

    reached = stage("events", mapped)

    def enriched() -> DataFrame:
        a = to_call_grain(kept, "__call", exact.number, exact.category, "exact").withColumnRenamed("__call", "__a")
        b = to_call_grain(reached.where("reason = 'MATCHED'"), "__call", events.number, events.category, "bridged").withColumnRenamed("__call", "__b")
        return calls.join(a, F.col(call) == F.col("__a"), "left").join(b, F.col(call) == F.col("__b"), "left").drop("__a", "__b")

    stage("enriched", enriched)
    stage("quarantine", lambda: bridges.where("NOT safe").select("kind", "key", "n_calls"))

    def diagnostics() -> DataFrame:
        reason = F.when(F.col("__call").isNull(), "NO_KEY").when(F.col("__wanted"), "MATCHED").otherwise("NO_BRIDGE")
        rows = own.select("__call").join(wanted.withColumn("__wanted", F.lit(True)), "__call", "left").withColumn("reason", reason)
        return _stage_row("EXACT", rows, "reason", "__call").unionByName(_stage_row("BRIDGED", reached, "reason", "__call"))

    stage("diagnostics", diagnostics)
    return out
