"""Replay sources in one shape: names, times, clipped rates, checked keys, ordered row ids, and a count of every defect.

Order of steps: names; times to UTC; the window; rows that can't be used are left out; rates are clipped; times go down to the hour. An entity
and hour that occur twice stop the job, as summing them would change what a model sees. Nothing is left out silently: quality() counts it all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalize import number, parse_utc
from ..sources.contracts import plain, resolve
from ..sources.files import scratch

#: Names of the source's columns, the first that is there counts. Fixed values.
RATES = ("lsr_sr", "asr_sr", "bid_sr", "csr_sr")
CONTRACT = {"hour_start_utc": ("HOUR_START_UTC", "EVAL_TS_UTC", "RUN_TS_UTC"), "psap_id": ("PSAP_ID",), **{c: (c.upper(), f"{c.upper()}_LIST") for c in ("call_volume", *RATES)}}
COUNTED = {f"{p}_{what}": (f"{p.upper()}_{what.upper()}",) for p in ("lsr", "asr", "bid", "csr") for what in ("calls", "success")}


def _time(df: DataFrame, column: str) -> Column:
    return F.col(column).cast("timestamp") if df.schema[column].dataType.typeName().startswith("timestamp") else parse_utc(F.col(column))


def _read(raw: DataFrame) -> DataFrame:
    """The contract's columns with types, and why a row can't be used."""
    known = {plain(c) for c in raw.columns}
    lost = [c for c, names in CONTRACT.items() if not any(plain(n) in known for n in names)]
    if lost:
        raise ValueError(f"the source lacks {lost}")
    named = resolve(raw, CONTRACT | COUNTED)
    figure = lambda c: number(F.col(c).cast("string"))
    typed = named.select(_time(named, "hour_start_utc").alias("ts"), F.col("psap_id").cast("string").try_cast("double").try_cast("bigint").alias("psap_id"), *(figure(c).alias(c) for c in ("call_volume", *RATES, *COUNTED)))
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.lit(False))
    bad_figure = ~F.array_min(F.array(*(finite(c) for c in ("call_volume", *RATES))))
    outside = F.array_max(F.array(*(F.coalesce((F.col(r) < 0) | (F.col(r) > 100), F.lit(False)) for r in RATES)))
    return typed.withColumns({"bad_figure": bad_figure, "bad_psap": F.col("psap_id").isNull() | (F.col("psap_id") == -1), "negative": F.coalesce(F.col("call_volume") < 0, F.lit(False)), "outside": outside})


def _window(start: str | None, end: str | None) -> Column:
    inside = F.lit(True)
    if start is not None:
        inside = inside & F.coalesce(F.col("ts") >= F.lit(start).cast("timestamp"), F.lit(False))
    if end is not None:
        inside = inside & F.coalesce(F.col("ts") < F.lit(end).cast("timestamp"), F.lit(False))
    return inside


def _usable() -> Column:
    return F.col("ts").isNotNull() & ~F.col("bad_figure") & ~F.col("bad_psap") & ~F.col("negative")


def normalize(raw: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """evaluation_row_id, psap_id, hour_start_utc and the KPIs of the usable rows with start <= time < end, ids without gaps by hour and entity.

    The job fails if an entity has two rows in an hour. Entities are numbers; other ids count as invalid. An empty source gives no rows.
    """
    rows = _read(raw).where(_window(start, end) & _usable())
    hour = F.date_trunc("hour", "ts").alias("hour_start_utc")
    clipped = [F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(r))).alias(r) for r in RATES]
    kpis = rows.select("psap_id", hour, "call_volume", *clipped).groupBy("psap_id", "hour_start_utc").agg(F.count("*").alias("n"), *(F.any_value(c).alias(c) for c in ("call_volume", *RATES)))
    twice = F.concat(F.lit("two rows of entity "), F.col("psap_id").cast("string"), F.lit(" at "), F.col("hour_start_utc").cast("string"))
    once = kpis.withColumn("psap_id", F.when(F.col("n") > 1, F.raise_error(twice).cast("bigint")).otherwise(F.col("psap_id"))).drop("n")
    return numbered(once, ["hour_start_utc", "psap_id"], "BASE-%010d", "evaluation_row_id")


def numbered(df: DataFrame, order: list[str], form: str, name: str) -> DataFrame:
    """df with ids from 0 without gaps, in the order of columns that are unique together: ranges, their rows numbered, and the rows before each range."""
    spark, at = df.sparkSession, scratch(df.sparkSession, "numbered")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    placed.write.parquet(at)
    placed = spark.read.schema(placed.schema).parquet(at)
    ranges = placed.groupBy("__range").agg(F.count("*").alias("n"))  # a row for each partition
    before = ranges.select("__range", (F.sum("n").over(W.orderBy("__range")) - F.col("n")).alias("__before"))
    return placed.join(F.broadcast(before), "__range").select(F.format_string(form, F.col("__before") + F.col("__at")).alias(name), *df.columns)


def quality(raw: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row of counts: rows of the source and of the window, defects (a row may have several), the grid of entities and hours, and what it lacks."""
    read = _read(raw)
    inside, usable = _window(start, end), _window(start, end) & _usable()
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    hour = F.date_trunc("hour", "ts")
    more = [count(usable & (F.col(f"{p}_success") > F.col(f"{p}_calls")), f"{p}_success_over_calls") for p in ("lsr", "asr", "bid", "csr")]
    first = F.lit(start).cast("timestamp") if start is not None else F.min(F.when(inside, F.col("ts")))
    last = F.lit(end).cast("timestamp") if end is not None else F.max(F.when(inside, F.col("ts"))) + F.expr("INTERVAL 1 HOUR")
    got = read.agg(
        F.count("*").alias("source_rows"), count(inside, "window_rows"), count(usable, "valid_rows"), count(F.col("ts").isNull(), "invalid_timestamp_rows"), count(hour != F.col("ts"), "off_hour_rows"),
        count(inside & F.col("bad_figure"), "nonfinite_kpi_rows"), count(inside & F.col("bad_psap"), "invalid_psap_rows"), count(inside & F.col("negative"), "negative_volume_rows"), count(inside & F.col("outside"), "clipped_rate_rows"),
        F.count_distinct(F.when(usable, F.col("psap_id"))).alias("distinct_psaps"), F.count_distinct(F.when(usable, hour)).alias("observed_hours"),
        F.ceil((last.cast("double") - first.cast("double")) / 3600).alias("expected_hours"), *more,
    )
    grid = F.col("distinct_psaps") * F.col("expected_hours")
    return got.withColumns({"missing_hours": F.col("expected_hours") - F.col("observed_hours"), "planned_psap_hours": grid, "absent_psap_hours": F.greatest(F.lit(0), grid - F.col("valid_rows"))})
