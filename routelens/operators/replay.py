"""Replay of a deployed model: untouched hours, injected faults and their paired baselines, all scored by the same heads.

The job runs in stages, each written as Parquet under one folder: `truth` (row truth of the campaign), `rows` (the three evaluation
sets in one shape), `heads` (a score for each row and candidate head), `scored` (one gated score for each row) and `pairs` (each injected
hour beside the same hour untouched). A stage that has been written whole is read again by a later run with the same folder, so a job
that was stopped goes on where it stopped; a folder belongs to one set of inputs. Each stage checks that its hours lie after the
training cutoff and fails otherwise; an hour that is null can't be shown to and fails too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kpi

if TYPE_CHECKING:
    import pandas as pd

KPIS = ("call_volume", *kpi.RATES)
UNTOUCHED, PAIRED, INJECTED = "UNTOUCHED_BASELINE", "PAIRED_UNTOUCHED_BASELINE", "SYNTHETIC_CHALLENGE"
ROW = ("evaluation_set", "event_id", "offset_hour", "psap_id", "hour_start_utc", *KPIS)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a job has finished writing to a folder, by the mark that Spark leaves."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def after_cutoff(rows: DataFrame, cutoff: str) -> DataFrame:
    """rows, whose job fails at an hour that isn't after the cutoff."""
    hour = F.col("hour_start_utc")
    message = F.concat(F.lit("chronological leakage: hour "), F.coalesce(hour.cast("string"), F.lit("NULL")), F.lit(f" is not after {cutoff}"))
    return rows.withColumn("hour_start_utc", F.when(hour > F.lit(cutoff).cast("timestamp_ntz"), hour).otherwise(F.raise_error(message)))


def evaluation_rows(hourly: DataFrame, truth: DataFrame) -> DataFrame:
    """The untouched hours, and each hour of the campaign twice: untouched and injected."""
    none = F.lit(None)
    base = hourly.select(F.lit(UNTOUCHED).alias("evaluation_set"), none.cast("string").alias("event_id"), none.cast("int").alias("offset_hour"), "psap_id", "hour_start_utc", *KPIS)
    pair = truth.select(F.lit(PAIRED).alias("evaluation_set"), "event_id", "offset_hour", "psap_id", "hour_start_utc", *KPIS)
    injected = truth.select(F.lit(INJECTED).alias("evaluation_set"), "event_id", "offset_hour", "psap_id", "hour_start_utc", *(F.col(f"injected_{k}").alias(k) for k in KPIS))
    return base.unionByName(pair).unionByName(injected)


def score_heads(rows: DataFrame, models: DataFrame, detector: Callable[[pd.DataFrame], tuple]) -> DataFrame:
    """rows (with head_id) and raw_score, raw_threshold, head_status, input_valid and has_detector of each.

    models: one row for each head_id that has a detector, with whatever that needs as columns. A frozen detector judges each hour by
    itself, so it is called with the rows of one head in one Arrow batch: nothing is shuffled for it, and no head lies in memory
    whole. What it raises becomes the status of those rows, with its message.
    """
    import numpy as np
    import pandas as pd

    joined = rows.join(models.withColumn("has_detector", F.lit(True)), "head_id", "left").withColumns({"has_detector": F.col("has_detector").isNotNull(), "input_valid": kpi.quality_issues() == ""})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score, threshold = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            status = np.where(pdf["has_detector"], np.where(pdf["input_valid"], "SCORED", "INVALID_INPUT"), "NO_DETECTOR").astype(object)
            usable = np.flatnonzero(status == "SCORED")
            for places in pd.Series(usable).groupby(pdf["head_id"].to_numpy()[usable]):
                at = places[1].to_numpy()
                try:
                    score[at], threshold[at] = detector(pdf.iloc[at])
                    status[at[~(np.isfinite(score[at]) & np.isfinite(threshold[at]) & (threshold[at] > 0))]] = "INVALID_SCORE_OR_THRESHOLD"
                except Exception as e:  # noqa: BLE001  whatever a detector raises is the status of its rows
                    score[at], status[at] = np.nan, f"SCORING_ERROR: {type(e).__name__}: {e}"
            yield pdf.assign(raw_score=score, raw_threshold=threshold, head_status=status)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields]
    out = joined.mapInPandas(run, ", ".join([*kinds, "raw_score double", "raw_threshold double", "head_status string"]))
    finite = lambda c: F.when(~F.isnan(c), F.col(c))
    return out.withColumns({"raw_score": finite("raw_score"), "raw_threshold": finite("raw_threshold")})


def gated(per_head: DataFrame) -> DataFrame:
    """One row for each evaluation row: score over all heads, status, hard gate and whether its alert is passed on."""
    s = kpi.aggregate_heads(per_head, ROW)
    out = s.withColumn("gate", kpi.hard_gate(F.col("anomaly_score"), F.lit(1.0)))
    return out.withColumn("eligible", F.coalesce(kpi.eligible(F.col("alert"), F.col("gate") == "OK", kpi.tier_gate()), F.lit(False)))


def paired_rows(truth: DataFrame, scored: DataFrame) -> DataFrame:
    """Each row of the campaign with both scores, lift, alerts and what the gates made of them."""
    key = ["event_id", "offset_hour"]
    side = lambda kind, name: scored.where(F.col("evaluation_set") == kind).select(*key, F.col("anomaly_score").alias(f"{name}_score"), F.col("alert").alias(f"{name}_alert"), F.col("eligible").alias(f"{name}_eligible"), F.col("scoring_status").alias(f"{name}_status"))
    rows = truth.select(*key, "cell_id", "stratum", "pattern", "severity", "duration", "psap_id", "hour_start_utc", "is_active", "has_numeric_change")
    out = rows.join(side(PAIRED, "baseline"), key, "left").join(side(INJECTED, "injected"), key, "left")
    return out.withColumns({"lift": F.col("injected_score") - F.col("baseline_score"), "new_alert": F.col("injected_alert") & ~F.col("baseline_alert"), "lost_alert": F.col("baseline_alert") & ~F.col("injected_alert")})


def replay_evaluation(
    hourly: DataFrame, cells: DataFrame, head_map: DataFrame, models: DataFrame, detector: Callable[[pd.DataFrame], tuple], cutoff: str, seed: int, folder: str
) -> dict[str, DataFrame]:
    """The stages of a replay by name. hourly: one row an entity and hour; cells: those of E.campaign; head_map: of kpi.fan_out.

    An empty campaign leaves the untouched rows alone in `scored`, and no pairs.
    """
    spark, out = hourly.sparkSession, {}

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{folder}/{name}"
        if not written(spark, path):
            after_cutoff(make(), cutoff).write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
        return out[name]

    truth = stage("truth", lambda: kpi.campaign(hourly, cells, seed)[1])
    rows = stage("rows", lambda: evaluation_rows(hourly, truth))
    heads = stage("heads", lambda: score_heads(kpi.fan_out(rows, head_map), models, detector))
    scored = stage("scored", lambda: gated(heads))
    stage("pairs", lambda: paired_rows(truth, scored))
    return out


def evidence(pairs: DataFrame) -> DataFrame:
    """By pattern: events, rows, unscored rows, events found by alerts and by those that pass the gates, contaminated events, recalls, new and lost alerts, median lift."""
    n = lambda c: F.count(F.when(c, 1))
    events = pairs.groupBy("pattern", "event_id").agg(
        F.count("*").alias("rows"), n(F.col("injected_score").isNull() | F.col("baseline_score").isNull()).alias("unscored"), *(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("injected_alert", "injected_eligible", "baseline_alert")), n(F.col("new_alert")).alias("new_alerts"), n(F.col("lost_alert")).alias("lost_alerts")
    )
    clean = ~F.col("baseline_alert")
    g = events.groupBy("pattern").agg(
        F.count("*").alias("events"), F.sum("rows").alias("rows"), F.sum("unscored").alias("unscored"), n(F.col("injected_alert")).alias("detected"), n(F.col("injected_eligible")).alias("passed_on"), n(F.col("baseline_alert")).alias("contaminated"),
        n(clean & F.col("injected_alert")).alias("attributable"), F.sum("new_alerts").alias("new_alerts"), F.sum("lost_alerts").alias("lost_alerts"),
    )
    rates = {"recall": F.col("detected") / F.col("events"), "attributable_recall": F.try_divide(F.col("attributable").cast("double"), F.col("events") - F.col("contaminated"))}
    # an event has at most six hours and a campaign at most MOST_SPECS events, so a pattern's lifts fit one task
    lift = pairs.groupBy("pattern").agg(F.percentile("lift", F.lit(0.5)).alias("median_lift"))
    return g.withColumns(rates).join(lift, "pattern")
