"""Streaming forms of the hourly KPIs and of alert episodes; bounded runs give the rows of the batch forms (survey 2.11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events per entity and hour of a stream with event time ts, closed once the watermark has passed."""
    hours = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "psap_id").agg(F.count("*").alias("call_volume"))
    return hours.select("psap_id", F.col("window.start").alias("hour_start_utc"), "call_volume")


def episodes(alerts: DataFrame, gap: str = "90 minutes", late: str = "2 hours") -> DataFrame:
    """Alert episodes of a stream (psap_id, ts) as session windows: alerts exactly a gap apart hang together, as in batch."""
    s = alerts.withWatermark("ts", late).groupBy("psap_id", F.session_window("ts", gap)).agg(F.min("ts").alias("episode_start"), F.max("ts").alias("episode_end"), F.count("*").alias("alert_hours"))
    return s.select("psap_id", "episode_start", "episode_end", "alert_hours")
