"""Hourly KPI operators: quality, strata, windows, episodes, perturbation, multi-head scores and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Durations of faults in hours, and the most specs of one campaign. Fixed values.
DURATIONS, MOST_SPECS = (1, 2, 3, 6), 10_000
RATES = ("lsr_sr", "asr_sr", "bid_sr", "csr_sr")
#: What each fault pattern changes, and how. Fixed values.
PATTERNS = {
    "volume_spike": (("call_volume",), "up"), "volume_drop": (("call_volume",), "down"), "lsr_drop": (("lsr_sr",), "down"), "asr_drop": (("asr_sr",), "down"),
    "bid_drop": (("bid_sr",), "down"), "csr_drop": (("csr_sr",), "down"), "slow_burn": (RATES, "down"), "flapping": (RATES, "down"), "improvement": (RATES, "improve"),
}


def hour_index(ts: str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp")) / 3600


def quality_issues() -> Column:
    """The issues of a row joined by `;`, empty if none."""
    bad = lambda c: F.isnan(F.col(c).cast("double")) | F.col(c).isNull() | (F.abs(F.col(c).cast("double")) == float("inf"))
    ts = F.col("hour_start_utc").cast("timestamp")
    checks = [
        (ts.isNull(), "INVALID_TIMESTAMP"), (ts.isNotNull() & (F.date_trunc("hour", ts) != ts), "TIMESTAMP_NOT_HOUR_ALIGNED"), (F.col("psap_id").isNull() | (F.col("psap_id") == -1), "INVALID_PSAP_ID"),
        *((bad(c), f"NON_FINITE_{c.upper()}") for c in ("call_volume", *RATES)), (F.col("call_volume") < 0, "NEGATIVE_CALL_VOLUME"),
        *(((F.col(c) < 0) | (F.col(c) > 100), f"OUT_OF_RANGE_{c.upper()}") for c in RATES),
    ]
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in checks))), ";")


def tier_gate() -> Column:
    """Whether an alert passes the tiered sanity gate."""
    b, c, a, s, v = (F.col(x) for x in ("bid_sr", "csr_sr", "asr_sr", "lsr_sr", "call_volume"))
    return (
        F.when((b >= 95) & (c >= 95) & (a >= 85) & (s >= 85), False).when((b >= 90) & (c >= 90), (s <= 45) & (a <= 45) & (v > 20))
        .when((b >= 82) & (c >= 82), (s <= 65) & (a <= 65) & (v > 15)).when((b < 82) & (c < 82), v > 9).otherwise(((s < 70) | (a < 70)) & (v > 12))
    )


def hard_gate(score: Column, threshold: Column) -> Column:
    """Why an alert fails the hard gate, or OK."""
    out = F.lit("OK")
    reasons = [(score <= threshold, "SCORE_NOT_ABOVE_THRESHOLD"), (F.col("call_volume") <= 0, "NO_VOLUME"), (threshold <= 0, "BAD_THRESHOLD")]
    for r in RATES:
        reasons.append(((F.col(r) < 0) | (F.col(r) > 100), f"RATE_OUT_OF_RANGE_{r.upper()}"))
    reasons.append((score.isNull() | threshold.isNull() | F.isnan(score) | F.isnan(threshold), "NON_FINITE"))
    for cond, name in reasons:
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out


def volume_strata(hourly: DataFrame) -> DataFrame:
    """psap_id, median volume and low, medium or high by rank, bands at round-half-even of 2 x position / (n - 1)."""
    medians = hourly.groupBy("psap_id").agg(F.median("call_volume").alias("median_volume"))
    n = medians.agg((F.count("*") - 1).alias("last"))
    # entities are few next to their hours: ranking them is the last, small step
    ranked = medians.withColumn("pos", F.row_number().over(W.orderBy("median_volume", "psap_id")) - 1).crossJoin(F.broadcast(n))
    band = F.bround(2 * F.col("pos") / F.greatest(F.col("last"), F.lit(1)), 0)
    return ranked.select("psap_id", "median_volume", F.when(band == 0, "low").when(band == 1, "medium").otherwise("high").alias("stratum"))


def representatives(strata: DataFrame, k: int) -> DataFrame:
    """Of each stratum the k entities nearest to its median."""
    mid = strata.groupBy("stratum").agg(F.median("median_volume").alias("mid"))
    w = W.partitionBy("stratum").orderBy(F.abs(F.col("median_volume") - F.col("mid")), "psap_id")
    return strata.join(F.broadcast(mid), "stratum").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("stratum", "rank", "psap_id", "median_volume")


def episodes(alerts: DataFrame, entity: str = "psap_id", ts: str = "hour_start_utc", gap_hours: float = 1.5) -> DataFrame:
    """Runs of alert rows of an entity with no gap over gap_hours: start, end and alert hours (W4). alerts: only rows that alert."""
    w = W.partitionBy(entity).orderBy("__h")
    rows = alerts.withColumn("__h", hour_index(ts))
    rows = rows.withColumn("__new", F.coalesce(((F.col("__h") - F.lag("__h").over(w)) > gap_hours).cast("int"), F.lit(1))).withColumn("episode", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(entity, "episode").agg(F.min(ts).alias("episode_start"), F.max(ts).alias("episode_end"), F.count("*").alias("alert_hours"))


def flapping(scored: DataFrame, gap_hours: float = 1.5) -> DataFrame:
    """Changes of alert state between neighbouring hours, of how many chances (W5). scored: psap_id, hour_start_utc, alert."""
    w = W.partitionBy("psap_id").orderBy("hour_start_utc")
    h = hour_index("hour_start_utc")
    rows = scored.withColumn("__h", h).withColumn("gap", F.col("__h") - F.lag("__h").over(w)).withColumn("was", F.lag("alert").over(w))
    near = (F.col("gap") > 0) & (F.col("gap") <= gap_hours)
    return rows.groupBy("psap_id").agg(F.count(F.when(near & (F.col("alert") != F.col("was")), 1)).alias("transitions"), F.count(F.when(near, 1)).alias("opportunities"))


def isolated(episode_rows: DataFrame) -> DataFrame:
    """Entities with one-hour episodes, and how many."""
    return episode_rows.groupBy("psap_id").agg(F.count(F.when(F.col("alert_hours") == 1, 1)).alias("isolated"), F.count("*").alias("episodes")).where("isolated >= 2")


def windows(hourly: DataFrame, hours: int) -> DataFrame:
    """Where an entity has `hours` consecutive hourly rows."""
    w = W.partitionBy("psap_id").orderBy("hour_start_utc")
    last = F.lead(hour_index("hour_start_utc"), hours - 1).over(w)
    return hourly.withColumn("__last", last).where(F.col("__last") == hour_index("hour_start_utc") + hours - 1).select("psap_id", "hour_start_utc")


def missing_hours(hourly: DataFrame) -> DataFrame:
    """Hours between an entity's first and last row that have no row (O3)."""
    span = hourly.groupBy("psap_id").agg(F.min("hour_start_utc").alias("a"), F.max("hour_start_utc").alias("b"))
    grid = span.select("psap_id", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("hour_start_utc"))
    return grid.join(hourly.select("psap_id", "hour_start_utc"), ["psap_id", "hour_start_utc"], "left_anti")


def choose_windows(hourly: DataFrame, specs: DataFrame, seed: int) -> DataFrame:
    """For each spec (ordinal, pattern, severity, duration) the window whose SHA-256 with the seed is least (W8). One pass for all specs."""
    if specs.limit(MOST_SPECS + 1).count() > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} specs")
    w = W.partitionBy("psap_id").orderBy("hour_start_utc")
    length = lambda n: F.lead(hour_index("hour_start_utc"), n - 1).over(w) == hour_index("hour_start_utc") + n - 1
    free = hourly.select("psap_id", "hour_start_utc", F.array_compact(F.array(*(F.when(length(n), F.lit(n)) for n in DURATIONS))).alias("fits")).withColumn("duration", F.explode("fits")).drop("fits")
    out = free.join(F.broadcast(specs), "duration")  # the specs are few and meet the windows of their duration
    if "psap_id" in specs.columns:  # a campaign's cells name their entity
        out = free.join(F.broadcast(specs), ["duration", "psap_id"])
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), *(["cell_id"] if "cell_id" in specs.columns else ["ordinal"]), "pattern", "severity", "duration", "psap_id", F.date_format("hour_start_utc", "yyyy-MM-dd HH:mm:ss")), 256)
    keys = [c for c in specs.columns if c != "psap_id"]
    best = out.groupBy(*keys).agg(F.min(F.struct(h.alias("h"), "psap_id", "hour_start_utc")).alias("b"))
    return best.select(*keys, "b.psap_id", "b.hour_start_utc", F.col("b.h").alias("event_id"))


def campaign(hourly: DataFrame, cells: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Each cell's status and window, and the row truth of those that have one, every cell on untouched rows (C12). cells: cell_id, stratum, psap_id, pattern, severity, duration."""
    chosen = choose_windows(hourly, cells, seed)
    at = chosen.select("cell_id", "hour_start_utc", "event_id")
    status = F.when(F.col("hour_start_utc").isNotNull(), "INJECTED").otherwise("SKIPPED_NO_WINDOW")
    return cells.join(at, "cell_id", "left").withColumn("status", status), perturb(hourly, chosen)


def replay(truth: DataFrame, thresholds: DataFrame, cutoff: str) -> DataFrame:
    """pattern: cells, detected, contaminated, recall, attributable recall and median lift of a volume detector over a campaign.

    truth: perturb() of a campaign; thresholds: psap_id and threshold, fitted before the cutoff. Rows at or before it are an error.
    """
    early = truth.where(F.col("hour_start_utc") <= F.lit(cutoff).cast("timestamp_ntz")).limit(1).count()
    if early:
        raise ValueError(f"replayed rows do not lie after {cutoff}")
    rows = truth.join(F.broadcast(thresholds), "psap_id").withColumns({"was": F.col("call_volume") / F.col("threshold"), "now": F.col("injected_call_volume") / F.col("threshold")})  # one row an entity
    cells = rows.groupBy("cell_id", "pattern").agg((F.max("now") > 1).alias("detected"), (F.max("was") > 1).alias("contaminated"))
    lift = rows.groupBy("pattern").agg(F.percentile(F.col("now") - F.col("was"), F.lit(0.5)).alias("median_lift"))
    n = lambda c: F.count(F.when(c, 1))
    g = cells.groupBy("pattern").agg(F.count("*").alias("cells"), n(F.col("detected")).alias("detected"), n(F.col("contaminated")).alias("contaminated"), n(F.col("detected") & ~F.col("contaminated")).alias("attributable"))
    g = g.withColumns({"recall": F.col("detected") / F.col("cells"), "attributable_recall": F.try_divide(F.col("attributable").cast("double"), F.col("cells") - F.col("contaminated"))})
    return g.drop("attributable").join(lift, "pattern")


def perturb(hourly: DataFrame, chosen: DataFrame) -> DataFrame:
    """Row truth of each chosen window: baseline and injected KPIs by pattern, severity and offset."""
    hours = chosen.withColumn("offset_hour", F.explode(F.sequence(F.lit(0), F.col("duration") - 1))).withColumn("h", F.col("hour_start_utc") + F.make_interval(hours=F.col("offset_hour")))
    rows = hours.drop("hour_start_utc").join(hourly.withColumnRenamed("hour_start_utc", "h"), ["psap_id", "h"])
    f = F.col("severity") * F.when(F.col("pattern") == "slow_burn", (F.col("offset_hour") + 1) / F.col("duration")).otherwise(1.0)
    active = (F.col("pattern") != "flapping") | (F.col("offset_hour") % 2 == 0)
    out = rows.withColumn("is_active", active)
    for kpi in ("call_volume", *RATES):
        v = F.col(kpi)
        up, down = F.greatest(F.ceil(v * (1 + f)), v + 1), F.greatest(F.lit(0.0), F.floor(v * (1 - f)))
        low, better = F.least(F.lit(100.0), F.greatest(F.lit(0.0), v * (1 - f))), F.least(F.lit(100.0), v + (100 - v) * f)
        new = v
        for pattern, (targets, how) in PATTERNS.items():
            if kpi in targets:
                change = {"up": up, "down": down if kpi == "call_volume" else low, "improve": better}[how]
                new = F.when(active & (F.col("pattern") == pattern), change).otherwise(new)
        out = out.withColumn(f"injected_{kpi}", new.cast("double"))
    changed = F.lit(False)
    for kpi in ("call_volume", *RATES):
        changed = changed | (F.abs(F.col(f"injected_{kpi}") - F.col(kpi)) > 1e-12)
    return out.withColumn("has_numeric_change", changed).withColumnRenamed("h", "hour_start_utc")


def fan_out(rows: DataFrame, head_map: DataFrame) -> DataFrame:
    """rows with head_id and head_rank of each candidate head; an entity without heads is its own."""
    joined = rows.join(head_map, rows["psap_id"] == head_map["member_psap_id"], "left")
    return joined.select(rows["*"], F.coalesce("cluster_head_psap_id", "psap_id").alias("head_id"), F.coalesce("cluster_head_rank", F.lit(1)).alias("head_rank"))


def aggregate_heads(per_head: DataFrame, keys: tuple[str, ...] = ("psap_id", "hour_start_utc")) -> DataFrame:
    """One scored row for each of the keys (psap_id among them): mean of score over threshold, votes, spread, status (A30). per_head: raw_score and raw_threshold;
    input_valid and has_detector, where there are such columns, tell what could not be scored."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(True)) if c in per_head.columns else F.lit(True)
    good = flag("input_valid") & flag("has_detector") & F.col("raw_score").isNotNull() & (F.col("raw_threshold") > 0) & ~F.isnan("raw_score")
    ratio = F.when(good, F.col("raw_score") / F.col("raw_threshold"))
    out = per_head.withColumn("r", ratio).groupBy(*keys).agg(
        F.count("*").alias("heads"), F.count("r").alias("scored_heads"), F.avg("r").alias("anomaly_score"), F.count(F.when(F.col("r") > 1, 1)).alias("votes"), F.stddev_pop("r").alias("head_ratio_std"), F.min(flag("input_valid")).alias("__valid"), F.max(flag("has_detector")).alias("__detector")
    )
    status = F.when(F.col("psap_id") == -1, "SKIPPED_SPECIAL_PSAP").when(~F.col("__valid"), "SKIPPED_INVALID_INPUT").when((F.col("scored_heads") == 0) & ~F.col("__detector"), "SKIPPED_NO_DETECTOR").when(F.col("scored_heads") == 0, "SCORING_ERROR").when(F.col("scored_heads") < F.col("heads"), "SCORED_PARTIAL_HEADS").otherwise("SCORED")
    return out.select("*", F.try_divide(F.col("votes").cast("double"), F.col("scored_heads")).alias("vote_fraction"), F.coalesce(F.col("anomaly_score") > 1, F.lit(False)).alias("alert"), status.alias("scoring_status")).drop("__valid", "__detector")


def eligible(alert: Column, hard: Column, third: Column) -> Column:
    """Whether an alert is passed on: by both gates; the third one only looks at alerts."""
    return alert & hard & F.when(alert, third).otherwise(True)


def score_with(rows: DataFrame, head: str, detector, schema: str) -> DataFrame:
    """A user's detector, called with each head's rows as a pandas frame ordered by hour; its failures become a status.

    Rows whose score is not finite or whose threshold is not above 0 are marked. A head's rows lie in one task, as a detector reads a
    whole series: hours of one head are bounded by the length of the history, not by the number of calls.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hour_start_utc")
        try:
            pdf = pdf.assign(raw_score=np.nan, raw_threshold=np.nan, head_status="SCORED")
            pdf["raw_score"], pdf["raw_threshold"] = detector(pdf)
            bad = ~(np.isfinite(pdf["raw_score"].astype(float)) & np.isfinite(pdf["raw_threshold"].astype(float)) & (pdf["raw_threshold"].astype(float) > 0))
            pdf.loc[bad, "head_status"] = "INVALID_SCORE_OR_THRESHOLD"
            return pdf
        except Exception as e:  # noqa: BLE001  the interface promises a status for whatever a detector raises
            return pdf.assign(raw_score=float("nan"), raw_threshold=float("nan"), head_status=f"SCORING_ERROR: {type(e).__name__}")

    return rows.groupBy(head).applyInPandas(run, schema)
