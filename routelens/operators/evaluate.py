"""Replay evaluation: truth against untouched and injected scores, recall, coverage, agreement, integrity and mapping stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["psap_id", "hour_start_utc"]


def share(c: Column) -> Column:
    """Share of rows where a condition holds; unknown counts as not."""
    return F.avg(F.coalesce(c, F.lit(False)).cast("double"))


def campaign(patterns: list[str], severities: list[float], durations: list[int], representatives: DataFrame) -> DataFrame:
    """Every pattern, severity and duration for each representative entity of each stratum, numbered."""
    levels = lambda values, name: F.explode(F.array(*map(F.lit, values))).alias(name)
    cells = representatives.select("stratum", "psap_id", levels(patterns, "pattern")).select("*", levels(severities, "severity")).select("*", levels(durations, "duration"))
    return cells.select(F.concat_ws("|", "stratum", "psap_id", "pattern", "severity", "duration").alias("cell_id"), "*")


def logical_rows(per_head: DataFrame, by: list[str]) -> DataFrame:
    """Per-head rows collapsed: mean ratio, any sanity pass, heads, and the status of the first-ranked head that has one."""
    first = F.min(F.when(F.col("status").isNotNull(), F.struct("head_rank", "status")))["status"]
    return per_head.groupBy(*by).agg(F.avg("ratio").alias("ratio"), F.max("sanity").alias("sanity"), F.count("*").alias("heads"), first.alias("status"))


def truth_scores(truth: DataFrame, scores: DataFrame) -> DataFrame:
    """truth with ratio: the score of the same event, entity and hour, else the largest of the entity and hour."""
    exact = scores.where("event_id IS NOT NULL").groupBy("event_id", *KEY).agg(F.max("ratio").alias("__exact"))
    other = scores.groupBy(*KEY).agg(F.max("ratio").alias("__other"))
    out = truth.join(exact, ["event_id", *KEY], "left").join(other, KEY, "left")
    return out.withColumn("ratio", F.coalesce("__exact", "__other")).drop("__exact", "__other")


def paired(truth: DataFrame, untouched: DataFrame, injected: DataFrame) -> DataFrame:
    """truth with baseline_ratio, injected_ratio, lift and four flags (J15, J24). untouched has one row per entity and hour."""
    base = untouched.select(*KEY, F.col("ratio").alias("baseline_ratio"))
    out = truth_scores(truth, injected).withColumnRenamed("ratio", "injected_ratio").join(base, KEY, "left")
    was, now = F.coalesce(F.col("baseline_ratio") > 1, F.lit(False)), F.coalesce(F.col("injected_ratio") > 1, F.lit(False))
    flags = {"baseline_alert": was, "injected_alert": now, "new_alert": now & ~was, "lost_alert": was & ~now}
    return out.withColumn("lift", F.col("injected_ratio") - F.col("baseline_ratio")).withColumns(flags)


def score_lift(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean and quartiles of the lift, and how often it is above zero."""
    q = [F.percentile("lift", F.lit(p)).alias(n) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))]
    return pairs.where("lift IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), F.avg("lift").alias("mean"), *q, share(F.col("lift") > 0).alias("positive_rate"))


def detection_delay(matches: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean, median, 90th percentile and maximum of the delay of detected events."""
    q = [F.percentile("delay_hours", F.lit(p)).alias(n) for n, p in (("median", 0.5), ("p90", 0.9))]
    return matches.where("delay_hours IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), F.avg("delay_hours").alias("mean"), *q, F.max("delay_hours").alias("max"))


def event_outcomes(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per event: affected and alerted hours, detected, and contaminated by an untouched alert within it.

    Hours of an event meet untouched rows by equality of entity and hour, so no range join is needed.
    """
    n = lambda c: F.count(F.when(F.col(c), 1))
    out = pairs.groupBy("event_id", *keep).agg(F.count("*").alias("affected"), n("injected_alert").alias("alerted"), n("baseline_alert").alias("untouched_alerts"))
    return out.withColumn("detected", F.col("alerted") > 0).withColumn("contaminated", F.col("untouched_alerts") > 0)


def recall_sets(events: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Events, detected and recall by several groupings in one pass."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    out = events.groupingSets([[F.col(c) for c in s] for s in sets], *names)
    return out.agg(F.count("*").alias("events"), F.count(F.when(F.col("detected"), 1)).alias("found"), share(F.col("detected")).alias("recall"))


def temporal_coverage(events: DataFrame, by: list[str]) -> DataFrame:
    """Alerted over affected hours of each event: mean, median, and the share of events fully covered."""
    c = F.col("alerted") / F.col("affected")
    return events.groupBy(*by).agg(F.count("*").alias("events"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), share(c >= 1).alias("fully_covered"))


def attributable_recall(events: DataFrame, by: list[str]) -> DataFrame:
    """Recall over events that no untouched alert contaminates; groups without any keep a null recall."""
    clean = ~F.col("contaminated")
    n, k = F.count(F.when(clean, 1)), F.count(F.when(clean & F.col("detected"), 1))
    return events.groupBy(*by).agg(F.count("*").alias("events"), n.alias("clean_events"), k.alias("found"), F.try_divide(k.cast("double"), n).alias("recall"))


def benign(pairs: DataFrame, by: list[str]) -> DataFrame:
    """What changes that should not alarm do: new alerts, raised scores, median and largest change."""
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), share(F.col("new_alert")).alias("new_alert_rate"), share(F.col("lift") > 0).alias("increase_rate"), F.percentile("lift", F.lit(0.5)).alias("median_delta"), F.max("lift").alias("max_delta"))


def minimum_severity(events: DataFrame, by: list[str], target: float) -> DataFrame:
    """The lowest severity with recall of at least target at it and at every higher one, null if none (A41). Levels are few, so they fold in one array per group."""
    levels = events.groupBy(*by, "severity").agg(share(F.col("detected")).alias("recall"))
    g = levels.groupBy(*by).agg(F.count("*").alias("levels"), F.max(F.when(F.col("recall") < target, F.col("severity"))).alias("__fails"), F.collect_set("severity").alias("__s"))
    good = F.array_min(F.filter("__s", lambda s: F.col("__fails").isNull() | (s > F.col("__fails"))))
    return g.select(*by, "levels", good.alias("minimum_severity"))


def scoring_metadata(scored: DataFrame, planned: DataFrame, by: list[str]) -> DataFrame:
    """Planned, scored and missing rows, crossings, errors and coverage (A32, A42). planned and scored: by, entity and hour."""
    have = scored.select(*KEY, "ratio", "status")
    j = planned.join(have, KEY, "left")
    n = lambda c: F.count(F.when(c, 1))
    ok = F.col("ratio").isNotNull()
    return j.groupBy(*by).agg(F.count("*").alias("planned"), n(ok).alias("scored"), n(F.col("status") == "SCORING_ERROR").alias("errors"), n(F.col("ratio") > 1).alias("crossings"), share(ok).alias("coverage"))


def component_availability(per_head: DataFrame) -> DataFrame:
    """Rows and missing rate of each head."""
    return per_head.groupBy("head_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("ratio").isNull(), 1)).alias("missing"), share(F.col("ratio").isNull()).alias("missing_rate"))


def head_agreement(per_head: DataFrame) -> DataFrame:
    """Over rows with two or more scored heads: majority agreement, share where all agree, mean and 95th percentile of the spread."""
    rows = per_head.where("ratio IS NOT NULL").groupBy(*KEY).agg(F.count("*").alias("h"), share(F.col("ratio") > 1).alias("v"), F.stddev_pop("ratio").alias("spread")).where("h >= 2")
    major = F.greatest(F.col("v"), 1 - F.col("v"))
    return rows.agg(F.count("*").alias("n"), F.avg(major).alias("majority_agreement"), share(major >= 1).alias("all_agree"), F.avg("spread").alias("mean_spread"), F.percentile("spread", F.lit(0.95)).alias("p95_spread"))


def score_integrity(scored: DataFrame) -> DataFrame:
    """Non-finite scores, bad thresholds, explicit alerts that differ, suppressed crossings, and the ratio's distribution (A45). scored: score, threshold, alert, eligible."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    n = lambda c: F.count(F.when(c, 1))
    good = finite("score") & finite("threshold") & (F.col("threshold") > 0)
    crossing, ratio = good & (F.col("score") > F.col("threshold")), F.when(good, F.col("score") / F.col("threshold"))
    q = [F.percentile(ratio, F.lit(p)).alias(k) for k, p in (("ratio_p50", 0.5), ("ratio_p95", 0.95), ("ratio_p99", 0.99))]
    suppressed = F.try_divide(n(crossing & ~F.col("eligible")).cast("double"), n(crossing))
    return scored.agg(F.count("*").alias("n"), n(~finite("score")).alias("non_finite"), n(~finite("threshold") | (F.col("threshold") <= 0)).alias("bad_threshold"), n(F.col("alert") != crossing).alias("alert_mismatch"), suppressed.alias("suppression_rate"), *q)


def latest_mapping(rows: DataFrame) -> DataFrame:
    """The last cluster and head of each entity; ties go to the larger (J19). An aggregate, so hot entities combine before the shuffle."""
    return rows.groupBy("psap_id").agg(F.max(F.struct("hour_start_utc", "cluster", "head_id")).alias("m")).select("psap_id", F.col("m.cluster").alias("cluster"), F.col("m.head_id").alias("head_id"))


def mapping_stability(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Entities on both sides and on one, and how often cluster and head changed."""
    a, b = latest_mapping(reference).withColumn("in_a", F.lit(1)), latest_mapping(current).withColumn("in_b", F.lit(1))
    j = a.select("psap_id", F.col("cluster").alias("c0"), F.col("head_id").alias("h0"), "in_a").join(b, "psap_id", "full_outer")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    rate = lambda x, y: F.avg(F.when(both, (~F.col(x).eqNullSafe(F.col(y))).cast("double")))
    n = lambda c: F.count(F.when(c, 1))
    return j.agg(n(both).alias("common"), n(F.col("in_b").isNull()).alias("gone"), n(F.col("in_a").isNull()).alias("added"), rate("c0", "cluster").alias("cluster_change"), rate("h0", "head_id").alias("head_change"))


def mapping_conflicts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Entities that two mapping tables put in more than one cluster (J23). Empty when the tables agree."""
    both = first.select("psap_id", "cluster").unionByName(second.select("psap_id", "cluster")).where("cluster IS NOT NULL")
    return both.groupBy("psap_id").agg(F.count_distinct("cluster").alias("clusters"), F.min("cluster").alias("lowest"), F.max("cluster").alias("highest")).where("clusters > 1")


def trusted(rows: DataFrame, key: str, at: str, now: Column, mature_hours: int = 168, cutoff: Column | None = None) -> DataFrame:
    """Rows whose labels are mature and after the cutoff, the last of each key."""
    keep = F.col(at) <= now - F.make_dt_interval(hours=F.lit(mature_hours))
    rows = rows.where(keep if cutoff is None else keep & (F.col(at) > cutoff))
    rest = [c for c in rows.columns if c not in (key, at)]
    return rows.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("r")).select(key, "r.*")
