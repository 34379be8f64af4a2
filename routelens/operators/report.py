"""Graded reports: eighteen checks of a deployed model's health, severity monotonicity, and drift by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalize import grade_high, grade_low
from .assoc import below
from .health import mid_rank

#: check: {metric: (direction, passes at, fails beyond)}. Fixed values.
CHECKS = {
    "synthetic_event_detection": {"event_recall": ("high", 0.80, 0.60), "event_precision": ("high", 0.80, 0.60)},
    "synthetic_row_detection": {"row_recall": ("high", 0.75, 0.50), "row_precision": ("high", 0.75, 0.50)},
    "time_to_detection": {"median_delay_hours": ("low", 1.0, 3.0)},
    "score_lift": {"median_ratio_lift": ("high", 0.10, 0.0)},
    "severity_monotonicity": {"median_spearman": ("high", 0.80, 0.50)},
    "minimum_detectable_severity": {"worst_minimum_severity": ("low", 2.0, 3.0)},
    "event_temporal_coverage": {"mean_temporal_coverage": ("high", 0.70, 0.40)},
    "counterfactual_detection_gain": {"attributable_recall": ("high", 0.70, 0.50)},
    "baseline_alert_burden_proxy": {"alerts_per_1000": ("low", 50.0, 100.0)},
    "planned_vs_scored_coverage": {"baseline_coverage": ("high", 0.99, 0.95), "injected_coverage": ("high", 0.99, 0.95)},
    "detector_head_availability": {"missing_detector_rate": ("low", 0.0, 0.05), "missing_head_rate": ("low", 0.0, 0.05)},
    "multi_head_consistency": {"majority_agreement": ("high", 0.80, 0.60), "p95_dispersion": ("low", 0.50, 1.00)},
    "score_threshold_integrity": {"invalid_rows": ("low", 0.0, 0.0)},
    "reference_drift": {"assessed_psi": ("low", 0.10, 0.25)},
    "alert_stability": {"one_hour_episode_share": ("low", 0.50, 0.80), "flapping_rate": ("low", 0.25, 0.50)},
    "cluster_mapping_stability": {"cluster_change_rate": ("low", 0.02, 0.10), "mapping_change_rate": ("low", 0.02, 0.10), "mapping_coverage": ("high", 0.98, 0.90)},
    "benign_controls": {"benign_new_alert_rate": ("low", 0.01, 0.05), "benign_score_increase_rate": ("low", 0.10, 0.30)},
    "raw_vs_sanity_policy": {"sanity_rows_scored": ("high", 1.0, 1.0)},
}


def worst_grade(grade: str = "grade"):
    """Aggregate: FAIL over WARN over PASS; UNKNOWN never worsens."""
    rank = F.when(F.col(grade) == "FAIL", 3).when(F.col(grade) == "WARN", 2).when(F.col(grade) == "PASS", 1).otherwise(0)
    return F.element_at(F.array(*map(F.lit, ("UNKNOWN", "PASS", "WARN", "FAIL"))), F.max(rank) + 1)


def model_health(metrics: DataFrame, checks: dict[str, dict[str, tuple]] = CHECKS) -> DataFrame:
    """check, status and overall of each check (C14). metrics: metric and value, one row each; a missing or null one is UNKNOWN.

    The worst grade of a check's metrics is its status, the worst status is the overall one.
    """
    limits = [(check, metric, *limit) for check, own in checks.items() for metric, limit in own.items()]
    limits = metrics.sparkSession.createDataFrame(limits, "check string, metric string, direction string, pass_at double, fail_at double")
    value = F.col("value")
    grade = F.when(value.isNull() | F.isnan(value), "UNKNOWN").when(F.col("direction") == "high", grade_high(value, F.col("pass_at"), F.col("fail_at"))).otherwise(grade_low(value, F.col("pass_at"), F.col("fail_at")))
    graded = F.broadcast(limits).join(metrics, "metric", "left").withColumn("grade", grade)
    out = graded.groupBy("check").agg(worst_grade().alias("status"))
    return out.withColumn("overall", F.expr("max_by(status, CASE status WHEN 'FAIL' THEN 3 WHEN 'WARN' THEN 2 WHEN 'PASS' THEN 1 ELSE 0 END) OVER ()"))


def monotonicity(pairs: DataFrame) -> DataFrame:
    """pattern, levels, spearman and inversion_rate of the median lift over rising severities (T25). Patterns with one severity are left out."""
    levels = pairs.where("lift IS NOT NULL AND severity IS NOT NULL").groupBy("pattern", "severity").agg(F.percentile("lift", F.lit(0.5)).alias("lift"))
    rising = W.partitionBy("pattern").orderBy("severity")
    rows = levels.select("pattern", mid_rank(["pattern"], "severity").alias("s"), mid_rank(["pattern"], "lift").alias("r"), (F.col("lift") - F.lag("lift").over(rising)).alias("step"))
    g = rows.groupBy("pattern").agg(F.count("*").alias("levels"), F.corr("s", "r").alias("spearman"), F.avg((F.col("step") < 0).cast("double")).alias("inversion_rate"))
    return g.where("levels >= 2")


def top_shares(scored: DataFrame, shares: tuple[float, ...] = (0.05, 0.10)) -> DataFrame:
    """share, rows, precision, recall and lift of the rows with the highest scores.

    Scores are counted by value first; a value that straddles the cut counts in part, in proportion, so ties need no order.
    """
    counts = scored.groupBy("score").agg(F.sum("target").alias("p"), F.count("*").alias("n"))
    total = counts.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    placed = below(counts, [], "score", "n").crossJoin(F.broadcast(total)).withColumn("before", F.col("all_n") - F.col("below") - F.col("n"))  # one row
    rows = placed.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("cut", F.ceil(F.col("all_n") * F.col("share")))
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("cut") - F.col("before")) / F.col("n")))
    g = rows.groupBy("share").agg(F.max("cut").alias("rows"), F.sum(inside * F.col("p")).alias("hits"), F.max("all_p").alias("all_p"), F.max("all_n").alias("all_n"))
    precision = F.col("hits") / F.col("rows")
    return g.select("share", "rows", precision.alias("precision"), F.try_divide("hits", F.col("all_p").cast("double")).alias("recall"), F.try_divide(precision, F.col("all_p") / F.col("all_n")).alias("lift"))


def drift_groups(by_group: DataFrame, least: int = 12, top: int = 20) -> DataFrame:
    """dimension, group, psi, rows and rank of the groups that drifted most, and of each dimension its groups, largest and 95th percentile.

    by_group: dimension, group, psi, n_reference and n_current. Groups with fewer than `least` rows on either side do not count.
    """
    counted = by_group.where((F.col("n_reference") >= least) & (F.col("n_current") >= least) & F.col("psi").isNotNull())
    of_dimension = W.partitionBy("dimension")
    rows = counted.withColumns({"groups": F.count("*").over(of_dimension), "max_psi": F.max("psi").over(of_dimension), "p95_psi": F.percentile("psi", F.lit(0.95)).over(of_dimension)})
    rank = F.row_number().over(of_dimension.orderBy(F.desc("psi"), "group"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)


#: section: {metric: (direction, warns from, fails from)} of a deployed text classifier. Fixed values.
SECTIONS = {
    "input_health": {"ticket_count": ("low", 50.0, 0.0), "missing_text_rate_pct": ("high", 1.0, 5.0), "short_text_rate_pct": ("high", 10.0, 25.0), "duplicate_id_rate_pct": ("high", 0.5, 2.0), "source_freshness_hours": ("high", 48.0, 168.0), "volume_change_pct": ("high", 50.0, 80.0)},
    "prediction_health": {"average_prediction_confidence": ("low", 0.65, 0.50), "low_confidence_rate_pct": ("high", 20.0, 40.0), "production_api_success_rate_pct": ("low", 99.0, 95.0), "production_api_average_latency_ms": ("high", 1000.0, 3000.0)},
    "historical_comparison": {"prediction_distribution_jsd": ("high", 0.10, 0.20), "unseen_token_rate_pct": ("high", 15.0, 30.0), "token_distribution_jsd": ("high", 0.10, 0.20)},
    "independent_evaluation": {"production_accuracy": ("low", 0.70, 0.65), "production_weighted_f1": ("low", 0.70, 0.55), "challenger_disagreement_rate_pct": ("high", 15.0, 30.0)},
}


def classifier_health(metrics: DataFrame, sections: dict[str, dict[str, tuple]] = SECTIONS) -> DataFrame:
    """section, metric, value, status, signal, and the overall and collection status of a text classifier (C15). metrics: metric and value.

    A metric at its limits is already beyond them. Three sections with a failure are CRITICAL, one is DEGRADED; else a warning counts.
    A metric without a value is UNKNOWN and makes the collection PARTIAL. signal: whether the metric is to be reported.
    """
    limits = [(s, m, *limit) for s, own in sections.items() for m, limit in own.items()]
    limits = metrics.sparkSession.createDataFrame(limits, "section string, metric string, direction string, warn double, fail double")
    v = F.col("value")
    beyond = lambda c: F.when(F.col("direction") == "high", v >= F.col(c)).otherwise(v <= F.col(c))
    status = F.when(v.isNull() | F.isnan(v), "UNKNOWN").when(beyond("fail"), "FAIL").when(beyond("warn"), "WARN").otherwise("PASS")
    rows = F.broadcast(limits).join(metrics, "metric", "left").withColumn("status", status)
    of_all = W.partitionBy()  # a row for each metric
    failed = F.size(F.collect_set(F.when(F.col("status") == "FAIL", F.col("section"))).over(of_all))
    some = lambda s: F.max((F.col("status") == s).cast("int")).over(of_all) == 1
    overall = F.when(failed >= 3, "CRITICAL").when(failed >= 1, "DEGRADED").when(some("WARN"), "WARNING").when(some("PASS"), "HEALTHY").otherwise("UNKNOWN")
    collection = F.when(F.max(F.when(F.col("metric") == "ticket_count", v)).over(of_all) == 0, "FAILED").when(some("UNKNOWN"), "PARTIAL").otherwise("COMPLETE")
    return rows.select("section", "metric", "value", "status", F.col("status").isin("WARN", "FAIL").alias("signal"), overall.alias("overall"), collection.alias("collection_status"))


#: Least rows for a type, most levels of a category, and name parts of times. Fixed values.
LEAST_ROWS, MOST_LEVELS, TIME_PARTS = 100, 300, "DATE|TIME"


def feature_inventory(df: DataFrame, entities: tuple[str, ...] = (), ids: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> DataFrame:
    """feature, rows, non_null, distinct values, share of numbers, mean length and inferred type of each column.

    entities, ids, texts: parts of names that decide before the values do. Values are counted first, so that all shuffles are of counts.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns)))
    counts = df.select(each.alias("x")).select("x.*").groupBy("feature", "v").agg(F.count("*").alias("n"))
    number = F.replace(F.col("v"), F.lit(","), F.lit("")).try_cast("double").isNotNull()
    there = F.col("v").isNotNull()
    g = counts.groupBy("feature").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("non_null"), F.count("v").alias("n_unique"),
        F.sum(F.when(there & number, F.col("n")).otherwise(0)).alias("__numbers"), F.sum(F.when(there, F.col("n") * F.length("v"))).alias("__length"),
    )
    g = g.withColumns({"numeric_ratio": F.coalesce(F.try_divide(F.col("__numbers").cast("double"), F.col("non_null")), F.lit(0.0)), "average_length": F.coalesce(F.try_divide(F.col("__length").cast("double"), F.col("non_null")), F.lit(0.0))})
    name = F.upper("feature")
    named = lambda parts: name.rlike("|".join(parts)) if parts else F.lit(False)
    kind = (
        F.when(F.col("non_null") < LEAST_ROWS, "INSUFFICIENT_DATA").when(name.rlike(TIME_PARTS) & ~F.col("feature").startswith("TIME__"), "DATETIME").when(named(entities), "CATEGORICAL_ENTITY").when(named(ids), "UNIQUE_IDENTIFIER")
        .when((F.col("numeric_ratio") >= 0.95) & (F.col("n_unique") > 2), "NUMERIC").when(F.col("n_unique") <= 2, "CATEGORICAL").when(named(texts) | (F.col("average_length") >= 20) & (F.col("n_unique") > MOST_LEVELS), "TEXT")
        .when((F.col("n_unique") <= MOST_LEVELS) | (F.try_divide("n_unique", F.col("non_null").cast("double")) <= 0.20), "CATEGORICAL").otherwise("HIGH_CARDINALITY")
    )
    return g.withColumn("inferred_type", kind).drop("__numbers", "__length")
