"""Aggregates of root-cause analysis: risk, lift, missingness, evidence and controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalize import joined_unique, safe_rate, wilson_lower


#: Values of a key that no control can be chosen by. Fixed values.
UNUSABLE = ("<MISSING>", "-1")


def has_label() -> Column:
    return F.col("label").isNotNull()


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def long_form(rows: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """keep, feature, value: one row per feature."""
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features))
    return rows.select(*keep, F.explode(pairs).alias("__x")).select(*keep, "__x.feature", "__x.value")


def lift(rows: DataFrame, features: list[str], least_calls: int = 20, least_wrong: int = 3) -> DataFrame:
    """Misroute rate of each feature value against the overall rate (A16). rows: label 0/1 and features."""
    groups = long_form(rows.where(has_label()), features, ["label"]).withColumn("value", F.coalesce("value", F.lit("<MISSING>"))).groupBy("feature", "value").agg(F.count("*").alias("calls"), F.sum("label").alias("misroutes"))
    # every call has one value of each feature, so each feature's groups add up to all calls
    of_feature = W.partitionBy("feature")
    all_calls = groups.withColumn("global_rate", F.sum("misroutes").over(of_feature) / F.sum("calls").over(of_feature))
    out = all_calls.where((F.col("calls") >= least_calls) & (F.col("misroutes") >= least_wrong))
    rate = F.col("misroutes") / F.col("calls")
    return out.select("feature", "value", "calls", "misroutes", rate.alias("rate"), safe_rate(rate, F.col("global_rate")).alias("lift"), (F.col("calls") * F.col("global_rate")).alias("expected"), (F.col("misroutes") - F.col("calls") * F.col("global_rate")).alias("excess"))


def missingness(rows: DataFrame, features: list[str]) -> DataFrame:
    """Calls and misroute rate where each feature is missing and present; empty groups are kept."""
    long = long_form(rows.where(has_label()), features, ["label"])
    missing = F.col("value").isNull() | (F.trim("value") == "")
    one = long.groupBy("feature").agg(*(f(c).alias(n) for c, s in ((missing, "missing"), (~missing, "present")) for f, n in ((count_if, f"{s}_calls"), (lambda c: F.coalesce(F.sum(F.when(c, F.col("label"))), F.lit(0)), f"{s}_misroutes"))))
    states = F.explode(F.array(*(F.struct(F.lit(s.upper()).alias("state"), F.col(f"{s}_calls").alias("calls"), F.col(f"{s}_misroutes").alias("misroutes")) for s in ("missing", "present"))))
    return one.select("feature", states.alias("x")).select("feature", "x.*", safe_rate(F.col("x.misroutes"), F.col("x.calls")).alias("rate"))


def numeric_comparison(rows: DataFrame, features: list[str]) -> DataFrame:
    """Count, mean, min and max of numeric features for correct and misrouted calls, and the difference of means."""
    long = long_form(rows.where(has_label()), features, ["label"]).withColumn("x", F.col("value").try_cast("double")).where("x IS NOT NULL")
    stats = [f(F.when(F.col("label") == v, F.col("x"))).alias(f"{n}_{s}") for s, v in (("correct", 0), ("misroute", 1)) for n, f in (("n", F.count), ("mean", F.avg), ("min", F.min), ("max", F.max))]
    return long.groupBy("feature").agg(*stats).withColumn("difference", F.col("mean_misroute") - F.col("mean_correct"))


def risk(rows: DataFrame, levels: dict[str, Column]) -> DataFrame:
    """Strong and misrouted calls, rate and Wilson bound per entity of each level, in one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("level"), key.cast("string").alias("entity")) for name, key in levels.items())))
    long = rows.where(has_label()).select("label", "call_time", pairs.alias("__x")).select("label", "call_time", "__x.*")
    g = long.groupBy("level", "entity").agg(F.count("*").alias("calls"), F.sum("label").alias("misroutes"), F.count_distinct(F.to_date("call_time")).alias("active_days"))
    return g.withColumn("rate", F.col("misroutes") / F.col("calls")).withColumn("wilson", wilson_lower(F.col("misroutes"), F.col("calls")))


def hierarchical_control(cases: DataFrame, controls: DataFrame, levels: list[tuple[str, list[str], int]]) -> DataFrame:
    """cases with the first level whose keys are usable and whose group holds enough controls, and how many (J11). levels: name, keys, least number; the last is the fallback."""
    out, names, chosen, number = cases, [], F.lit(None).cast("string"), F.lit(None).cast("long")
    for name, keys, _ in levels:
        col = f"__n_{name}"
        if keys:
            out = out.join(controls.groupBy(*keys).agg(F.count("*").alias(col)), keys, "left")
        else:
            out = out.crossJoin(F.broadcast(controls.agg(F.count("*").alias(col))))  # one row
        names.append(col)
    for (name, keys, least), col in reversed(list(zip(levels, names, strict=True))):
        usable = F.lit(True)
        for key in keys:
            usable = usable & F.col(key).isNotNull() & ~F.col(key).cast("string").isin(*UNUSABLE)
        enough = usable & (F.coalesce(F.col(col), F.lit(0)) >= least)
        chosen, number = F.when(enough, F.lit(name)).otherwise(chosen), F.when(enough, F.col(col)).otherwise(number)
    return out.withColumn("control_level", chosen).withColumn("controls", number).drop(*names)


def hypothesis(level: str) -> Column:
    """Root-cause hypothesis from misroutes, pair_share, separation and n_expected."""
    mapping = {"cell": "LIKELY_CELL_TO_PSAP_MAPPING", "esrk": "LIKELY_ESRK_TO_PSAP_MAPPING", "enb": "LIKELY_ENB_TO_PSAP_MAPPING"}.get(level, "REPEATED_PSAP_ROUTING_MAPPING")
    c = F.col
    return (
        F.when(c("misroutes") == 0, "NO_MISROUTE").when((c("misroutes") >= 3) & (c("pair_share") >= 0.8) & (c("separation") >= 3), mapping)
        .when((c("misroutes") >= 3) & (c("n_expected") > 1), "UNSTABLE_OR_MULTIPLE_EXPECTED_PSAP_PATTERN").when(c("separation") < 3, "NEAR_BOUNDARY_OR_LOCATION_REVIEW")
        .when(c("misroutes") >= 2, "REPEATED_PATTERN_LOW_SUPPORT").otherwise("ISOLATED_MISROUTE")
    )


def corroboration(d: dict[str, Column], modes: dict[str, Column]) -> Column:
    """Score 0-100 from rate differences and differing modes (C6). d: route, fallback, lbr, sip, ims, raw_reg, raw_ecscf; modes: route, esinet, esz."""
    p = {k: F.greatest(v, F.lit(0.0)) for k, v in d.items()}
    score = F.when(p["route"] >= 0.20, 35).when(p["route"] >= 0.10, 20).otherwise(0)
    for k, least, points in (("fallback", 0.15, 15), ("lbr", 0.20, 15), ("sip", 0.15, 10), ("ims", 0.15, 10), ("raw_reg", 0.15, 10), ("raw_ecscf", 0.15, 5)):
        score = score + F.when(p[k] >= least, points).otherwise(0)
    for k, points in (("route", 10), ("esinet", 5), ("esz", 5)):
        score = score + F.when(modes[k], points).otherwise(0)
    return F.least(score, F.lit(100))


def conclusion(controls: Column, score: Column, ims: Column, raw: Column) -> Column:
    return (
        F.when(controls < 20, "INSUFFICIENT_MATCHED_CORRECT_CONTROL").when(score >= 50, "STRONG").when(score >= 25, "MODERATE").when(score > 0, "WEAK_OR_MIXED")
        .when((ims < 0.25) & (raw < 0.25), "INSUFFICIENT_IMS_CCDR_ENRICHMENT").otherwise("GEOMETRY_ONLY_NO_NETWORK_DIFFERENTIAL")
    )


EVIDENCE = ("route", "fallback", "lbr", "sip", "ims", "raw_reg", "raw_ecscf")


def cohort_profile(rows: DataFrame, keys: list[str], flags: tuple[str, ...] = EVIDENCE, categories: tuple[str, ...] = ()) -> DataFrame:
    """Per cohort: calls, first and last time, mean of each flag, and mode, its count and share of each category.

    Categories are counted by value before the mode is taken, so that a hot cohort is combined before the shuffle; missing counts as a value.
    """
    out = rows.groupBy(*keys).agg(F.count("*").alias("calls"), F.min("call_time").alias("first_seen"), F.max("call_time").alias("last_seen"), *(F.avg(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f"{f}_rate") for f in flags))
    if categories:
        best = (lambda c: F.min(F.when(F.col("feature") == c, F.struct((-F.col("n")).alias("k"), "value"))))
        counts = long_form(rows, list(categories), keys).withColumn("value", F.coalesce("value", F.lit("<MISSING>"))).groupBy(*keys, "feature", "value").agg(F.count("*").alias("n"))
        modes = counts.groupBy(*keys).agg(*(best(c).alias(f"__{c}") for c in categories))
        modes = modes.select(*keys, *(x for c in categories for x in (F.col(f"__{c}.value").alias(f"{c}_mode"), (-F.col(f"__{c}.k")).alias(f"{c}_mode_count"))))
        out = out.join(modes, keys)
        out = out.withColumns({f"{c}_share": F.col(f"{c}_mode_count") / F.col("calls") for c in categories})
    return out


def matched_evidence(cases: DataFrame, controls: DataFrame, keys: list[str], categories: tuple[str, ...]) -> DataFrame:
    """Case profiles beside the control profile of the same keys, with the difference of each rate (J12, C5). No control gives nulls."""
    control = controls.select(*keys, *(F.col(c).alias(f"control_{c}") for c in controls.columns if c not in keys))
    out = cases.join(control, keys, "left").withColumn("control_calls", F.coalesce("control_calls", F.lit(0)))
    deltas = {f"{f}_delta": F.col(f"{f}_rate") - F.col(f"control_{f}_rate") for f in EVIDENCE}
    differs = {f"{c}_differs": F.coalesce((F.col(f"{c}_mode") != F.col(f"control_{c}_mode")) & (F.col(f"{c}_share") >= 0.5), F.lit(False)) for c in categories}
    return out.withColumns(deltas | differs)


def probable_cause(controls: Column, d: dict[str, Column], route_differs: Column, ims: Column, raw: Column) -> Column:
    """The first cause whose evidence holds (C7). d as for corroboration; ims and raw are the shares of calls with attachments."""
    p = {k: F.coalesce(v, F.lit(0.0)) for k, v in d.items()}
    raw_delta = F.greatest(p["raw_reg"], p["raw_ecscf"])
    return (
        F.when(controls < 20, "INSUFFICIENT_CONTROL").when((p["route"] >= 0.15) | route_differs, "ROUTING_MAPPING_OR_CROSSWALK").when(p["fallback"] >= 0.15, "FALLBACK_OR_DEFAULT_ROUTING")
        .when(p["lbr"] >= 0.20, "LBR_DIFFERENCE").when((p["ims"] >= 0.15) & (raw_delta >= 0.15), "MIXED").when((p["ims"] >= 0.15) | (p["sip"] >= 0.15), "IMS_OR_SIP_SIGNALING")
        .when(raw_delta >= 0.15, "RAW_REGISTRATION_OR_ECSCF").when((ims < 0.25) & (raw < 0.25), "INSUFFICIENT_ENRICHMENT").otherwise("GEOMETRY_ONLY_NETWORK_NORMAL_OR_MIXED")
    )


def pair_summary(rows: DataFrame, level: list[str]) -> DataFrame:
    """Misrouted pairs of each level: calls, active days, distance quantiles, median ratio, and shares of the level's misroutes and of the pair's."""
    wrong = rows.where("label = 1")
    ratio = F.try_divide(F.col("d_routed"), F.col("uncert"))
    g = wrong.groupBy(*level, "routed", "expected").agg(F.count_distinct("call_id").alias("misroutes"), F.count_distinct(F.to_date("call_time")).alias("active_days"), F.percentile("d_routed", F.lit(0.5)).alias("median_d"), F.percentile("d_routed", F.lit(0.95)).alias("p95_d"), F.percentile(ratio, F.lit(0.5)).alias("median_ratio"))
    of_level = g.groupBy(*level).agg(F.sum("misroutes").alias("__l"))
    of_pair = g.groupBy("routed", "expected").agg(F.sum("misroutes").alias("__p"))
    out = g.join(of_level, level).join(of_pair, ["routed", "expected"])
    return out.withColumn("level_share", F.col("misroutes") / F.col("__l")).withColumn("pair_share", F.col("misroutes") / F.col("__p")).drop("__l", "__p")


def entity_hypothesis(rows: DataFrame, level: str, key: str) -> DataFrame:
    """Strong calls, misroutes, top pair's share, separation and hypothesis of each entity."""
    strong = rows.where(has_label())
    g = strong.groupBy(key).agg(F.count("*").alias("strong"), F.sum("label").alias("misroutes"), F.percentile(F.when(F.col("label") == 1, F.try_divide(F.col("d_routed"), F.col("uncert"))), F.lit(0.5)).alias("separation"))
    pairs = strong.where("label = 1").groupBy(key, "routed", "expected").agg(F.count("*").alias("n"))
    top = pairs.groupBy(key).agg(F.max("n").alias("top"), F.count_distinct("expected").alias("n_expected"))
    out = g.join(top, key, "left").withColumn("pair_share", F.try_divide(F.col("top").cast("double"), F.col("misroutes")))
    return out.withColumn("hypothesis", hypothesis(level)).drop("top")


def candidates(hypotheses: DataFrame, key: str, least_strong: int = 5, least_misroutes: int = 3) -> DataFrame:
    """Entities with a complete key and enough strong and misrouted calls to be looked into."""
    return hypotheses.where(F.col(key).isNotNull() & ~F.col(key).cast("string").isin(*UNUSABLE) & (F.col("strong") >= least_strong) & (F.col("misroutes") >= least_misroutes))


def strong_pairs(rows: DataFrame, flags: list[str], ids: str, most_ids: int = 15) -> DataFrame:
    """Report of misrouted pairs: calls, times, distances, flag sums, distinct ids joined (15 and how many more), and rank by calls.

    Distinct ids are few per pair (markets, regions); the rank runs over pairs, which are bounded by the square of the jurisdictions.
    """
    g = rows.where("label = 1").groupBy("routed", "expected").agg(F.count("*").alias("calls"), F.min("call_time").alias("first_seen"), F.max("call_time").alias("last_seen"), F.min("d_routed").alias("min_d"), F.avg("d_routed").alias("avg_d"), F.max("d_routed").alias("max_d"), F.min(F.col("d_routed") - F.col("uncert")).alias("min_clearance"), *(F.sum(F.col(f).cast("long")).alias(f"{f}_calls") for f in flags), joined_unique(F.col(ids), most_ids).alias(f"{ids}_ids"))
    return g.withColumn("rank", F.row_number().over(W.orderBy(F.desc("calls"), "routed", "expected")))


def drill_down(rows: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """rows of the ranked patterns with their rank; the keys meet as normalized text and the first rank wins."""
    norm = lambda c: F.coalesce(F.upper(F.trim(F.col(c).cast("string"))), F.lit("<MISSING>"))
    first = patterns.groupBy(*(norm(k).alias(f"__{k}") for k in keys)).agg(F.min("rank").alias("pattern_rank"))
    return rows.withColumns({f"__{k}": norm(k) for k in keys}).join(first, [f"__{k}" for k in keys]).drop(*(f"__{k}" for k in keys))
