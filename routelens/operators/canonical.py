"""Canonical rows of calls, scores and truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import column_name, entity_key, expected_behaviour, health_flag, norm_id, parse_utc, severity_number, tagged
from ..sources.contracts import plain, resolve

#: Names under which inputs hold the columns of scores and truth. Fixed values; case and punctuation do not count.
SCORED = {
    "psap": ("psap_id", "member_psap_id"), "timestamp": ("timestamp", "eval_timestamp", "eval_ts_utc", "run_ts_utc", "hour_start_utc", "datetime", "date_hour"), "event": ("event_id", "injection_id"),
    "score": ("anomaly_score", "score", "raw_score"), "threshold": ("anomaly_thresh", "anomaly_threshold", "threshold", "raw_threshold"),
    "raw_alert": ("raw_alert", "is_anomaly", "predicted_anomaly", "alert", "raw_threshold_crossing", "vote"), "sanity_alert": ("sanity_eligible_alert", "eligible_alert", "policy_alert"),
    "hard_pass": ("hard_sanity_pass",), "third_pass": ("third_level_pass",),
}
TRUTH = {
    "event": ("event_id", "injection_id"), "psap": ("psap_id", "member_psap_id"), "timestamp": ("timestamp", "eval_timestamp", "hour_start_utc", "datetime", "date_hour"), "start": ("start_time", "event_start", "event_start_utc", "start_timestamp"),
    "end": ("end_time", "event_end", "event_end_utc", "end_timestamp"), "duration": ("duration_hours", "duration"), "expected": ("expected_behavior", "expected"), "should_detect": ("should_detect", "expected_alert", "is_ground_truth_anomaly"),
    "active": ("is_active", "active"), "numeric_change": ("has_numeric_change", "numeric_change"), "pattern": ("pattern", "injection_type", "fault_type"), "severity": ("severity", "severity_level"),
    "volume_stratum": ("volume_stratum", "volume_band"), "tolerance": ("detection_tolerance_hours", "tolerance_hours"),
}
CONTROLLED_TEXTS = ("CALL_TYPE", "USER_TYPE", "ENV", "INPUT_FILE_NAME", "PSAP_NAME")
TEST_TEXT = r"(?i)(?:^|[^A-Z])(?:TEST|SIMULATED|PSAP[ _-]*SIM)(?:[^A-Z]|$)"


def tag_tests(calls: DataFrame, test: str = "TEST_CALL", sim: str = "PSAP_SIM_CALL", texts: tuple[str, ...] = CONTROLLED_TEXTS) -> DataFrame:
    """calls with is_test_or_sim, reason and population: by either flag, else by the first of the texts that says so."""
    flag = lambda c: tagged(F.col(c)) if c in calls.columns else F.lit(False)
    t, s = flag(test), flag(sim)
    said = F.coalesce(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).rlike(TEST_TEXT), c) for c in texts if c in calls.columns), F.lit(None).cast("string"))
    out = calls.withColumns({"is_test_or_sim": t | s | said.isNotNull(), "reason": F.when(t & s, f"{test}+{sim}").when(t, test).when(s, sim).when(said.isNotNull(), F.concat(F.lit("CONTROLLED_TEXT:"), said)).otherwise("NONE")})
    return out.withColumn("population", F.when(t & s, "TEST_AND_SIM").when(t, "TEST").when(s, "PSAP_SIM").when(said.isNotNull(), "POSSIBLE_TEST_SIM").otherwise("STANDARD_OR_UNSPECIFIED"))


def distance_band(calls: DataFrame, distance: str, low: float, high: float | None = None, intersects: str | None = None) -> DataFrame:
    """Calls at least low and at most high metres away, whose area does not reach the polygon if a flag says so."""
    keep = F.col(distance) >= low
    if high is not None:
        keep = keep & (F.col(distance) <= high)
    if intersects is not None:
        keep = keep & norm_id(F.col(intersects)).isin("0", "FALSE", "NO")
    return calls.where(keep)


def clean_calls(calls: DataFrame, test: str = "is_test_or_sim", conflict: str = "conflict") -> DataFrame:
    """Calls that are neither tests nor conflicted (P9). Unknown flags count as not set."""
    return calls.where(~F.coalesce(F.col(test), F.lit(False)) & ~F.coalesce(F.col(conflict), F.lit(False)))


def case_target(calls: DataFrame, distance: str, threshold: float, differs: Column | None = None) -> DataFrame:
    """Calls with a valid distance and their target: beyond the threshold, and under the condition if there is one; an unknown condition is never a control."""
    d = F.col(distance)
    far = d > threshold
    target = far if differs is None else far & differs
    return calls.where((d >= 0) & (d < float("inf"))).withColumn("target", F.when(target, 1).when(~target, 0)).where("target IS NOT NULL")


def _has(df: DataFrame, aliases: tuple[str, ...]) -> bool:
    return bool({plain(a) for a in aliases} & {plain(c) for c in df.columns})


def scored_rows(df: DataFrame) -> DataFrame:
    """psap, timestamp, event, score, threshold, explicit_alert, ratio, raw_alert and sanity_alert.

    Alerts and ratios are rebuilt from score and threshold, equality being no alert; an explicit alert is only for comparison, or
    where df has no score. The gated alert is its own column, or else the raw alert that passes both gates.
    """
    s = resolve(df, SCORED)
    score, threshold = F.col("score").try_cast("double"), F.col("threshold").try_cast("double")
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    valid = finite(score) & finite(threshold) & (threshold > 0)
    explicit = health_flag(F.col("raw_alert"))
    raw = F.when(valid, score > threshold) if _has(df, SCORED["score"]) and _has(df, SCORED["threshold"]) else explicit
    gated = health_flag(F.col("sanity_alert")) if _has(df, SCORED["sanity_alert"]) else raw & health_flag(F.col("hard_pass")) & health_flag(F.col("third_pass"))
    return s.select(
        entity_key(F.col("psap")).alias("psap"), parse_utc(F.col("timestamp")).alias("timestamp"), entity_key(F.col("event")).alias("event"), score.alias("score"), threshold.alias("threshold"),
        explicit.alias("explicit_alert"), F.when(valid, score / threshold).alias("ratio"), raw.alias("raw_alert"), gated.alias("sanity_alert"),
    )


def event_truth(df: DataFrame, tolerance_hours: float = 1.0) -> DataFrame:
    """event_id, psap, start, end, expected, pattern, severity, volume_stratum and tolerance_hours (P22). A missing end is start and duration."""
    t = resolve(df, TRUTH)
    start = F.coalesce(parse_utc(F.col("start")), parse_utc(F.col("timestamp")))
    hours = F.coalesce(F.col("duration").try_cast("double"), F.lit(0.0))
    late = F.timestamp_micros(F.unix_micros(start) + (hours * 3_600_000_000).cast("long"))
    given, should = expected_behaviour(F.col("expected")), health_flag(F.col("should_detect"))
    has = lambda key: _has(df, TRUTH[key])
    expected = given if has("expected") else F.when(F.coalesce(should, F.lit(False)), "DETECT").otherwise("NO_INCREASE") if has("should_detect") else F.lit("DETECT")
    return t.select(
        entity_key(F.col("event")).alias("event_id"), entity_key(F.col("psap")).alias("psap"), start.alias("start"), F.coalesce(parse_utc(F.col("end")), late).alias("end"), expected.alias("expected"),
        column_name(F.col("pattern")).alias("pattern"), severity_number(F.col("severity")).alias("severity"), entity_key(F.col("volume_stratum")).alias("volume_stratum"),
        F.coalesce(F.col("tolerance").try_cast("double"), F.lit(tolerance_hours)).alias("tolerance_hours"),
    )


def row_truth(df: DataFrame) -> DataFrame:
    """event_id, psap, timestamp, should_detect, is_active and has_numeric_change (P23). Without should_detect, a row counts if it is to be detected, active and changed."""
    t = resolve(df, TRUTH)
    has = lambda key: _has(df, TRUTH[key])
    flag = lambda key: F.coalesce(health_flag(F.col(key)), F.lit(False)) if has(key) else F.lit(True)
    active, changed = flag("active"), flag("numeric_change")
    wanted = F.coalesce(expected_behaviour(F.col("expected")) == "DETECT", F.lit(False)) & active & changed
    should = health_flag(F.col("should_detect")) if has("should_detect") else wanted if has("expected") else F.lit(None).cast("boolean")
    return t.select(entity_key(F.col("event")).alias("event_id"), entity_key(F.col("psap")).alias("psap"), parse_utc(F.col("timestamp")).alias("timestamp"), should.alias("should_detect"), active.alias("is_active"), changed.alias("has_numeric_change"))
