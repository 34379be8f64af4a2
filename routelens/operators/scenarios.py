"""Fault scenarios given as text, and their canonical forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a scenario by the names they may be given, other names of patterns, patterns, and severities. Fixed values.
FIELDS = {
    "pattern": "pattern", "kpi": "kpis", "kpis": "kpis", "severity": "severity", "duration": "duration_hours", "duration_hours": "duration_hours", "volume": "volume_stratum",
    "volume_stratum": "volume_stratum", "stratum": "volume_stratum",
}
PATTERN_NAMES = {
    "single_kpi_degradation": "kpi_degradation", "single_kpi_failure": "kpi_degradation", "multi_kpi_failure": "multi_kpi_degradation", "improvement_control": "benign_improvement",
    "slow_burn_ramp": "slow_burn", "intermittent": "flapping", "intermittent_flapping": "flapping", "correlated_failure": "correlated_volume_sr", "correlated_volume_success_failure": "correlated_volume_sr",
}
PATTERNS = ("volume_spike", "volume_drop", "kpi_degradation", "multi_kpi_degradation", "benign_improvement", "slow_burn", "flapping", "correlated_volume_sr")
FRACTIONS = {"mild": 0.10, "moderate": 0.25, "severe": 0.50}
DURATIONS = (1, 2, 3, 6)


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def canonical_pattern(c: Column) -> Column:
    """A known pattern by any of its names, else null (F32)."""
    t = F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))
    t = F.coalesce(_map(PATTERN_NAMES)[t], t)
    return F.when(t.isin(*PATTERNS), t)


def canonical_stratum(c: Column) -> Column:
    """low, medium or high; `mid` is medium; else null (F32)."""
    t = F.lower(F.trim(c))
    t = F.when(t == "mid", "medium").otherwise(t)
    return F.when(t.isin("low", "medium", "high"), t)


def severity_fraction(c: Column) -> Column:
    """The fraction of a named severity, or a number in (0, 1]; else null (F32)."""
    t = F.lower(F.trim(c))
    x = F.when(t.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([Ee][-+]?\d+)?$"), t.try_cast("double"))
    return F.coalesce(_map(FRACTIONS)[t], F.when((x > 0) & (x <= 1), x))


def severity_label(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin(*FRACTIONS), t).when(severity_fraction(c).isNotNull(), "custom")


def changed_columns(pattern: Column, kpis: Column) -> Column:
    """The columns that a pattern changes (F32)."""
    volume = F.array(F.lit("CALL_VOLUME"))
    return F.when(pattern.isin("volume_spike", "volume_drop"), volume).when(pattern == "correlated_volume_sr", F.concat(volume, kpis)).otherwise(kpis)


def parse(scenarios: DataFrame, text: str) -> DataFrame:
    """scenarios with pattern, kpis, severity, fraction, duration_hours, volume_stratum and error.

    text: `key=value` fields between commas, KPIs between `+` or `|`. A field without a value, with an unknown or a repeated key, a
    missing or unknown pattern, severity, duration or stratum makes an error, and the other columns null; no row is lost.
    """
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    pairs = F.transform(parts, lambda p: F.struct(F.replace(F.lower(F.trim(F.substring_index(p, "=", 1))), F.lit("-"), F.lit("_")).alias("key"), F.trim(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", ""))).alias("value")))
    named = F.transform(pairs, lambda p: F.struct(_map(FIELDS)[p["key"]].alias("field"), p["value"].alias("value")))
    fields = F.transform(named, lambda p: p["field"])
    out = scenarios.withColumn("__named", named).withColumn("__fields", fields)
    of = lambda name: F.get(F.filter("__named", lambda p: p["field"] == name), F.lit(0))["value"]
    out = out.withColumns({name: of(name) for name in dict.fromkeys(FIELDS.values())})
    pattern, fraction = canonical_pattern(F.col("pattern")), severity_fraction(F.coalesce("severity", F.lit("moderate")))
    duration = F.coalesce("duration_hours", F.lit("1")).try_cast("int")
    kpis = F.filter(F.transform(F.split(F.coalesce("kpis", F.lit("")), "[+|]"), lambda k: F.upper(F.trim(k))), lambda k: k != "")
    error = (
        F.when(F.col(text).isNull() | F.exists("__named", lambda p: p["value"].isNull()), "INVALID_FIELD").when(F.exists("__fields", lambda f: f.isNull()), "UNKNOWN_FIELD")
        .when(F.size("__fields") != F.size(F.array_distinct("__fields")), "REPEATED_FIELD").when(F.exists("__named", lambda p: p["value"] == ""), "EMPTY_FIELD")
        .when(F.col("pattern").isNull(), "NO_PATTERN").when(pattern.isNull(), "UNKNOWN_PATTERN").when(fraction.isNull(), "INVALID_SEVERITY")
        .when(duration.isNull() | ~duration.isin(*DURATIONS), "INVALID_DURATION").when(F.col("volume_stratum").isNotNull() & canonical_stratum(F.col("volume_stratum")).isNull(), "INVALID_STRATUM")
    )
    out = out.withColumn("error", error)
    fine = lambda c: F.when(F.col("error").isNull(), c)
    return out.select(
        *scenarios.columns, fine(pattern).alias("pattern"), fine(kpis).alias("kpis"), fine(severity_label(F.coalesce("severity", F.lit("moderate")))).alias("severity"), fine(fraction).alias("fraction"),
        fine(duration).alias("duration_hours"), fine(canonical_stratum(F.col("volume_stratum"))).alias("volume_stratum"), "error",
    )
