"""Contracts of inputs: aliases, time columns, feature roles and types, inventories."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import number_in, parse_utc

#: Feature names by what they would give away, and name parts that do. Fixed values.
LEAKAGE = frozenset(
    "LATITUDE LONGITUDE ROUTED_FCC_PSAP_ID EXPECTED_FCC_PSAP_ID CENTER_PSAP_IDS UNCERTAINTY_OVERLAP_PSAP_IDS ROUTE_INTEGRITY_STATUS MISROUTE_LABEL LABEL_ELIGIBLE ROUTED_CONTAINS_CENTER "
    "ROUTED_INTERSECTS_UNCERTAINTY DISTANCE_TO_ROUTED_BOUNDARY_M FCC_PSAP_ID PSAP_ID PSAP_NAME".split()
)
LEAKAGE_PARTS = (
    "LATITUDE LONGITUDE EXPECTED_FCC ROUTED_FCC ROUTE_INTEGRITY MISROUTE LABEL_ELIGIBLE BOUNDARY_AVAILABLE CONTAINS_CENTER INTERSECTS_UNCERTAINTY UNCERTAINTY_OVERLAP DISTANCE_TO_ROUTED_BOUNDARY".split()
)
JOIN_KEYS = frozenset("PLRF_CID HDR_TRID CTID UNIQ911_CID SCHEDULE_ID TESTSIM_ID".split())
DUPLICATES = frozenset("LATITUDE_NUM LONGITUDE_NUM UNCERT_METERS_NUM".split())
TIME_KEYS = frozenset("CALL_DATE CALL_BEGIN_TIME CALL_END_TIME CALL_BEGIN_TIME_UTC CALL_END_TIME_UTC LOCATE_BEGIN_TIME LOCATE_BEGIN_TIME_UTC DATETIME_INS EVENT_TIME_UTC".split())
CONSEQUENCES = frozenset(
    "COMPLETE_CALL CALL_DURATION_SEC ESRK_MATCH_YN VALIDATION_PASSED EMAIL_YN TEXTMSG_YN SUMMARY_YN CLASS_OF_SERVICE_YN ROUTE_STATUS_GMLC LRR_INVITE_STATUS SIP_STATUS DEFAULT_ROUTED_CALL PSAP_SIM_CALL "
    "EXCEPTION_FLAG DR_CNT DR_CALL_CNT Z_RELAYED2PSAP".split()
)
NUMERIC_PARTS = "UNCERT CONFIDENCE LOCATE_TIME COUNT _CNT ATTEMPTS DURATION P2_ FAIL_LOCATE P2BEYOND DR_ E2VALIDATED RELAYED RANGE".split()


def plain(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", name.lower())


def resolve(df: DataFrame, contract: dict[str, tuple[str, ...]], types: dict[str, str] | None = None) -> DataFrame:
    """The contract's columns under their own names (P5): of each one's aliases the first that df has, whatever its case and punctuation; a typed null where it has none."""
    there = {plain(c): c for c in df.columns}
    found = {name: next((there[plain(a)] for a in aliases if plain(a) in there), None) for name, aliases in contract.items()}
    return df.select(*((F.col(f"`{c}`") if c else F.lit(None).cast((types or {}).get(name, "string"))).alias(name) for name, c in found.items()))


def first_time(df: DataFrame, names: list[str]) -> Column:
    """The first of the columns that exist whose text is a time."""
    found = [parse_utc(F.col(c)) for c in names if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("timestamp")


def best_time_column(df: DataFrame, names: list[str], probe: int = 10_000, least: float = 0.5) -> str:
    """The column with the largest share of times among the first rows; an error below the least share (P3). Of equal shares the first."""
    there = [c for c in names if c in df.columns]
    shares = df.limit(probe).agg(*(F.avg(parse_utc(F.col(c)).isNotNull().cast("double")).alias(c) for c in there)).first().asDict() if there else {}
    best = max(there, key=lambda c: shares[c] or 0.0, default=None)
    if best is None or (shares[best] or 0.0) < least:
        raise ValueError(f"no column of {names} holds times")
    return best


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """All columns but the keys with a prefix."""
    return df.select(*(F.col(f"`{c}`").alias(c if c in keys else prefix + c) for c in df.columns))


def last_days(df: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows of the days that end at the midnight after the latest row (P10)."""
    end = df.agg((F.date_trunc("day", F.max(ts)) + F.expr("INTERVAL 1 DAY")).alias("__end"))
    return df.crossJoin(F.broadcast(end)).where((F.col(ts) >= F.col("__end") - F.make_dt_interval(F.lit(days))) & (F.col(ts) < F.col("__end"))).drop("__end")  # one row


#: Roles by what a name is or holds, the first rule that fits; a prefix of the source doesn't count. The rest may predict.
SOURCE_PREFIX = "^(GMLC_)?(LSR_)?"
ROLES = (
    ("LABEL_OR_GEOMETRY_LEAKAGE", "is", LEAKAGE),
    ("LABEL_OR_GEOMETRY_LEAKAGE", "holds", LEAKAGE_PARTS),
    ("TECHNICAL_JOIN_KEY", "is", JOIN_KEYS),
    ("TECHNICAL_JOIN_KEY", "holds", ("FEATURE_ROW_ID",)),
    ("DERIVED_DUPLICATE", "is", DUPLICATES),
    ("RAW_TIME_KEY", "is", TIME_KEYS),
    ("POST_ROUTING_CONSEQUENCE", "is", CONSEQUENCES),
)
CANDIDATE = "PREDICTOR_CANDIDATE"


def role(name: Column) -> Column:
    """What a feature may be used for, by its name (P12). A null name has no role."""
    base = F.regexp_replace(name, SOURCE_PREFIX, "")
    fits = {"is": lambda values: base.isin(*sorted(values)), "holds": lambda parts: base.rlike("|".join(parts))}
    return F.when(name.isNotNull(), F.coalesce(*(F.when(fits[how](values), F.lit(what)) for what, how, values in ROLES), F.lit(CANDIDATE)))


def feature_types(df: DataFrame) -> DataFrame:
    """feature, role, share of numbers, distinct values and type (numeric, categorical, or null) of each usable column, in one pass."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns)))
    counts = df.select(cells.alias("x")).select("x.*").groupBy("feature", "v").agg(F.count("*").alias("n"))  # values first: combined before the shuffle
    g = counts.groupBy("feature").agg((F.sum(F.when(number_in(F.col("v")).isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("numeric_share"), F.count("v").alias("values"))
    g = g.withColumn("role", role(F.col("feature"))).where(F.col("role").isin(CANDIDATE, "POST_ROUTING_CONSEQUENCE"))
    kind = F.when(F.col("feature").rlike("|".join(NUMERIC_PARTS)) & (F.col("numeric_share") >= 0.5), "numeric").when(F.col("values") >= 2, "categorical")
    return g.select("feature", "role", "numeric_share", "values", kind.alias("type"))


def column_profile(df: DataFrame, required: list[str]) -> DataFrame:
    """column, present, required, filled and distinct_values of the columns that df has or should have, from its rows."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns)))
    values = df.select(cells.alias("x")).select("x.*").groupBy("column", "v").agg(F.count("*").alias("n"))
    found = values.groupBy("column").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("filled"), F.count("v").alias("distinct_values"))
    names = df.sparkSession.createDataFrame([(c, c in df.columns, c in required) for c in dict.fromkeys([*df.columns, *required])], "column string, present boolean, required boolean")
    return F.broadcast(names).join(found, "column", "left").select("column", "present", "required", F.coalesce("filled", F.lit(0)).alias("filled"), F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"))


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, position and type of every column, from the schemas."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, f.name, k, f.dataType.simpleString()) for name, df in tables.items() for k, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table string, column string, position int, type string")


def next_columns(catalog: DataFrame, exported: list[str], pattern: str) -> DataFrame:
    """Columns whose name matches and that were not exported yet, by table and position."""
    known = catalog.sparkSession.createDataFrame([(c.upper(),) for c in exported], "known string")
    rows = catalog.where(F.upper("column").rlike(pattern))
    return rows.join(F.broadcast(known), F.upper("column") == F.col("known"), "left_anti")


def data_dictionary(df: DataFrame, meanings: dict[str, tuple[str, str, str]]) -> DataFrame:
    """column, meaning, source and caution of the columns that df has."""
    shape = T.StructType([T.StructField(n, T.StringType()) for n in ("column", "meaning", "source", "caution")])
    return df.sparkSession.createDataFrame([(c, *meanings[c]) for c in df.columns if c in meanings], shape)


