"""Queries over the scalar functions: each row of `orders` holds one of the forms in which the sources write a value.

The SQL of each query lists what should come out, form by form, so it shares nothing with the functions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import scenarios as S
from ..sources.tables import table
from .common import tidy


def _form(forms: list) -> Column:
    """The form that a row holds, by its key."""
    return F.element_at(F.array(*(F.lit(x).cast("string") for x in forms)), (F.col("o_orderkey") % len(forms) + 1).cast("int"))


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value}'"
    if isinstance(value, (int, float)):
        return f"{value!r}::DOUBLE" if isinstance(value, float) else str(value)
    return "'" + value.replace("'", "''") + "'"


def _query(f, pairs: list[tuple]) -> tuple:
    """Query and SQL: f of each form must be what stands beside it."""

    def run(spark, d):
        return tidy(table(spark, d, "orders").select("o_orderkey", f(_form([raw for raw, _ in pairs])).alias("value")))

    kind = next(("VARCHAR" if isinstance(v, str) else "BOOLEAN" if isinstance(v, bool) else "TIMESTAMP" if isinstance(v, dt.datetime) else "DOUBLE") for _, v in pairs if v is not None)
    values = f"[{', '.join(_sql(v) for _, v in pairs)}]"
    return run, f"SELECT o_orderkey, list_extract({values}, (o_orderkey % {len(pairs)} + 1)::INTEGER)::{kind} AS value FROM orders"


_T = dt.datetime
QUERIES = {
    "f1_normalize_id": _query(N.normalize_id, [(" 12.0 ", "12"), ("007", "7"), ("-5.00", "-5"), ("+3", "3"), ("-0", "-0"), ("a.0", "A.0"), ("NaN", None), ("<null>", None), ("none", None), ("NULL", None), ("", None), (None, None), ("N/A", "N/A"), ("1e5", "1E5"), ('"x"', '"X"'), ("000", "0")]),
    "f2_norm_id": _query(N.norm_id, [(' "ab" ', "AB"), ("12.0", "12"), ("12.00", "12.00"), ("nan", "NAN"), (None, ""), ("", ""), ('a"b', "AB"), ("x.0", "X")]),
    "f3_text_or_missing": _query(N.text_or_missing, [(" ok ", "OK"), ('"q"', "Q"), ("nan", "<MISSING>"), ("None", "<MISSING>"), ("null", "<MISSING>"), ("<na>", "<MISSING>"), ("", "<MISSING>"), (None, "<MISSING>"), ("n/a", "N/A"), ("12.0", "12.0"), ("<null>", "<NULL>")]),
    "f3_id_or_missing": _query(N.id_or_missing, [("12.00", "12"), ("a.0", "A"), (None, "<MISSING>"), ("<NA>", "<MISSING>"), ("-1", "-1")]),
    "f4_nfkc_id": _query(N.nfkc_id, [("ＡＢ１", "AB1"), ("ﬁn", "FIN"), ("x①", "X1"), (" a.0", "A"), ("<missing>", ""), (None, ""), ("nan", ""), ("café", "CAFÉ")]),
    "f5_hex_id": _query(N.hex_id, [("0x1f a0", "1FA0"), (" ab cd ", "ABCD"), ("0012", "12"), ("nan", None), (None, None), ("x0x1", "X1")]),
    "f6_alnum_key": _query(N.alnum_key, [(" a-b c ", "ABC"), ("#12", "12"), ("", ""), (None, None)]),
    "f7_column_name": _query(N.column_name, [(" call type ", "CALL_TYPE"), ("a--b", "A_B"), ("_x_", "X"), ("Slow-burn ramp!", "SLOW_BURN_RAMP"), (None, "UNKNOWN"), ("!!", "UNKNOWN")]),
    "f8_number_in": _query(N.number_in, [("about 1,234.5 m", 1234.5), ("-.5x", -0.5), ("1e3", 1000.0), ("none", None), ("", None), (None, None), ("a+7b9", 7.0)]),
    "f8_number": _query(N.number, [(" 1,234.5 ", 1234.5), ("1e3", 1000.0), ("12 m", None), ("nan", None), ("inf", None), ("1.0d", None), ("", None), (None, None), ("-.5", -0.5)]),
    "f9_tagged": _query(N.tagged, [("y", True), ("1.0", True), ("Test", True), ("psap sim", True), ("no", False), (None, False), ("", False), ("true ", True), ("2", False)]),
    "f9_specified": _query(N.specified, [("N", False), ("off", False), ("not used", False), ("0", False), ("yes", True), ("WDLS", True), (None, None), ("none", None), ("", None), ("0.0", True)]),
    "f9_positive": _query(N.positive, [("2", True), ("0", False), ("-1", False), ("yes", True), ("no", False), (None, None), ("1,000", True), ("other", True)]),
    "f9_health_flag": _query(N.health_flag, [("pass", True), ("Alert", True), ("1", True), ("control", False), ("no_increase", False), ("maybe", None), (None, None), (" f ", False)]),
    "f10_issue_flag": _query(N.issue_flag, [("TIMEOUT", True), ("reg failed", True), ("mismatch", True), ("invalid id", True), ("an exception", True), ("not found", True), ("not_found", True), ("NOT-FOUND", True), ("denied", True), ("unavailable", True), ("dropped", True), ("rejected", True), ("401", True), ("404", True), ("503", True), ("600", True), ("E-CSCF 404", False), ("4012", False), ("unknown", False), ("200 OK", False), ("registered", False), ("", None), ("null", None), (None, None)]),
    "f11_abnormal_response": _query(N.abnormal_response, [("E-CSCF 404", True), ("401", False), ("407 auth", False), ("401 then 503", True), ("4041", False), ("drop", True), ("mismatch", False), (None, False), ("603", True), ("200", False)]),
    "f12_redacted": _query(N.redact, [("from 10.1.2.3 code 403", "FROM <IP> CODE 403"), ("sip bob@host.net", "SIP <URI>"), ("id ABCDEF012345x", "ID ABCDEF012345X"), ("id abcdef012345", "ID <HEXID>"), ("tel 12345 and 999", "TEL <NUM> AND 999"), (None, ""), ("  a   b ", "A B")]),
    "f13_parse_utc": _query(N.parse_utc, [("01-Jul-26 01.02.03.500000 PM UTC", _T(2026, 7, 1, 13, 2, 3, 500000)), ("01-jul-26 12.02.03 AM UTC", _T(2026, 7, 1, 0, 2, 3)), ("01-JUL-2026 12.00.00.25 PM UTC", _T(2026, 7, 1, 12, 0, 0, 250000)), ("1-Jul-1999 1.2.3 am UTC", _T(1999, 7, 1, 1, 2, 3)), ("01-Jul-69 13:02:03.5 UTC", _T(1969, 7, 1, 13, 2, 3, 500000)), ("31-Dec-26 23:59:59 UTC", _T(2026, 12, 31, 23, 59, 59)), ("2026-07-01T13:02:03+02:00", _T(2026, 7, 1, 11, 2, 3)), ("2026-07-01 13:02:03", _T(2026, 7, 1, 13, 2, 3)), ("2026-07-01", _T(2026, 7, 1)), ("31-Feb-26 01:00:00 UTC", None), ("01-Xyz-26 01:00:00 UTC", None), ("01-Jul-26 13.00.00 PM UTC", None), ("rubbish", None), ("", None), (None, None)]),
    "f14_iso_of_epoch": _query(N.iso_of_epoch, [("0", "1970-01-01T00:00:00+00:00"), ("1782910923.5", "2026-07-01T13:02:03.500000+00:00"), ("-1", "1969-12-31T23:59:59+00:00"), ("x", None), (None, None)]),
    "f17_key_text": _query(lambda c: N.key_text(c, F.lit("b")), [("a", '["A","B"]'), (None, '["<MISSING>","B"]'), (' "q" ', '["Q","B"]')]),
    "f18_json_field": _query(lambda c: N.json_field(c, "$.a.b"), [('{"a":{"b":"x"}}', "x"), ('{"a":{"b":7}}', "7"), ('{"a":1}', None), ("{broken", None), ("", None), (None, None)]),
    "f25_severity_number": _query(N.severity_number, [("mild", 1.0), (" Severe", 3.0), ("extreme", 4.0), ("none", 0.0), ("2.5", 2.5), ("x", None), (None, None)]),
    "f28_sequence": _query(lambda c: F.array_join(N.sequence_in(c), "|"), [("[1, 2,3]", "1|2|3"), ("(a, 'b')", "a|b"), ("a, b,,", "a|b"), ('{"x":"1","y":"2"}', "1|2"), ("", ""), (None, ""), ("one", "one"), ('["q"]', "q")]),
    "f29_points": _query(lambda c: N.points(c.try_cast("double")), [("0.123", "+12.3 pp"), ("-0.5", "-50.0 pp"), ("0", "+0.0 pp"), (None, "n/a")]),
    "f30_is_missing": _query(N.is_missing, [("", True), ("nan", True), ("<missing>", True), (None, True), (" x", False), ("n/a", False)]),
    "f30_source_and_name": _query(lambda c: F.concat_ws("/", N.source_of(c), N.original_of(c)), [("GMLC__CELL", "GMLC/CELL"), ("RAW__A__B", "RAW/A__B"), ("TIME__HOUR", "TIME/HOUR"), ("OTHER__X", "DERIVED/OTHER__X"), ("PLAIN", "DERIVED/PLAIN")]),
    "f32_pattern": _query(S.canonical_pattern, [("Single-KPI-failure", "kpi_degradation"), ("intermittent", "flapping"), ("slow_burn_ramp", "slow_burn"), (" volume_spike ", "volume_spike"), ("correlated_failure", "correlated_volume_sr"), ("multi_kpi_failure", "multi_kpi_degradation"), ("improvement_control", "benign_improvement"), ("nothing", None), (None, None)]),
    "f32_stratum": _query(S.canonical_stratum, [("Mid", "medium"), ("low", "low"), (" HIGH", "high"), ("odd", None), (None, None)]),
    "f32_severity_fraction": _query(S.severity_fraction, [("mild", 0.1), ("Moderate", 0.25), ("severe", 0.5), ("0.3", 0.3), ("1", 1.0), ("0", None), ("1.5", None), ("bad", None), (None, None)]),
    "f32_changed_columns": _query(lambda c: F.array_join(S.changed_columns(c, F.array(F.lit("ASR_SR"), F.lit("LSR_SR"))), "+"), [("volume_drop", "CALL_VOLUME"), ("volume_spike", "CALL_VOLUME"), ("correlated_volume_sr", "CALL_VOLUME+ASR_SR+LSR_SR"), ("flapping", "ASR_SR+LSR_SR")]),
    "f33_entity_key": _query(N.entity_key, [("12.0", "12"), (" a ", "a"), ("1.50", "1.50"), ("-3.00", "-3"), (None, None)]),
    "f34_expected_behaviour": _query(N.expected_behaviour, [("detect", "DETECT"), ("yes", "DETECT"), ("fault", "DETECT"), ("expected_detect", "DETECT"), ("0", "NO_INCREASE"), ("improvement", "NO_INCREASE"), ("ignore", "NO_INCREASE"), ("control", "NO_INCREASE"), ("odd", None), (None, None)]),
}


SCENARIOS = [
    ("pattern=multi_kpi_degradation,kpis=lsr_sr+ASR_SR,severity=severe,duration=3,volume=high", ("multi_kpi_degradation", "LSR_SR+ASR_SR", "severe", 0.5, 3, "high", None)),
    ("pattern=volume-spike", ("volume_spike", "", "moderate", 0.25, 1, None, None)), ("pattern=intermittent, severity=0.4, stratum=mid", ("flapping", "", "custom", 0.4, 1, "medium", None)),
    ("pattern=volume_drop,pattern=flapping", (*[None] * 6, "REPEATED_FIELD")), ("pattern=volume_drop,x=1", (*[None] * 6, "UNKNOWN_FIELD")), ("pattern", (*[None] * 6, "INVALID_FIELD")), ("", (*[None] * 6, "INVALID_FIELD")),
    ("pattern=", (*[None] * 6, "EMPTY_FIELD")), ("severity=mild", (*[None] * 6, "NO_PATTERN")), ("pattern=odd", (*[None] * 6, "UNKNOWN_PATTERN")), ("pattern=flapping,severity=2", (*[None] * 6, "INVALID_SEVERITY")),
    ("pattern=flapping,duration=4", (*[None] * 6, "INVALID_DURATION")), ("pattern=flapping,volume=odd", (*[None] * 6, "INVALID_STRATUM")), (None, (*[None] * 6, "INVALID_FIELD")),
]
_SPEC = [("pattern", "VARCHAR"), ("kpis", "VARCHAR"), ("severity", "VARCHAR"), ("fraction", "DOUBLE"), ("duration_hours", "BIGINT"), ("volume_stratum", "VARCHAR"), ("error", "VARCHAR")]


def f31_scenarios(spark, d):
    out = S.parse(table(spark, d, "orders").select("o_orderkey", _form([t for t, _ in SCENARIOS]).alias("scenario")), "scenario")
    return tidy(out.drop("scenario").withColumn("kpis", F.array_join("kpis", "+")))


def f16_time_bucket(spark, d):
    return tidy(table(spark, d, "events").select("event_id", N.time_bucket(F.col("ts").cast("timestamp_ntz")).alias("bucket")))


def f22_joined_unique(spark, d):
    p = table(spark, d, "part").withColumn("v", F.when(F.col("p_partkey") % 7 == 0, "none").otherwise(F.col("p_type")))
    return tidy(p.groupBy("p_brand").agg(N.joined_unique(F.col("v"), 15).alias("kinds")))


def f29_summary(spark, d):
    n = F.count("*")
    share = lambda k: F.avg((F.col("o_orderpriority") == k).cast("double"))
    g = table(spark, d, "orders").groupBy("o_orderstatus").agg(n.alias("n"), share("1-URGENT").alias("route"), (-share("2-HIGH")).alias("fallback"), share("3-MEDIUM").alias("lbr"), share("5-LOW").alias("ims"))
    return g.select("o_orderstatus", N.evidence_summary(F.col("n"), F.col("n") * 3, F.lit("EXACT"), {"route": F.col("route"), "fallback": F.col("fallback"), "lbr": F.col("lbr"), "ims": F.col("ims"), "raw": F.lit(None).cast("double")}).alias("summary"))


ROUTES = ["ESRK mismatch", "OK", "no invite", None, "redirected", "missing esz"]
FALLBACKS = ["", "WDLS", "no esrk here", "fine", None]
LBRS = ["0", "2", "Y", None]
SIGNALS = ["200 OK", "401", "403 forbidden", None, "timeout", "4031"]


def _problem_rows(spark, d):
    pick = lambda forms: F.element_at(F.array(*(F.lit(x).cast("string") for x in forms)), (F.col("o_orderkey") % len(forms) + 1).cast("int"))
    o = table(spark, d, "orders")
    return o.select("o_orderkey", pick(ROUTES).alias("route"), pick(FALLBACKS).alias("fallback"), pick(LBRS).alias("lbr"), pick(SIGNALS).alias("signal"))


def p18_problem_flags(spark, d):
    flags = N.problems(F.col("route"), F.col("fallback"), F.col("lbr"), [F.col("signal")])
    return tidy(_problem_rows(spark, d).select("o_orderkey", *(v.alias(f"{k}_problem") for k, v in flags.items()), N.evidence_sentence(flags, F.col("route"), F.col("fallback")).alias("evidence")))


def _pick(values: list, kind: str = "VARCHAR") -> str:
    return f"list_extract([{', '.join(_sql(v) for v in values)}], (o_orderkey % {len(values)} + 1)::INTEGER)::{kind}"


_PP = lambda e: f"CASE WHEN {e} >= 0 THEN '+' ELSE '' END || printf('%.1f', 100 * {e}) || ' pp'"

QUERIES |= {
    "f31_scenarios": (f31_scenarios, "SELECT o_orderkey, " + ", ".join(f"{_pick([out[k] for _, out in SCENARIOS], kind)} AS {name}" for k, (name, kind) in enumerate(_SPEC)) + " FROM orders"),
    "f16_time_bucket": (f16_time_bucket, "SELECT event_id, CASE WHEN isodow(ts) >= 6 THEN 'WEEKEND' ELSE 'WEEKDAY' END || '_H' || lpad((hour(ts) // 4 * 4)::VARCHAR, 2, '0') || '_' || lpad((hour(ts) // 4 * 4 + 3)::VARCHAR, 2, '0') AS bucket FROM events"),
    "f22_joined_unique": (f22_joined_unique, "SELECT p_brand, array_to_string(v[1:15], ' | ') || CASE WHEN len(v) > 15 THEN ' | +' || (len(v) - 15) || ' more' ELSE '' END AS kinds FROM (SELECT p_brand, list_sort(list(DISTINCT p_type) FILTER (p_partkey % 7 <> 0)) AS v FROM part GROUP BY 1)"),
    "f29_summary": (f29_summary, f"""SELECT o_orderstatus, format('{{:,}}', n) || ' geometry-defined misroutes; ' || format('{{:,}}', n * 3) || ' correct controls (EXACT). Misroute-minus-control indicators: route mismatch ' || {_PP('a')} || ', fallback ' || {_PP('b')} || ', LBR PSAP difference ' || {_PP('c')}
        || ', IMS registration/SIP ' || {_PP('e')} || ', CCDR registration n/a.' AS summary FROM (SELECT o_orderstatus, count(*) AS n, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0 END) AS a, -avg(CASE WHEN o_orderpriority = '2-HIGH' THEN 1.0::DOUBLE ELSE 0 END) AS b,
        avg(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1.0::DOUBLE ELSE 0 END) AS c, avg(CASE WHEN o_orderpriority = '5-LOW' THEN 1.0::DOUBLE ELSE 0 END) AS e FROM orders GROUP BY 1)"""),
    "p18_problem_flags": (p18_problem_flags, f"""WITH r AS (SELECT o_orderkey, {_pick(ROUTES)} AS route, {_pick(FALLBACKS)} AS fallback, {_pick([True, False, True, False, True, True], 'BOOLEAN')} AS rp, {_pick([False, True, True, False, False], 'BOOLEAN')} AS fp, {_pick([False, True, True, False], 'BOOLEAN')} AS lp,
        {_pick([False, False, True, False, True, False], 'BOOLEAN')} AS sp FROM orders), e AS (SELECT *, concat_ws('; ', CASE WHEN rp THEN 'GMLC route status: ' || route END, CASE WHEN fp THEN 'Fallback/WDLS: ' || fallback END, CASE WHEN lp THEN 'LBR PSAP differs' END, CASE WHEN sp THEN 'IMS/RAW signaling error or abnormal response' END) AS said FROM r)
        SELECT o_orderkey, rp AS route_problem, fp AS fallback_problem, lp AS lbr_problem, sp AS signaling_problem, rp OR fp OR lp OR sp AS any_problem, CASE WHEN said = '' THEN 'No additional network fault; geometry is primary evidence' ELSE said END AS evidence FROM e"""),
}
