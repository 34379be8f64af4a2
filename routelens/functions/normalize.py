"""Column expressions that clean identifiers, numbers, times and flags (F1-F34, P18-P20 of the survey). All but NFKC stay in the JVM.

Each normalizer has its own words for what is missing, as the sources that it serves do.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that count as missing: for ids, for evidence texts, for features, and for modes. Fixed values.
MISSING_ID = ("", "NAN", "NONE", "NULL", "<NULL>")
MISSING_TEXT = ("", "NAN", "NONE", "NULL", "<NA>")
MISSING_FEATURE = ("", "NAN", "NONE", "NULL", "<NA>", "<MISSING>")
MISSING_MODE = ("", "<MISSING>", "NAN", "NONE", "NULL")
#: Words for true and false: of tags, of evidence, and of health inputs. Fixed values.
TAG_WORDS = ("1", "Y", "YES", "TRUE", "T", "TEST", "SIM", "SIMULATED", "PSAP SIM")
EVIDENCE_FALSE = ("N", "NO", "FALSE", "F", "0", "OFF", "NONE", "NOT USED")
HEALTH_TRUE = ("1", "TRUE", "T", "YES", "Y", "PASS", "DETECT", "ALERT", "ANOMALY")
HEALTH_FALSE = ("0", "FALSE", "F", "NO", "N", "FAIL", "NO_INCREASE", "CONTROL", "BENIGN")
DETECT_WORDS = ("DETECT", "EXPECTED_DETECT", "BAD", "FAULT")
NO_INCREASE_WORDS = ("NO_INCREASE", "BENIGN", "CONTROL", "IMPROVEMENT", "IGNORE")
#: What marks an issue: words anywhere, or a code as the whole value. Fixed values.
ISSUE = r"FAIL|ERROR|REJECT|TIMEOUT|MISMATCH|INVALID|EXCEPTION|NOT[ _-]?FOUND|DENIED|UNAVAILABLE|DROP|^4\d\d$|^5\d\d$|^6\d\d$"
#: Problems of routes, fallbacks and signaling. 401 and 407 are ordinary challenges. Fixed values.
ROUTE_PROBLEM = "MISMATCH|MISSING|NO INVITE|REDIRECT|ERROR|FAIL"
FALLBACK_PROBLEM = "WDLS|SUSPICIOUS|ERROR|FAIL|NO ESRK"
SIGNALING_PROBLEM = "FAIL|ERROR|TIMEOUT|REJECT|INVALID|UNAVAILABLE|DROP"
ABNORMAL_CODE = r"(?<!\d)(?:4(?!01|07)\d{2}|5\d{2}|6\d{2})(?!\d)"
#: Severities by name. Fixed values.
SEVERITIES = {"NONE": 0.0, "CONTROL": 0.0, "BENIGN": 0.0, "LOW": 1.0, "MILD": 1.0, "MEDIUM": 2.0, "MODERATE": 2.0, "HIGH": 3.0, "SEVERE": 3.0, "CRITICAL": 4.0, "EXTREME": 4.0}
#: Prefixes of sources in feature names. Fixed values.
SOURCES = ("GMLC", "IMS", "RAW", "TIME", "JOIN")
_NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([Ee][-+]?\d+)?$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")


def normalize_id(c: Column) -> Column:
    """Upper case; whole numbers lose a plus sign, leading zeros and a `.0` tail; other text is kept (F1)."""
    t = F.upper(stripped(c))
    whole = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\.0+$", ""), r"^\+", ""), r"^(-?)0+(\d)", "$1$2")
    return F.when(t.isin(*MISSING_ID), None).when(t.rlike(r"^[+-]?\d+(\.0+)?$"), whole).otherwise(t)


def norm_id(c: Column) -> Column:
    """Trimmed, unquoted, upper case, one `.0` tail dropped; empty where missing (F2)."""
    return F.coalesce(F.upper(F.regexp_replace(F.regexp_replace(stripped(c), '"', ""), r"\.0$", "")), F.lit(""))


def text_or_missing(c: Column) -> Column:
    """Upper-case text without quotes around it, `<MISSING>` for what is missing."""
    t = F.upper(F.regexp_replace(stripped(c), r'^"+|"+$', ""))
    return F.when(t.isNull() | t.isin(*MISSING_TEXT), "<MISSING>").otherwise(t)


def id_or_missing(c: Column) -> Column:
    return F.regexp_replace(text_or_missing(c), r"\.0+$", "")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc_id(c: Column) -> Column:
    """Compatibility form, trimmed, upper case, one `.0` tail dropped; empty where missing (F4). Only texts beyond ASCII leave the JVM."""
    c = c.cast("string")
    t = F.regexp_replace(F.upper(stripped(F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(_nfkc(c)))), r"\.0$", "")
    return F.when(t.isNull() | t.isin(*MISSING_FEATURE), "").otherwise(t)


def hex_id(c: Column) -> Column:
    """normalize_id() without `0X` and blanks."""
    return F.replace(F.replace(normalize_id(c), F.lit("0X"), F.lit("")), F.lit(" "), F.lit(""))


def alnum_key(c: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(F.trim(c.cast("string"))), "[^A-Z0-9]", "")


def column_name(c: Column) -> Column:
    """Upper case, everything else than letters and digits as one underscore between them; `UNKNOWN` for null and nothing."""
    t = F.regexp_replace(F.regexp_replace(F.upper(stripped(c)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when(t.isNull() | (t == ""), "UNKNOWN").otherwise(t)


def number_in(c: Column) -> Column:
    """The first number in a text, without thousands' commas (F8)."""
    found = F.regexp_extract(F.replace(c.cast("string"), F.lit(","), F.lit("")), r"([-+]?\d*\.?\d+(?:[Ee][-+]?\d+)?)", 1)
    return F.when(found != "", found.try_cast("double"))


def number(c: Column) -> Column:
    """A text that is a number as a whole, without thousands' commas; else null (F8)."""
    t = F.replace(stripped(c), F.lit(","), F.lit(""))
    x = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    return F.when(F.abs(x) < float("inf"), x)


def tagged(c: Column) -> Column:
    """Whether the value is one of the words for a tag."""
    return norm_id(c).isin(*TAG_WORDS)


def specified(c: Column) -> Column:
    """False for words of denial, true for anything else that is there, null for what is missing."""
    t = text_or_missing(c)
    return F.when(t == "<MISSING>", None).otherwise(~t.isin(*EVIDENCE_FALSE))


def positive(c: Column) -> Column:
    """A number above 0, or else what specified() says."""
    return F.coalesce(number(c) > 0, specified(c))


def health_flag(c: Column) -> Column:
    """True or false by the words of health inputs, null for other words."""
    t = F.upper(stripped(c))
    return F.when(t.isin(*HEALTH_TRUE), True).when(t.isin(*HEALTH_FALSE), False)


def issue_flag(c: Column) -> Column:
    """Whether the value names an issue; null for what is missing."""
    t = text_or_missing(c)
    return F.when(t == "<MISSING>", None).otherwise(t.rlike(ISSUE))


def abnormal_response(c: Column) -> Column:
    """A failure word, or a 4xx-6xx code other than 401 and 407 anywhere."""
    t = F.upper(F.coalesce(c.cast("string"), F.lit("")))
    return t.rlike(SIGNALING_PROBLEM) | t.rlike(ABNORMAL_CODE)


def problem(c: Column, words: str) -> Column:
    return F.upper(F.coalesce(c.cast("string"), F.lit(""))).rlike(words)


def problems(route: Column, fallback: Column, lbr: Column, signaling: list[Column]) -> dict[str, Column]:
    """route, fallback, lbr, signaling and any as flags."""
    out = {
        "route": problem(route, ROUTE_PROBLEM), "fallback": problem(fallback, FALLBACK_PROBLEM),
        "lbr": F.coalesce(number(lbr) > 0, F.lit(False)) | norm_id(lbr).isin("Y", "YES", "TRUE"),
        "signaling": abnormal_response(F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("")) for c in signaling))),
    }
    return out | {"any": out["route"] | out["fallback"] | out["lbr"] | out["signaling"]}


def evidence_sentence(flags: dict[str, Column], route: Column, fallback: Column) -> Column:
    """What stands against the network, or that nothing does."""
    empty = F.lit("")
    said = F.concat_ws(
        "; ", F.when(flags["route"], F.concat(F.lit("GMLC route status: "), F.coalesce(route, empty))), F.when(flags["fallback"], F.concat(F.lit("Fallback/WDLS: "), F.coalesce(fallback, empty))),
        F.when(flags["lbr"], "LBR PSAP differs"), F.when(flags["signaling"], "IMS/RAW signaling error or abnormal response"),
    )
    return F.coalesce(F.nullif(said, empty), F.lit("No additional network fault; geometry is primary evidence"))


def redact(c: Column, cap: int | None = None) -> Column:
    """Upper-case text with placeholders for addresses, URIs, long hex ids and numbers of four digits or more."""
    t = F.upper(F.coalesce(c.cast("string"), F.lit("")))
    t = t if cap is None else F.substring(t, 1, cap)
    for pattern, name in ((r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "IP"), (r"[A-Z0-9._%+-]+@[A-Z0-9.-]+", "URI"), (r"\b[0-9A-F]{12,}\b", "HEXID"), (r"\b\d{4,}\b", "NUM")):
        found = F.regexp_replace(t, pattern, f" <{name}> ")
        t = F.when(t.contains("@"), found).otherwise(t) if name == "URI" else found  # most texts have none, and looking for one is slow
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def parse_utc(c: Column) -> Column:
    """The database's day-month-year times (points and AM or PM, or colons), and ISO times, as UTC; null where nothing fits."""
    t = F.upper(F.regexp_replace(stripped(c), r"\s+", " "))
    form = r"^(\d{1,2})-([A-Z]{3})-(\d{4}|\d{2}) (?:(\d{1,2})\.(\d{1,2})\.(\d{1,2})(\.\d{1,6})? ([AP])M|(\d{1,2}):(\d{1,2}):(\d{1,2})(\.\d{1,6})?) UTC$"
    part = lambda k: F.regexp_extract(t, form, k)
    whole = lambda k: part(k).try_cast("int")
    year = F.when(F.length(part(3)) == 4, whole(3)).otherwise(F.when(whole(3) >= 69, 1900 + whole(3)).otherwise(2000 + whole(3)))
    at = F.position(part(2), F.lit("JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"))
    month = F.when(at % 3 == 1, ((at + 2) / 3).cast("int"))
    with_points = part(8) != ""
    hour = F.when(with_points, F.when(whole(4).between(1, 12), whole(4) % 12 + F.when(part(8) == "P", 12).otherwise(0))).otherwise(whole(9))
    minute, second = F.when(with_points, whole(5)).otherwise(whole(10)), F.when(with_points, F.concat(part(6), part(7))).otherwise(F.concat(part(11), part(12)))
    oracle = F.try_make_timestamp(year, month, whole(1), hour, minute, second.try_cast("decimal(16,6)"), F.lit("UTC"))
    zone = F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2}| UTC)$"), F.lit("")).otherwise("Z")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.concat(F.regexp_replace(t, " UTC$", "Z"), F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit("T00:00:00Z")).otherwise(zone))))
    return F.coalesce(F.when(t.rlike(form), oracle), iso)


def iso_of_epoch(c: Column) -> Column:
    """ISO text in UTC of seconds since 1970, with microseconds where there are any."""
    micros = F.round(c.try_cast("double") * 1_000_000).cast("long")
    at = F.to_utc_timestamp(F.timestamp_micros(micros), F.current_timezone())
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.pmod(micros, F.lit(1_000_000)) != 0, F.date_format(at, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def time_bucket(ts: Column) -> Column:
    """WEEKDAY or WEEKEND and four hours of the day (F16)."""
    block = F.floor(F.hour(ts) / 4) * 4
    return F.concat(F.when(F.dayofweek(ts).isin(1, 7), "WEEKEND").otherwise("WEEKDAY"), F.format_string("_H%02d_%02d", block, block + 3))


def key_text(*cs: Column) -> Column:
    """A composite key as a JSON array of normalized texts."""
    return F.to_json(F.array(*map(text_or_missing, cs)))


def json_field(c: Column, path: str) -> Column:
    """A field of a JSON text, null where it is missing or the text is no JSON."""
    return F.get_json_object(c, path)


def severity_number(c: Column) -> Column:
    """A number, or that of the severity's name; else null."""
    t = F.upper(stripped(c))
    by_name = F.create_map(*(F.lit(x) for pair in SEVERITIES.items() for x in pair))
    return F.coalesce(F.when(t.rlike(_NUMBER), t.try_cast("double")), by_name[t])


def sequence_in(c: Column) -> Column:
    """Values of list-like text: brackets, parentheses or braces around them, or bare commas between them."""
    t = stripped(c)
    values = F.when(t.rlike(r"^\{.*\}$"), F.map_values(F.from_json(t, "map<string,string>")))
    inner = F.when(t.rlike(r"^[\[(].*[\])]$"), F.regexp_replace(t, r"^[\[(]|[\])]$", "")).otherwise(t)
    listed = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(x, "^[\\s\"']+|[\\s\"']+$", ""))
    return F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).otherwise(F.coalesce(values, F.filter(listed, lambda x: x != "")))


def points(c: Column) -> Column:
    """A share as percentage points with its sign."""
    return F.when(c.isNull(), "n/a").otherwise(F.format_string("%+.1f pp", 100 * c.cast("double")))


def evidence_summary(misroutes: Column, controls: Column, method: Column, deltas: dict[str, Column]) -> Column:
    """Counts and differences of a pattern in one sentence (F29). deltas: route, fallback, lbr, ims, raw."""
    pp = lambda k: points(deltas[k])
    count = lambda c: F.format_number(F.coalesce(c, F.lit(0)).cast("long"), 0)
    return F.concat(
        count(misroutes), F.lit(" geometry-defined misroutes; "), count(controls), F.lit(" correct controls ("), method, F.lit("). Misroute-minus-control indicators: route mismatch "), pp("route"),
        F.lit(", fallback "), pp("fallback"), F.lit(", LBR PSAP difference "), pp("lbr"), F.lit(", IMS registration/SIP "), pp("ims"), F.lit(", CCDR registration "), pp("raw"), F.lit("."),
    )


def is_missing(c: Column) -> Column:
    """Whether a feature's value counts as missing."""
    t = F.upper(stripped(c))
    return t.isNull() | t.isin(*MISSING_FEATURE)


def source_of(name: Column) -> Column:
    """The source in a prefixed feature name, DERIVED without one."""
    head = F.substring_index(name, "__", 1)
    return F.when(name.contains("__") & head.isin(*SOURCES), head).otherwise("DERIVED")


def original_of(name: Column) -> Column:
    """A feature name without the source's prefix."""
    return F.when(source_of(name) == "DERIVED", name).otherwise(F.regexp_replace(name, "^[A-Z]+__", ""))


def entity_key(c: Column) -> Column:
    """Trimmed text of a key; numbers without a fraction lose it."""
    t = stripped(c)
    return F.when(t.rlike(r"^-?\d+\.0+$"), F.regexp_replace(t, r"\.0+$", "")).otherwise(t)


def expected_behaviour(c: Column) -> Column:
    """DETECT or NO_INCREASE by the words for either."""
    t, flag = F.upper(stripped(c)), health_flag(c)
    return F.when(flag | t.isin(*DETECT_WORDS), "DETECT").when(~flag | t.isin(*NO_INCREASE_WORDS), "NO_INCREASE")


def wilson_lower(k: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval of k out of n; null for n = 0."""
    p = k / n
    return F.when(n > 0, (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n))


def safe_rate(k: Column, n: Column) -> Column:
    return F.when(n > 0, k / n)


def grade_high(x: Column, ok: float, warn: float) -> Column:
    return F.when(x.isNull(), "UNKNOWN").when(x >= ok, "PASS").when(x >= warn, "WARN").otherwise("FAIL")


def grade_low(x: Column, ok: float, warn: float) -> Column:
    return F.when(x.isNull(), "UNKNOWN").when(x <= ok, "PASS").when(x <= warn, "WARN").otherwise("FAIL")


def worst(*grades: Column) -> Column:
    """The worst of several grades, UNKNOWN ones aside."""
    found = F.array(*grades)
    has = lambda g: F.array_contains(found, g)
    return F.when(has("FAIL"), "FAIL").when(has("WARN"), "WARN").when(has("PASS"), "PASS").otherwise("UNKNOWN")


def joined_unique(c: Column, most: int = 15) -> Column:
    """Aggregate: sorted distinct values between bars, at most `most`, then how many more; `<MISSING>` without any."""
    t = stripped(c)
    s = F.array_sort(F.collect_set(F.when(~F.upper(t).isin(*MISSING_MODE), t)))
    shown = F.concat(F.array_join(F.slice(s, 1, most), " | "), F.when(F.size(s) > most, F.concat(F.lit(" | +"), F.size(s) - most, F.lit(" more"))).otherwise(""))
    return F.when(F.size(s) > 0, shown).otherwise("<MISSING>")
