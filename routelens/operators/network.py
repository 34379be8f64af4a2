"""What the network says about misroute cohorts, ranked and ready to present."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values that say nothing, and those that say a fallback was taken. Fixed values.
NOTHING = ("", "<MISSING>", "NAN", "NONE")
TAKEN = ("1", "Y", "YES", "TRUE")
STRONG, SUPPORTING, GEOMETRY = "STRONG ASSOCIATION", "SUPPORTING ASSOCIATION", "GEOMETRY EVIDENCE ONLY"


def said(c: Column) -> Column:
    """Trimmed text, empty where it says nothing."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.upper(t).isin(*NOTHING), "").otherwise(t)


def differ(case: Column, control: Column) -> Column:
    a, b = said(case), said(control)
    return (a != "") & (b != "") & (F.upper(a) != F.upper(b))


def interpretation(modes: dict[str, tuple[Column, Column]], fallback: Column, default: Column) -> Column:
    """source, sign, reason and strength of the first of eight rules that holds.

    modes: commonest value among misroutes and among controls of route, esinet, esz, sip, ims and ecscf.
    """
    m = {k: (said(a), said(b)) for k, (a, b) in modes.items()}
    named = lambda c: F.when(c == "", "n/a").otherwise(c)
    both = lambda k, before, between="; correct control=": F.concat(F.lit(before), m[k][0], F.lit(between), m[k][1])
    rule = lambda source, sign, reason, strength: F.struct(F.lit(source).alias("source"), sign.alias("sign"), F.lit(reason).alias("reason"), F.lit(strength).alias("strength"))
    route = F.upper(m["route"][0])
    path = F.upper(F.concat_ws(" ", said(fallback), said(default)))
    zones = F.concat(F.lit("ESInet "), named(m["esinet"][0]), F.lit(" vs "), named(m["esinet"][1]), F.lit("; ESZ "), named(m["esz"][0]), F.lit(" vs "), named(m["esz"][1]))
    return (
        F.when(route.contains("ESRK") & route.contains("MISMATCH"), rule("GMLC routing", F.concat(F.lit("ROUTE_STATUS_GMLC="), m["route"][0]), "the routing key contradicts a location that was matched", STRONG))
        .when(differ(*m["route"]), rule("GMLC routing", both("route", "Misroute="), "misroutes and correct calls have different routing outcomes", STRONG))
        .when(differ(*m["esinet"]) | differ(*m["esz"]), rule("GMLC ESInet/ESZ", zones, "misroutes are sent to another network or zone than correct calls", STRONG))
        .when(path.contains("FALLBACK") | F.trim(path).isin(*TAKEN), rule("GMLC fallback/default routing", F.concat(F.lit("Fallback="), named(said(fallback)), F.lit("; default="), named(said(default))), "a fallback may have bypassed the usual mapping", SUPPORTING))
        .when(differ(*m["sip"]), rule("GMLC SIP signaling", both("sip", "SIP misroute="), "signaling differs from that of correct calls, which proves no cause", SUPPORTING))
        .when(differ(*m["ims"]), rule("IMS/P-CSCF", both("ims", "IMS P-CSCF misroute="), "registration differs from that of correct calls", SUPPORTING))
        .when(differ(*m["ecscf"]), rule("CCDR/E-CSCF", both("ecscf", "E-CSCF misroute="), "the core's status differs from that of correct calls", SUPPORTING))
        .otherwise(rule("No isolated network field", F.lit("No single GMLC/IMS/CCDR mode clearly differs from controls"), "the network's fields single nothing out", GEOMETRY))
    )


def presented(cohorts: DataFrame, score: str, misroutes: str, controls: str, keys: list[str], top: int = 100) -> DataFrame:
    """The cohorts with the highest score, then misroutes, then controls, then by key; presentation_rank first, the three figures last."""
    high = lambda c: F.desc(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    best = cohorts.orderBy(high(score), high(misroutes), high(controls), *keys).limit(top)
    rank = F.row_number().over(W.orderBy(high(score), high(misroutes), high(controls), *keys))  # over `top` rows
    figures = [score, misroutes, controls]
    return best.withColumn("presentation_rank", rank).select("presentation_rank", *(c for c in cohorts.columns if c not in figures), *figures)


def feature_subset(lifts: DataFrame, tokens: tuple[str, ...]) -> DataFrame:
    """Rows whose feature's name holds one of the tokens."""
    return lifts.where(F.upper("feature").rlike("|".join(tokens)))
