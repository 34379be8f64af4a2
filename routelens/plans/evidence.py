"""Queries over matched-control evidence, pairs, grain and join diagnostics, bound to the labelled calls and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edge_index, enrich, geo, grain, network, rca
from ..sources.files import scratch
from ..sources.tables import table
from . import location as L
from .common import tidy

CATEGORIES = ("route_status", "priority")
#: flag: (Spark and DuckDB condition on a labelled call)
FLAGS = {"route": "priority = '1-URGENT'", "fallback": "call_id % 5 = 0", "lbr": "cell % 4 = 0", "sip": "route_status = 'P'", "ims": "market = 'MACHINERY'", "raw_reg": "call_id % 7 = 0", "raw_ecscf": "call_id % 11 = 0"}
KEYS = ["routed", "market"]


def flagged(spark, d):
    return L.labelled(spark, d).withColumns({f: F.expr(c) for f, c in FLAGS.items()})


def matched(spark, d):
    s = flagged(spark, d)
    return rca.matched_evidence(rca.cohort_profile(s.where("label = 1"), KEYS, categories=CATEGORIES), rca.cohort_profile(s.where("label = 0"), KEYS, categories=CATEGORIES), KEYS, CATEGORIES)


def judged(spark, d):
    m = matched(spark, d)
    deltas = {f: F.coalesce(f"{f}_delta", F.lit(0.0)) for f in rca.EVIDENCE}
    modes = {"route": F.col("route_status_differs"), "esinet": F.col("priority_differs"), "esz": F.lit(False)}
    score = rca.corroboration(deltas, modes)
    m = m.withColumn("score", score)
    return m.select(*KEYS, "calls", "control_calls", "score", rca.conclusion(F.col("control_calls"), F.col("score"), F.col("ims_rate"), F.col("raw_reg_rate")).alias("conclusion"), rca.probable_cause(F.col("control_calls"), deltas, F.col("route_status_differs"), F.col("ims_rate"), F.col("raw_reg_rate")).alias("cause"))


_ARE = ", ".join(f"({c})::INT AS {f}" for f, c in FLAGS.items())
FL = f"{L.LABELS}, fl AS (SELECT *, {_ARE} FROM l WHERE label IS NOT NULL)"


def _profile(name: str, label: int) -> str:
    rates = ", ".join(f"avg({f}::DOUBLE) AS {f}_rate" for f in FLAGS)
    modes = " ".join(f"JOIN (SELECT routed, market, arg_min({c}, (-n, {c})) AS {c}_mode, max(n) AS {c}_mode_count FROM (SELECT routed, market, {c}, count(*) AS n FROM fl WHERE label = {label} GROUP BY ALL) GROUP BY 1, 2) m{i} USING (routed, market)" for i, c in enumerate(CATEGORIES))
    shares = ", ".join(f"{c}_mode_count::DOUBLE / calls AS {c}_share" for c in CATEGORIES)
    return f"{name} AS (SELECT *, {shares} FROM (SELECT routed, market, count(*) AS calls, min(call_time) AS first_seen, max(call_time) AS last_seen, {rates} FROM fl WHERE label = {label} GROUP BY 1, 2) {modes})"


_CTL = ", ".join(f"ct.{c} AS control_{c}" for c in ("calls", *(f"{f}_rate" for f in FLAGS), *(f"{c}_mode" for c in CATEGORIES)))
_D = ", ".join(f"coalesce(ca.{f}_rate - ct.{f}_rate, 0) AS d_{f}" for f in FLAGS)
_DIF = ", ".join(f"coalesce(ca.{c}_mode <> ct.{c}_mode AND ca.{c}_share >= 0.5, false) AS {c}_differs" for c in CATEGORIES)
_STEPS = [("fallback", 0.15, 15), ("lbr", 0.20, 15), ("sip", 0.15, 10), ("ims", 0.15, 10), ("raw_reg", 0.15, 10), ("raw_ecscf", 0.15, 5)]
_SCORE = "least(100, CASE WHEN d_route >= 0.20 THEN 35 WHEN d_route >= 0.10 THEN 20 ELSE 0 END + " + " + ".join(f"CASE WHEN d_{f} >= {a} THEN {p} ELSE 0 END" for f, a, p in _STEPS) + " + CASE WHEN route_status_differs THEN 10 ELSE 0 END + CASE WHEN priority_differs THEN 5 ELSE 0 END)"
EVID = f"{FL}, {_profile('ca', 1)}, {_profile('ct', 0)}, me AS (SELECT ca.*, coalesce(ct.calls, 0) AS controls, {_D}, {_DIF} FROM ca LEFT JOIN ct USING (routed, market)), sc AS (SELECT *, {_SCORE} AS score FROM me)"
JUDGED = f"""{EVID}, ju AS (SELECT routed, market, calls, controls AS control_calls, score::BIGINT AS score,
  CASE WHEN controls < 20 THEN 'INSUFFICIENT_MATCHED_CORRECT_CONTROL' WHEN score >= 50 THEN 'STRONG' WHEN score >= 25 THEN 'MODERATE' WHEN score > 0 THEN 'WEAK_OR_MIXED' WHEN ims_rate < 0.25 AND raw_reg_rate < 0.25 THEN 'INSUFFICIENT_IMS_CCDR_ENRICHMENT' ELSE 'GEOMETRY_ONLY_NO_NETWORK_DIFFERENTIAL' END AS conclusion,
  CASE WHEN controls < 20 THEN 'INSUFFICIENT_CONTROL' WHEN d_route >= 0.15 OR route_status_differs THEN 'ROUTING_MAPPING_OR_CROSSWALK' WHEN d_fallback >= 0.15 THEN 'FALLBACK_OR_DEFAULT_ROUTING' WHEN d_lbr >= 0.20 THEN 'LBR_DIFFERENCE' WHEN d_ims >= 0.15 AND greatest(d_raw_reg, d_raw_ecscf) >= 0.15 THEN 'MIXED'
    WHEN d_ims >= 0.15 OR d_sip >= 0.15 THEN 'IMS_OR_SIP_SIGNALING' WHEN greatest(d_raw_reg, d_raw_ecscf) >= 0.15 THEN 'RAW_REGISTRATION_OR_ECSCF' WHEN ims_rate < 0.25 AND raw_reg_rate < 0.25 THEN 'INSUFFICIENT_ENRICHMENT' ELSE 'GEOMETRY_ONLY_NETWORK_NORMAL_OR_MIXED' END AS cause FROM sc)"""
_R = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)


def a23_case_profiles(spark, d):
    return tidy(rca.cohort_profile(flagged(spark, d).where("label = 1"), KEYS, categories=CATEGORIES))


def c5_matched_evidence(spark, d):
    m = matched(spark, d)
    return tidy(m.select(*KEYS, "calls", "control_calls", *(F.coalesce(f"{f}_delta", F.lit(0.0)).alias(f"d_{f}") for f in rca.EVIDENCE), *(f"{c}_differs" for c in CATEGORIES)))


def c7_conclusion_and_cause(spark, d):
    return tidy(judged(spark, d))


def a52_evidence_summary(spark, d):
    return tidy(judged(spark, d).groupBy("conclusion", "cause").agg(F.count("*").alias("patterns"), F.sum("calls").alias("calls")))


def a24_cohort_denominators(spark, d):
    s = L.labelled(spark, d).groupBy("cell", "market", "priority")
    return tidy(s.agg(F.count("label").alias("strong"), rca.count_if(F.col("label") == 1).alias("misroutes"), rca.count_if(F.col("label") == 0).alias("correct")))


def a25_frequent_name(spark, d):
    return tidy(grain.mode_pack(L.labelled(spark, d), ["routed"], "market").select("routed", F.col("mode").alias("name")))


def a26_strong_pairs(spark, d):
    return tidy(rca.strong_pairs(flagged(spark, d), ["route", "fallback"], "market"))


def a13_pair_summary(spark, d):
    return tidy(rca.pair_summary(L.labelled(spark, d), ["market"]))


def a15_hypothesis(spark, d):
    return tidy(rca.entity_hypothesis(L.labelled(spark, d), "cell", "cell"))


def j13_drill_down(spark, d):
    s = flagged(spark, d)
    return tidy(rca.drill_down(s.where("label = 1"), rca.strong_pairs(s, [], "market").where("rank <= 10"), ["routed", "expected"]).select("call_id", "pattern_rank"))


def c19_top_calls(spark, d):
    """The ten calls of each misrouted pair that lie farthest from the routed area."""
    from pyspark.sql import Window as W

    s = L.labelled(spark, d).where("label = 1").withColumn("rank", F.row_number().over(W.partitionBy("routed", "expected").orderBy(F.desc(F.round("d_routed", 2)), "call_id")))
    return tidy(s.where("rank <= 10").select("routed", "expected", "rank", "call_id", "lon", "lat"))


def c19_nearest_points(spark, d):
    """Of the ten farthest calls of each misrouted pair: the nearest points of the routed and of the expected border."""
    from pyspark.sql import Window as W

    s = L.labelled(spark, d).where("label = 1").withColumn("rank", F.row_number().over(W.partitionBy("routed", "expected").orderBy(F.desc(F.round("d_routed", 2)), "call_id"))).where("rank <= 10")
    side = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(k).alias("psap_id")) for k in ("routed", "expected"))))
    return tidy(geo.nearest_points(s.select("call_id", "lon", "lat", side.alias("s")).select("call_id", "lon", "lat", "s.side", "s.psap_id"), edge_index.build(L.edges(spark, d))).drop("lon", "lat"))


def _lines(spark, d):
    keep = lambda c, cond: F.when(F.expr(cond), F.col(c)).alias(c)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("call_id"), "l_linenumber", "l_linestatus", keep("l_quantity", "l_partkey % 3 <> 0"), keep("l_tax", "l_suppkey % 4 <> 0"))


def a2_complete_grain(spark, d):
    return tidy(grain.complete_grain(_lines(spark, d), "call_id", ["l_quantity", "l_tax"], ["l_linestatus"], [F.col("l_linenumber")]))


def j9_representative_rows(spark, d):
    return tidy(grain.call_grain(_lines(spark, d), "call_id", [], [F.col("l_linenumber")]).select("call_id", "n_rows", "l_linenumber", "l_quantity"))


def j5_key_coverage(spark, d):
    return tidy(grain.key_coverage(table(spark, d, "orders"), table(spark, d, "customer"), [("o_custkey", "c_custkey"), ("o_orderkey", "c_custkey"), ("o_custkey", "c_nationkey")]))


def a54_join_diagnostics(spark, d):
    ev = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"), F.col("l_partkey").alias("p"), F.concat_ws("-", "l_suppkey", "l_partkey").alias("s"))
    return tidy(grain.stage_diagnostics(ev, "event_id", {"ICID": "p", "LINE": "s"}, L._bridges(spark, d)))


def _enrichment(spark, d):
    """Urgent orders as calls; returned and accepted lines name their order, the others have part and supplier only."""
    calls = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("cell"))
    li = table(spark, d, "lineitem").withColumns({"part": F.col("l_partkey"), "line": F.concat_ws("-", "l_suppkey", "l_partkey"), "event_id": F.concat_ws("-", "l_orderkey", "l_linenumber")})
    keys = {"ICID": "part", "LINE": "line"}
    exact = enrich.Source(li.where("l_returnflag <> 'N'"), "l_orderkey", keys, "l_quantity", "l_linestatus")
    events = enrich.Source(li.where("l_returnflag = 'N'").withColumns({k: F.when(F.col("l_linenumber") < 6, F.col(k)) for k in keys.values()}), "event_id", keys, "l_quantity", "l_linestatus")
    return enrich.two_stage(calls, "call_id", exact, events, scratch(spark, "enrichment"))


def c4_enriched(spark, d):
    return tidy(_enrichment(spark, d)["enriched"])


def c4_quarantine(spark, d):
    return tidy(_enrichment(spark, d)["quarantine"])


def c4_diagnostics(spark, d):
    return tidy(_enrichment(spark, d)["diagnostics"])


def a8_source_counts(spark, d):
    """Rows and distinct keys of orders, and of a key inside JSON."""
    o = table(spark, d, "orders").withColumn("js", F.to_json(F.struct(F.col("o_custkey").alias("k"))))
    return tidy(o.agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("customers"), F.count_distinct(F.get_json_object("js", "$.k")).alias("json_customers")))


def a15_candidates(spark, d):
    return tidy(rca.candidates(rca.entity_hypothesis(L.labelled(spark, d), "market", "market"), "market").select("market", "strong", "misroutes", "hypothesis"))


def cohorts(spark, d):
    """Matched cohorts with a score and what the network says about them."""
    m = matched(spark, d)
    first = lambda c: F.substring(c, 1, 1)
    both = lambda c, f=lambda x: x: (f(F.col(f"{c}_mode")), f(F.col(f"control_{c}_mode")))
    none = F.lit(None).cast("string")
    route = F.when(F.col("routed") % 7 == 0, "ESRK_MISMATCH").when(F.col("routed") % 3 == 0, F.col("route_status_mode")), F.when(F.col("routed") % 3 == 0, F.col("control_route_status_mode"))
    modes = {
        "route": route, "esinet": tuple(F.when(F.col("routed") % 3 == 1, x) for x in both("priority")), "esz": (none, none), "sip": tuple(F.when(F.col("routed") % 5 == 2, x) for x in both("route_status")),
        "ims": tuple(F.when(F.col("routed") % 5 == 3, x) for x in both("priority", first)), "ecscf": (F.when(F.col("routed") % 5 == 4, F.col("route_status_mode")), F.lit("nan")),
    }
    fallback = F.when(F.col("routed") % 11 == 0, "Fallback WDLS").when(F.col("routed") % 11 == 1, "<MISSING>")
    said = network.interpretation(modes, fallback, F.when(F.col("routed") % 11 == 2, "yes"))
    score = rca.corroboration({f: F.coalesce(f"{f}_delta", F.lit(0.0)) for f in rca.EVIDENCE}, {"route": F.col("route_status_differs"), "esinet": F.col("priority_differs"), "esz": F.lit(False)})
    return m.select(*KEYS, said.alias("n"), score.alias("score"), F.col("calls").alias("misroutes"), F.col("control_calls").alias("controls")).select(*KEYS, "n.source", "n.sign", "n.strength", "score", "misroutes", "controls")


def c8_network_interpretation(spark, d):
    return tidy(cohorts(spark, d).drop("score", "misroutes", "controls"))


def c9_top_cohorts(spark, d):
    return tidy(network.presented(cohorts(spark, d), "score", "misroutes", "controls", KEYS, 100))


def a17_lift_subset(spark, d):
    return tidy(network.feature_subset(rca.lift(L.labelled(spark, d), L.FEATURES), ("STATUS", "PRIORITY")))


def _q(select: str, ctes: str = EVID) -> str:
    return f"WITH {ctes} {select}"


_PAIR = "pa AS (SELECT routed, expected, count(*) AS calls FROM l WHERE label = 1 GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (ORDER BY calls DESC, routed, expected) AS rank FROM pa)"
_LN = "ln AS (SELECT l_orderkey AS call_id, l_linenumber, l_linestatus, CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END AS l_quantity, CASE WHEN l_suppkey % 4 <> 0 THEN l_tax END AS l_tax FROM lineitem)"
_COV = " UNION ALL ".join(f"SELECT '{a}' AS left_key, '{b}' AS right_key, (SELECT avg(CASE WHEN k IS NULL THEN 0.0::DOUBLE ELSE 1 END) FROM orders LEFT JOIN (SELECT {b} AS k FROM customer GROUP BY 1 HAVING count(*) = 1) ON k = {a}) AS coverage" for a, b in (("o_custkey", "c_custkey"), ("o_orderkey", "c_custkey"), ("o_custkey", "c_nationkey")))
_NET = EVID + """, nt AS (SELECT sc.routed, sc.market, sc.score, sc.calls, sc.controls, CASE WHEN sc.routed % 7 = 0 THEN 'ESRK_MISMATCH' WHEN sc.routed % 3 = 0 THEN sc.route_status_mode ELSE '' END AS r1, CASE WHEN sc.routed % 3 = 0 THEN coalesce(ct.route_status_mode, '') ELSE '' END AS r0,
    CASE WHEN sc.routed % 3 = 1 THEN sc.priority_mode ELSE '' END AS e1, CASE WHEN sc.routed % 3 = 1 THEN coalesce(ct.priority_mode, '') ELSE '' END AS e0, CASE WHEN sc.routed % 5 = 2 THEN sc.route_status_mode ELSE '' END AS s1, CASE WHEN sc.routed % 5 = 2 THEN coalesce(ct.route_status_mode, '') ELSE '' END AS s0,
    CASE WHEN sc.routed % 5 = 3 THEN sc.priority_mode[1:1] ELSE '' END AS i1, CASE WHEN sc.routed % 5 = 3 THEN coalesce(ct.priority_mode[1:1], '') ELSE '' END AS i0, CASE WHEN sc.routed % 11 = 0 THEN 'Fallback WDLS' ELSE '' END AS fb, CASE WHEN sc.routed % 11 = 2 THEN 'yes' ELSE '' END AS df
    FROM sc LEFT JOIN ct USING (routed, market)),
  nk AS (SELECT *, CASE WHEN r1 = 'ESRK_MISMATCH' THEN 1 WHEN r1 <> '' AND r0 <> '' AND r1 <> r0 THEN 2 WHEN e1 <> '' AND e0 <> '' AND e1 <> e0 THEN 3 WHEN fb <> '' OR df <> '' THEN 4 WHEN s1 <> '' AND s0 <> '' AND s1 <> s0 THEN 5 WHEN i1 <> '' AND i0 <> '' AND i1 <> i0 THEN 6 ELSE 8 END AS k FROM nt),
  ni AS (SELECT routed, market, score, calls, controls, list_extract(['GMLC routing', 'GMLC routing', 'GMLC ESInet/ESZ', 'GMLC fallback/default routing', 'GMLC SIP signaling', 'IMS/P-CSCF', '', 'No isolated network field'], k) AS source,
    CASE k WHEN 1 THEN 'ROUTE_STATUS_GMLC=' || r1 WHEN 2 THEN 'Misroute=' || r1 || '; correct control=' || r0 WHEN 3 THEN 'ESInet ' || e1 || ' vs ' || e0 || '; ESZ n/a vs n/a' WHEN 4 THEN 'Fallback=' || CASE fb WHEN '' THEN 'n/a' ELSE fb END || '; default=' || CASE df WHEN '' THEN 'n/a' ELSE df END
      WHEN 5 THEN 'SIP misroute=' || s1 || '; correct control=' || s0 WHEN 6 THEN 'IMS P-CSCF misroute=' || i1 || '; correct control=' || i0 ELSE 'No single GMLC/IMS/CCDR mode clearly differs from controls' END AS sign,
    CASE WHEN k <= 3 THEN 'STRONG ASSOCIATION' WHEN k = 8 THEN 'GEOMETRY EVIDENCE ONLY' ELSE 'SUPPORTING ASSOCIATION' END AS strength FROM nk)"""

_GRAIN = ", ".join(f"{{1}}.{c} AS {{0}}_{n}" for n, c in (("rows", "n"), ("sum", "s"), ("min", "lo"), ("max", "hi"), ("mode", "v"), ("share", "share")))
_ENRICH = """w AS (SELECT o_orderkey AS call_id, o_custkey AS cell FROM orders WHERE o_orderpriority = '1-URGENT'), li AS (SELECT *, l_suppkey || '-' || l_partkey AS line, l_orderkey || '-' || l_linenumber AS event_id FROM lineitem),
    ex AS (SELECT l_orderkey AS call_id, l_partkey::VARCHAR AS part, line, l_quantity AS q, l_linestatus AS v FROM li WHERE l_returnflag <> 'N' AND l_orderkey IN (SELECT call_id FROM w)),
    br AS (SELECT kind, key, count(DISTINCT call_id) AS c, min(call_id) AS call_id FROM (SELECT call_id, 'ICID' AS kind, part AS key FROM ex UNION ALL SELECT call_id, 'LINE', line FROM ex) GROUP BY 1, 2),
    en AS (SELECT event_id, l_linenumber < 6 AS keyed, l_partkey::VARCHAR AS part, line, l_quantity AS q, l_linestatus AS v FROM li WHERE l_returnflag = 'N'),
    hit AS (SELECT event_id, count(DISTINCT b.call_id) FILTER (c = 1) AS n, min(b.call_id) FILTER (c = 1) AS call_id FROM en JOIN br b ON keyed AND (kind = 'ICID' AND key = part OR kind = 'LINE' AND key = line) GROUP BY 1),
    rs AS (SELECT en.*, CASE WHEN n = 1 THEN call_id END AS call_id, CASE WHEN NOT keyed THEN 'NO_KEY' WHEN n IS NULL THEN 'NO_BRIDGE' WHEN n = 0 THEN 'QUARANTINED_KEYS' WHEN n = 1 THEN 'MATCHED' ELSE 'CALLS_DISAGREE' END AS reason FROM en LEFT JOIN hit USING (event_id))""" + "".join(
    f""", {k} AS (SELECT call_id, sum(m)::BIGINT AS n, round(sum(sq)::DOUBLE, 6) AS s, round(min(lo)::DOUBLE, 6) AS lo, round(max(hi)::DOUBLE, 6) AS hi, first(v ORDER BY m DESC, v) AS v, round(max(m)::DOUBLE / sum(m), 6) AS share FROM (SELECT call_id, v, count(*) AS m, sum(q) AS sq, min(q) AS lo, max(q) AS hi FROM {t} GROUP BY 1, 2) GROUP BY 1)"""
    for k, t in (("ka", "ex"), ("kb", "rs WHERE reason = 'MATCHED'"))
)

QUERIES = {
    "c19_nearest_points": (c19_nearest_points, _q("""SELECT call_id, side, psap_id, round(p.x, 6) AS near_x, round(p.y, 6) AS near_y, p.d AS distance FROM (SELECT c.call_id, side, c.psap_id, min({'d': round(sqrt((ax + t * (bx - ax)) * (ax + t * (bx - ax)) + (ay + t * (by_ - ay)) * (ay + t * (by_ - ay))), 3), 'x': round(x1 + t * (x2 - x1), 9), 'y': round(y1 + t * (y2 - y1), 9)}) AS p
        FROM (SELECT call_id, unnest(['routed', 'expected']) AS side, unnest([routed, expected]) AS psap_id FROM (SELECT *, row_number() OVER (PARTITION BY routed, expected ORDER BY round(d_routed, 2) DESC, call_id) AS r FROM l WHERE label = 1) WHERE r <= 10) c JOIN e2 ON e2.call_id = c.call_id AND e2.psap_id = c.psap_id GROUP BY 1, 2, 3)""", L.LABELS)),
    "a15_candidates": (a15_candidates, _q("""SELECT market, strong, misroutes, CASE WHEN misroutes >= 3 AND share >= 0.8 AND separation >= 3 THEN 'REPEATED_PSAP_ROUTING_MAPPING' WHEN misroutes >= 3 AND n_expected > 1 THEN 'UNSTABLE_OR_MULTIPLE_EXPECTED_PSAP_PATTERN' WHEN separation < 3 THEN 'NEAR_BOUNDARY_OR_LOCATION_REVIEW' WHEN misroutes >= 2 THEN 'REPEATED_PATTERN_LOW_SUPPORT' ELSE 'ISOLATED_MISROUTE' END AS hypothesis
        FROM (SELECT market, count(*) AS strong, sum(label)::BIGINT AS misroutes, quantile_cont(d_routed / uncert, 0.5) FILTER (label = 1) AS separation FROM l WHERE label IS NOT NULL GROUP BY 1) JOIN
        (SELECT market, max(n)::DOUBLE / sum(n) AS share, count(DISTINCT expected) AS n_expected FROM (SELECT market, routed, expected, count(*) AS n FROM l WHERE label = 1 GROUP BY 1, 2, 3) GROUP BY 1) USING (market) WHERE strong >= 5 AND misroutes >= 3""", L.LABELS)),
    "c8_network_interpretation": (c8_network_interpretation, _q("SELECT routed, market, source, sign, strength FROM ni", _NET)),
    "c9_top_cohorts": (c9_top_cohorts, _q("SELECT row_number() OVER (ORDER BY score DESC, calls DESC, controls DESC, routed, market) AS presentation_rank, routed, market, source, sign, strength, score::BIGINT AS score, calls AS misroutes, controls FROM ni ORDER BY 1 LIMIT 100", _NET)),
    "a17_lift_subset": (a17_lift_subset, _q("""SELECT feature, value, calls, misroutes, round(misroutes::DOUBLE / calls, 6) AS rate, round(misroutes::DOUBLE / calls / g, 6) AS lift, round(calls * g, 6) AS expected, round(misroutes - calls * g, 6) AS excess FROM
        (SELECT 'priority' AS feature, priority AS value, count(*) AS calls, sum(label)::BIGINT AS misroutes FROM l WHERE label IS NOT NULL GROUP BY 2 UNION ALL SELECT 'route_status', route_status, count(*), sum(label)::BIGINT FROM l WHERE label IS NOT NULL GROUP BY 2), (SELECT avg(label) AS g FROM l) WHERE calls >= 20 AND misroutes >= 3""", L.LABELS)),
    "a23_case_profiles": (a23_case_profiles, _q("SELECT routed, market, calls, first_seen, last_seen, " + _R(*(f"{f}_rate" for f in FLAGS), *(f"{c}_share" for c in CATEGORIES)) + ", " + ", ".join(f"{c}_mode, {c}_mode_count" for c in CATEGORIES) + " FROM ca")),
    "c5_matched_evidence": (c5_matched_evidence, _q("SELECT routed, market, calls, controls AS control_calls, " + _R(*(f"d_{f}" for f in FLAGS)) + ", " + ", ".join(f"{c}_differs" for c in CATEGORIES) + " FROM me")),
    "c7_conclusion_and_cause": (c7_conclusion_and_cause, _q("SELECT * FROM ju", JUDGED)),
    "a52_evidence_summary": (a52_evidence_summary, _q("SELECT conclusion, cause, count(*) AS patterns, sum(calls)::BIGINT AS calls FROM ju GROUP BY 1, 2", JUDGED)),
    "a24_cohort_denominators": (a24_cohort_denominators, _q("SELECT cell, market, priority, count(label) AS strong, count(*) FILTER (label = 1) AS misroutes, count(*) FILTER (label = 0) AS correct FROM l GROUP BY 1, 2, 3", L.LABELS)),
    "a25_frequent_name": (a25_frequent_name, _q("SELECT routed, arg_min(market, (-n, market)) AS name FROM (SELECT routed, market, count(*) AS n FROM l GROUP BY 1, 2) GROUP BY 1", L.LABELS)),
    "a26_strong_pairs": (a26_strong_pairs, _q("""SELECT routed, expected, count(*) AS calls, min(call_time) AS first_seen, max(call_time) AS last_seen, round(min(d_routed), 6) AS min_d, round(avg(d_routed), 6) AS avg_d, round(max(d_routed), 6) AS max_d, round(min(d_routed - uncert), 6) AS min_clearance, sum(route)::BIGINT AS route_calls, sum(fallback)::BIGINT AS fallback_calls,
        array_to_string(list_sort(list(DISTINCT market)), ' | ') AS market_ids, row_number() OVER (ORDER BY count(*) DESC, routed, expected) AS rank FROM fl WHERE label = 1 GROUP BY 1, 2""", FL)),
    "a13_pair_summary": (a13_pair_summary, _q("""SELECT market, routed, expected, misroutes, active_days, round(median_d, 6) AS median_d, round(p95_d, 6) AS p95_d, round(median_ratio, 6) AS median_ratio, round(misroutes::DOUBLE / sum(misroutes) OVER (PARTITION BY market), 6) AS level_share, round(misroutes::DOUBLE / sum(misroutes) OVER (PARTITION BY routed, expected), 6) AS pair_share FROM
        (SELECT market, routed, expected, count(DISTINCT call_id) AS misroutes, count(DISTINCT call_time::DATE) AS active_days, quantile_cont(d_routed, 0.5) AS median_d, quantile_cont(d_routed, 0.95) AS p95_d, quantile_cont(d_routed / uncert, 0.5) AS median_ratio FROM l WHERE label = 1 GROUP BY 1, 2, 3)""", L.LABELS)),
    "a15_hypothesis": (a15_hypothesis, _q("""SELECT cell, strong, misroutes, round(separation, 6) AS separation, n_expected, round(share, 6) AS pair_share, CASE WHEN misroutes = 0 THEN 'NO_MISROUTE' WHEN misroutes >= 3 AND share >= 0.8 AND separation >= 3 THEN 'LIKELY_CELL_TO_PSAP_MAPPING' WHEN misroutes >= 3 AND n_expected > 1 THEN 'UNSTABLE_OR_MULTIPLE_EXPECTED_PSAP_PATTERN'
        WHEN separation < 3 THEN 'NEAR_BOUNDARY_OR_LOCATION_REVIEW' WHEN misroutes >= 2 THEN 'REPEATED_PATTERN_LOW_SUPPORT' ELSE 'ISOLATED_MISROUTE' END AS hypothesis FROM (SELECT g.*, n_expected, top::DOUBLE / nullif(misroutes, 0) AS share FROM
        (SELECT cell, count(*) AS strong, sum(label)::BIGINT AS misroutes, quantile_cont(d_routed / uncert, 0.5) FILTER (label = 1) AS separation FROM l WHERE label IS NOT NULL GROUP BY 1) g LEFT JOIN
        (SELECT cell, max(n) AS top, count(DISTINCT expected) AS n_expected FROM (SELECT cell, routed, expected, count(*) AS n FROM l WHERE label = 1 GROUP BY 1, 2, 3) GROUP BY 1) USING (cell))""", L.LABELS)),
    "j13_drill_down": (j13_drill_down, _q("SELECT call_id, rank AS pattern_rank FROM l JOIN rk USING (routed, expected) WHERE label = 1 AND rank <= 10", f"{L.LABELS}, {_PAIR}")),
    "c19_top_calls": (c19_top_calls, _q("SELECT * FROM (SELECT routed, expected, row_number() OVER (PARTITION BY routed, expected ORDER BY round(d_routed, 2) DESC, call_id) AS rank, call_id, lon, lat FROM l WHERE label = 1) WHERE rank <= 10", L.LABELS)),
    "a2_complete_grain": (a2_complete_grain, _q("SELECT * FROM (SELECT call_id, count(*) OVER (PARTITION BY call_id) AS n_rows, l_linenumber::BIGINT AS l_linenumber, l_linestatus, l_quantity, l_tax, ((l_quantity IS NOT NULL)::BIGINT + (l_tax IS NOT NULL)::BIGINT) AS completeness FROM ln QUALIFY min(l_linestatus) OVER (PARTITION BY call_id) = max(l_linestatus) OVER (PARTITION BY call_id) AND row_number() OVER (PARTITION BY call_id ORDER BY (l_quantity IS NOT NULL)::INT + (l_tax IS NOT NULL)::INT DESC, l_linenumber, l_linestatus, l_quantity NULLS FIRST, l_tax NULLS FIRST) = 1)", _LN)),
    "j9_representative_rows": (j9_representative_rows, _q("SELECT call_id, count(*) OVER (PARTITION BY call_id) AS n_rows, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM ln QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY l_linenumber, l_linestatus, l_quantity NULLS FIRST, l_tax NULLS FIRST) = 1", _LN)),
    "j5_key_coverage": (j5_key_coverage, _q("SELECT left_key, right_key, round(coverage, 6) AS coverage, coverage >= 0.5 AND row_number() OVER (ORDER BY coverage DESC, left_key DESC, right_key DESC) = 1 AS accepted FROM cv", f"cv AS ({_COV})")),
    "a54_join_diagnostics": (a54_join_diagnostics, _q("SELECT kind AS stage, sum(n)::BIGINT AS eligible, coalesce(sum(n) FILTER (c = 1), 0)::BIGINT AS matched, count(*) FILTER (c = 1) AS safe_keys, count(*) FILTER (c > 1) AS quarantined_keys, coalesce(sum(n) FILTER (c > 1), 0)::BIGINT AS quarantined_events, round((coalesce(sum(n) FILTER (c = 1), 0))::DOUBLE / sum(n), 6) AS coverage FROM bk GROUP BY 1", "bk AS (SELECT kind, key, count(*) AS n, count(DISTINCT call_id) AS c FROM (SELECT 'ICID' AS kind, l_partkey::VARCHAR AS key, l_orderkey AS call_id FROM lineitem UNION ALL SELECT 'LINE', l_suppkey || '-' || l_partkey, l_orderkey FROM lineitem) GROUP BY 1, 2)")),
    "c4_enriched": (c4_enriched, _q(f"SELECT call_id, cell, {_GRAIN.format('exact', 'a')}, {_GRAIN.format('bridged', 'b')} FROM w LEFT JOIN ka a USING (call_id) LEFT JOIN kb b USING (call_id)", _ENRICH)),
    "c4_quarantine": (c4_quarantine, _q("SELECT kind, key, c AS n_calls FROM br WHERE c > 1", _ENRICH)),
    "c4_diagnostics": (c4_diagnostics, _q("""SELECT stage, count(*) AS source_rows, count(*) FILTER (reason <> 'NO_KEY') AS eligible_rows, count(*) FILTER (reason = 'MATCHED') AS matched_rows, count(DISTINCT call_id) FILTER (reason = 'MATCHED') AS calls, count(*) FILTER (reason = 'NO_KEY') AS no_key, count(*) FILTER (reason = 'NO_BRIDGE') AS no_bridge, count(*) FILTER (reason = 'QUARANTINED_KEYS') AS quarantined_keys, count(*) FILTER (reason = 'CALLS_DISAGREE') AS calls_disagree,
        round((count(*) FILTER (reason = 'MATCHED'))::DOUBLE / nullif(count(*) FILTER (reason <> 'NO_KEY'), 0), 6) AS coverage FROM (SELECT 'BRIDGED' AS stage, reason, call_id FROM rs UNION ALL SELECT 'EXACT', CASE WHEN l_orderkey IN (SELECT call_id FROM w) THEN 'MATCHED' ELSE 'NO_BRIDGE' END, l_orderkey FROM lineitem WHERE l_returnflag <> 'N') GROUP BY 1""", _ENRICH)),
    "a8_source_counts": (a8_source_counts, "SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_custkey) AS json_customers FROM orders"),
}
