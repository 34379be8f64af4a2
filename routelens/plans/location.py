"""Queries over located calls: labels, grain, risk, lift, enrichment and mapping audits, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import boundaries, edge_index, geo, grain, rca
from ..sources.tables import split_chunks, table
from .common import tidy


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    k = F.col("o_orderkey")
    lon = F.when(k % 89 != 0, (k * 7919 % 5400).cast("double") / 1000)
    lat = F.lit(30.0) + (F.col("o_custkey") * 104729 % 5000).cast("double") / 1000
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("lon", lon).withColumn("lat", lat)
    routed = F.when(k % 101 == 0, 99).when(k % 3 == 0, F.col("c_nationkey")).otherwise(F.floor("lon") + 5 * F.floor(F.col("lat") - 30))
    return rows.select(
        k.alias("call_id"), "lon", "lat", F.when(k % 97 != 0, (100 + k * 31 % 20000).cast("double")).alias("uncert"), routed.cast("bigint").alias("routed"), F.col("c_mktsegment").alias("market"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("route_status"), F.col("o_orderdate").alias("call_time"), F.col("o_custkey").alias("cell"), F.col("o_totalprice").alias("price"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    x, y = (F.col("n_nationkey") % 5).cast("double"), F.lit(30.0) + F.floor(F.col("n_nationkey") / 5).cast("double")
    ring = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
    sides = F.explode(F.array(*(F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))))
    return n.select(F.col("n_nationkey").cast("bigint").alias("psap_id"), sides.alias("e")).select("psap_id", "e.*")


def boundary_texts(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """The squares of edges() as texts of many shapes, in chunks of 50 characters; with broken, texts that can't be read among them."""
    x, y = (F.col("n_nationkey") % 5).cast("int"), F.lit(30) + F.floor(F.col("n_nationkey") / 5).cast("int")
    corner = lambda a, b, sep: F.concat_ws(sep, (x + a).cast("string"), (y + b).cast("string"))
    ring = lambda sep, pre, post: F.concat_ws(", ", *(F.concat(F.lit(pre), corner(a, b, sep), F.lit(post)) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))
    points = ring(",", "[", "]")
    text = lambda before, after: F.concat(F.lit(before), points, F.lit(after))
    shapes = [
        text('{"type":"Polygon","coordinates":[[', "]]}"), text('{"type":"MultiPolygon","coordinates":[[[', "]]]}"), text('{"type":"Feature","properties":{"a":1},"geometry":{"type":"Polygon","coordinates":[[', "]]}}"),
        text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,0],[9,9],[3,3],[4,4]]}},{"type":"Feature","geometry":{"coordinates":[[', ']],"type":"Polygon"}}]}'),
        text('{"geometry":{"coordinates":[[', "]]}}"), text('{"payload":"{\\"type\\":\\"Polygon\\",\\"coordinates\\":[[', ']]}"}'), F.concat(F.lit("POLYGON (("), ring(" ", "", ""), F.lit("))")), F.concat(F.lit("MULTIPOLYGON ((("), ring(" ", "", ""), F.lit(")))")),
        text('{"type":"Feature","geometry":{"type":"Polygon","crs":{"type":"name","properties":{"name":"EPSG:4326"}},"coordinates":[[', ']]},"properties":{"geometry":{"type":"Polygon","coordinates":[[[8,8],[9,8],[9,9],[8,8]]]}}}'),
        text('{"other":[{"deep":[[{"geojson":"{\\"geom\\":{\\"bbox\\":[0,0],\\"coordinates\\":[[[', ']]],\\"type\\":\\"MultiPolygon\\"}}"}]]}]}'), text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":null},{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,1]]]}},{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[', "]]}}]}"),
        text('[{"type":"Polygon","coordinates":[[', "]]}]"), text('{"type":"GeometryCollection","geometries":[{"type":"Polygon","coordinates":[ [ ', ' ] ]},{"type":"Point","coordinates":[1,2]}]}'),
    ]
    faults = [text('{"type":"Polygon","coordinates":[[', "]}"), F.lit(""), F.lit('{"type":"Point","coordinates":[1,2]}'), F.lit("POLYGON ((0 0, 1 1))"), text('{"type":"LineString","coordinates":[', "]}"), F.lit("rubbish")]
    key, kind = F.col("n_nationkey"), F.col("n_nationkey") % len(shapes)
    whole = F.element_at(F.array(*shapes), (kind + 1).cast("int"))
    if broken:
        whole = F.when(key % 4 == 1, F.element_at(F.array(*faults), (F.floor(key / 4) % len(faults) + 1).cast("int"))).otherwise(whole)
    psap = F.concat(F.lit(' "'), F.when((key % 5 == 3) & F.lit(broken), "").otherwise(key.cast("string")), F.lit('.0"'))
    psap = F.when((key % 5 == 3) & F.lit(broken), "").otherwise(psap)
    rows = table(spark, sf_dir, "nation").select(key.alias("n"), psap.alias("psap_id"), F.concat(F.lit("N"), key.cast("string")).alias("nena_id"), whole.alias("text"))
    return split_chunks(rows, "n", "text", 50).join(rows.select("n", "psap_id", "nena_id"), "n").select("psap_id", "nena_id", F.col("chunk_no").cast("string").alias("chunk_no"), "chunk")


def parsed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.edges(boundaries.parse(boundary_texts(spark, sf_dir))).withColumn("psap_id", F.col("psap_id").cast("bigint"))


def labelled(spark: SparkSession, sf_dir: str, policy: str = "strict") -> DataFrame:
    return geo.label_routes(calls(spark, sf_dir), edges(spark, sf_dir), policy)


CALLS = """calls AS (
  SELECT o_orderkey AS call_id, CASE WHEN o_orderkey % 89 <> 0 THEN (o_orderkey * 7919 % 5400)::DOUBLE / 1000 END AS lon, 30.0::DOUBLE + (o_custkey * 104729 % 5000)::DOUBLE / 1000 AS lat,
    CASE WHEN o_orderkey % 97 <> 0 THEN (100 + o_orderkey * 31 % 20000)::DOUBLE END AS uncert,
    (CASE WHEN o_orderkey % 101 = 0 THEN 99 WHEN o_orderkey % 3 = 0 THEN c_nationkey
     ELSE floor((CASE WHEN o_orderkey % 89 <> 0 THEN (o_orderkey * 7919 % 5400)::DOUBLE / 1000 END)) + 5 * floor((o_custkey * 104729 % 5000)::DOUBLE / 1000) END)::BIGINT AS routed,
    c_mktsegment AS market, o_orderpriority AS priority, o_orderstatus AS route_status, o_orderdate AS call_time, o_custkey AS cell, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
EDGES = """sq AS (SELECT n_nationkey::BIGINT AS psap_id, (n_nationkey % 5)::DOUBLE AS x, 30.0::DOUBLE + floor(n_nationkey / 5)::DOUBLE AS y FROM nation),
edges AS (SELECT psap_id, x AS x1, y AS y1, x + 1 AS x2, y AS y2 FROM sq UNION ALL SELECT psap_id, x + 1, y, x + 1, y + 1 FROM sq
  UNION ALL SELECT psap_id, x + 1, y + 1, x, y + 1 FROM sq UNION ALL SELECT psap_id, x, y + 1, x, y FROM sq)"""
RING = """w AS (SELECT call_id, uncert, vertex, radians(lon) AS l, radians(lat) AS p, uncert / 6371008.8 AS r, radians(vertex * 15.0::DOUBLE) AS b FROM (SELECT *, unnest(range(0, 24)) AS vertex FROM calls WHERE lon IS NOT NULL AND uncert > 0)),
    w2 AS (SELECT *, asin(sin(p) * cos(r) + cos(p) * sin(r) * cos(b)) AS q FROM w), v AS (SELECT call_id, uncert, vertex, degrees(q) AS y, degrees(l + atan2(sin(b) * sin(r) * cos(p), cos(r) - sin(p) * sin(q))) AS x FROM w2)"""
#: An edge runs through the area of a call if it crosses a side of the 24-gon or begins inside all of them.
MEASURE = f"""{RING}, side AS (SELECT a.call_id, a.x AS vx, a.y AS vy, b.x - a.x AS ex, b.y - a.y AS ey FROM v a JOIN v b ON a.call_id = b.call_id AND b.vertex = (a.vertex + 1) % 24),
e1 AS (SELECT call_id, lon, lat, uncert, routed, psap_id, x1, y1, x2, y2, (x1 - lon) * 111320 * cos(radians(lat)) AS ax, (y1 - lat) * 110574 AS ay,
    (x2 - lon) * 111320 * cos(radians(lat)) AS bx, (y2 - lat) * 110574 AS by_ FROM calls, edges WHERE lon IS NOT NULL AND uncert > 0),
e2 AS (SELECT *, greatest(0.0, least(1.0, -(ax * (bx - ax) + ay * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM e1),
e3 AS (SELECT *, sqrt((ax + t * (bx - ax)) * (ax + t * (bx - ax)) + (ay + t * (by_ - ay)) * (ay + t * (by_ - ay))) AS d FROM e2),
near AS (SELECT call_id, psap_id, bool_or(crosses) OR bool_or(starts_in) AS touched FROM (SELECT e.call_id, psap_id, x1, y1, x2, y2,
    bool_or((ex * (y1 - vy) - ey * (x1 - vx) < 0) <> (ex * (y2 - vy) - ey * (x2 - vx) < 0) AND ((x2 - x1) * (vy - y1) - (y2 - y1) * (vx - x1) < 0) <> ((x2 - x1) * (vy + ey - y1) - (y2 - y1) * (vx + ex - x1) < 0)) AS crosses,
    bool_and(ex * (y1 - vy) - ey * (x1 - vx) < 0) AS starts_in FROM e3 e JOIN side ON side.call_id = e.call_id WHERE d < 1.1 * uncert GROUP BY ALL) GROUP BY ALL),
m AS (SELECT e3.call_id, e3.psap_id, uncert, routed, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) THEN 1 ELSE 0 END) % 2 = 1 AS parity,
    min(d) AS d, coalesce(bool_or(touched), false) AS touched FROM e3 LEFT JOIN near ON near.call_id = e3.call_id AND near.psap_id = e3.psap_id GROUP BY e3.call_id, e3.psap_id, uncert, routed),
f AS (SELECT *, parity OR d <= 0.000001 AS ins, (parity OR d <= 0.000001) AND NOT touched AS cov, parity OR d <= 0.000001 OR touched AS met, psap_id = routed AS own FROM m),
a AS (SELECT call_id, count(*) FILTER (own) AS has, count(*) FILTER (own AND cov) AS own_cov, count(*) FILTER (own AND met) AS own_met, count(*) FILTER (met) AS met, count(*) FILTER (cov) AS cov, count(*) FILTER (ins) AS ins,
    count(*) FILTER (NOT own AND cov) AS alt_cov, count(*) FILTER (NOT own AND met) AS alt_met, count(*) FILTER (NOT own AND ins) AS alt_in, count(*) FILTER (own AND ins) AS own_in,
    max(psap_id) FILTER (NOT own AND cov) AS cov_id, max(psap_id) FILTER (NOT own AND ins) AS in_id, max(d) FILTER (own) AS d_routed, max(d) FILTER (NOT own AND cov) AS cov_d, max(d) FILTER (NOT own AND ins) AS in_d
  FROM f GROUP BY call_id)"""
LABELS = f"""{CALLS}, {EDGES}, {MEASURE},
s AS (SELECT calls.*, a.* EXCLUDE (call_id), CASE WHEN lon IS NULL THEN 'MISSING_LOCATION' WHEN uncert IS NULL OR uncert <= 0 THEN 'INVALID_UNCERTAINTY' WHEN coalesce(has, 0) = 0 THEN 'MISSING_ROUTED_BOUNDARY'
    WHEN own_cov = 1 AND met = 1 THEN 'DEFINITE_CORRECT' WHEN own_met = 0 AND alt_cov = 1 AND met = 1 THEN 'DEFINITE_MISROUTE' WHEN met > 1 OR (own_met > 0 AND alt_met > 0) THEN 'BOUNDARY_AMBIGUOUS'
    WHEN alt_in = 1 THEN 'POINT_MISMATCH_LOW_CONFIDENCE' WHEN met = 0 THEN 'NO_CONTAINING_PSAP' ELSE 'BOUNDARY_AMBIGUOUS' END AS status FROM calls LEFT JOIN a USING (call_id)),
l AS (SELECT call_id, lon, lat, uncert, routed, market, priority, route_status, call_time, cell, price, status,
    CASE WHEN status = 'DEFINITE_CORRECT' THEN routed WHEN status = 'DEFINITE_MISROUTE' OR (status = 'BOUNDARY_AMBIGUOUS' AND alt_cov = 1) THEN cov_id WHEN status = 'POINT_MISMATCH_LOW_CONFIDENCE' THEN in_id END AS expected,
    CASE WHEN status = 'DEFINITE_MISROUTE' THEN 1 WHEN status = 'DEFINITE_CORRECT' THEN 0 END::BIGINT AS label, d_routed,
    CASE WHEN status = 'DEFINITE_CORRECT' THEN d_routed WHEN status = 'DEFINITE_MISROUTE' OR (status = 'BOUNDARY_AMBIGUOUS' AND alt_cov = 1) THEN cov_d WHEN status = 'POINT_MISMATCH_LOW_CONFIDENCE' THEN in_d END AS d_expected FROM s)"""
WILSON = "(k / n + 3.8416 / (2 * n) - 1.96 * sqrt((k / n * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)"
FEATURES = ["market", "priority", "route_status"]
LONG = "long AS (" + " UNION ALL ".join(f"SELECT call_id, label, '{f}' AS feature, {f} AS value FROM l WHERE label IS NOT NULL" for f in FEATURES) + ")"


def c1_route_labels(spark, d):
    return tidy(labelled(spark, d).select("call_id", "status", "expected", "label", F.round("d_routed", 2).alias("d_routed"), F.round("d_expected", 2).alias("d_expected")))


def c3_boundaries(spark, d):
    p = boundaries.parse(boundary_texts(spark, d, broken=True))
    area = F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2
    sized = boundaries.edges(p).groupBy("psap_id").agg(F.count("*").alias("n_edges"), area.alias("area"), F.min("x1").alias("west"), F.min("y1").alias("south"))
    return tidy(p.select("psap_id", "nena_id", "parse_status").join(sized, "psap_id", "left"))


def c1_from_boundary_texts(spark, d):
    got = geo.label_routes(calls(spark, d), parsed_edges(spark, d))
    return tidy(got.groupBy("status", "routed", "expected").agg(F.count("*").alias("calls"), F.sum("label").alias("misroutes"), F.round(F.max("d_routed"), 2).alias("max_d_routed")))


def f20_uncertainty_ring(spark, d):
    c = calls(spark, d).where("lon IS NOT NULL AND uncert > 0").select("call_id", F.posexplode(geo.ring(F.col("lon"), F.col("lat"), F.col("uncert"))).alias("vertex", "p"), "lon", "lat")
    return tidy(c.select("call_id", "vertex", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.round(geo.haversine(F.col("lon"), F.col("lat"), F.col("p.x"), F.col("p.y")), 2).alias("distance")))


def j10_ring_in_polygons(spark, d):
    c = calls(spark, d).where("lon IS NOT NULL AND uncert > 0")
    return tidy(geo.ring_in_polygons(c, edge_index.build(edges(spark, d))))


def c2_route_labels_v1(spark, d):
    return tidy(labelled(spark, d, "v1").groupBy("status").agg(F.count("*").alias("calls")))


def a9_label_distribution(spark, d):
    g = labelled(spark, d).groupBy("status").agg(F.count("*").alias("calls"))
    total = g.agg(F.sum("calls").alias("t"))
    return tidy(g.crossJoin(F.broadcast(total)).select("status", "calls", (100 * F.col("calls") / F.col("t")).alias("pct")))


def a10_population_summary(spark, d):
    s = labelled(spark, d).withColumn("population", F.when(F.col("call_id") % 50 == 0, "TEST").otherwise("PRODUCTION"))
    return tidy(s.groupBy("population").agg(F.count("*").alias("calls"), F.count("label").alias("strong"), F.sum("label").alias("misroutes"), N.safe_rate(F.sum("label"), F.count("label")).alias("rate")))


def a11_route_pair_summary(spark, d):
    s = labelled(spark, d).where("label = 1")
    g = s.groupBy("routed", "expected", "market")
    return tidy(g.agg(F.count("*").alias("misroutes"), F.min("call_time").alias("first_seen"), F.max("call_time").alias("last_seen"), F.min(F.round("d_routed", 2)).alias("min_d"), F.max(F.round("d_expected", 2)).alias("max_d")))


def a12_episode_summary(spark, d):
    g = labelled(spark, d).where("label = 1").groupBy("routed", "expected", "cell").agg(F.count("*").alias("misroutes"), F.count_distinct(F.to_date("call_time")).alias("active_days"))
    return tidy(g.where("misroutes >= 2"))


def a14_entity_risk(spark, d):
    return tidy(rca.risk(labelled(spark, d), {"psap": F.col("routed"), "market": F.col("market"), "priority": F.col("priority"), "cell": F.col("cell")}))


def a16_categorical_lift(spark, d):
    return tidy(rca.lift(labelled(spark, d), FEATURES))


def a18_missingness_lift(spark, d):
    s = labelled(spark, d).withColumn("market", F.when(F.col("call_id") % 7 != 0, F.col("market")))
    return tidy(rca.missingness(s, ["market", "priority"]))


def a19_numeric_comparison(spark, d):
    return tidy(rca.numeric_comparison(labelled(spark, d), ["uncert", "price"]))


def a20_daily_trend(spark, d):
    g = labelled(spark, d).where("label IS NOT NULL").groupBy(F.date_trunc("month", "call_time").alias("month"))
    return tidy(g.agg(F.count("*").alias("strong"), F.sum("label").alias("misroutes"), F.avg("label").alias("rate")))


def a21_missing_boundary(spark, d):
    g = labelled(spark, d).where("status = 'MISSING_ROUTED_BOUNDARY'").groupBy("routed")
    return tidy(g.agg(F.count("*").alias("calls"), F.count_distinct("cell").alias("cells"), F.min("call_time").alias("first_seen"), F.max("call_time").alias("last_seen")))


def j11_control_match(spark, d):
    s = labelled(spark, d)
    levels = [("exact", ["cell", "market"], 5), ("market_priority", ["market", "priority"], 150), ("market", ["market"], 200), ("population", [], 0)]
    return tidy(rca.hierarchical_control(s.where("label = 1").select("call_id", "cell", "market", "priority"), s.where("label = 0"), levels).select("call_id", "control_level", "controls"))


def a1_call_grain(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("call_id"), "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    return tidy(grain.call_grain(rows, "call_id", ["l_returnflag", "l_linestatus"], [F.col("l_linenumber")]))


def a3_event_aggregate(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("call_id"))
    return tidy(g.agg(F.count("*").alias("n"), F.sum("l_quantity").alias("sum_q"), F.avg("l_discount").alias("mean_d"), F.min("l_tax").alias("min_t"), F.max("l_tax").alias("max_t"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("any_r")))


def a4_mode_pack(spark, d):
    return tidy(grain.mode_pack(table(spark, d, "lineitem").withColumn("call_id", F.col("l_orderkey")), ["call_id"], "l_returnflag"))


def _bridges(spark, d):
    li = table(spark, d, "lineitem")
    part = li.select(F.col("l_orderkey").alias("call_id"), F.lit("ICID").alias("kind"), F.col("l_partkey").cast("string").alias("key"))
    supp = li.select(F.col("l_orderkey").alias("call_id"), F.lit("LINE").alias("kind"), F.concat_ws("-", "l_suppkey", "l_partkey").alias("key"))
    return grain.bridge(part.unionByName(supp).distinct(), "call_id", "kind", "key")


def j7_safe_bridge(spark, d):
    return tidy(_bridges(spark, d))


def j8_event_map(spark, d):
    ev = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"), F.col("l_partkey").alias("p"), F.concat_ws("-", "l_suppkey", "l_partkey").alias("s"))
    return tidy(grain.map_events(ev, "event_id", {"ICID": "p", "LINE": "s"}, _bridges(spark, d), "call_id"))


def j6_reciprocal_asof(spark, d):
    e = table(spark, d, "events")
    side = lambda kind: e.where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), "ts", "user_id")
    return tidy(grain.nearest_reciprocal(side("click"), side("error"), ["user_id"], 7200.0))


def a6_mapping_coverage(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    raw = F.concat(F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 7 == 0, ".0").otherwise(""))
    left = o.select(N.normalize_id(raw).alias("k"))
    keys = c.select(N.normalize_id(F.col("c_custkey")).alias("ck")).distinct()
    j = left.join(keys, F.col("k") == F.col("ck"), "left")
    m = F.count("ck")
    return tidy(j.agg(F.count("*").alias("n_rows"), F.count("k").alias("non_null"), F.count_distinct("k").alias("distinct_keys"), m.alias("matched"), (F.count("k") - m).alias("unmatched"), F.round(100 * F.try_divide(m, F.count("k")), 2).alias("rate_pct")))


def a7_value_profile(spark, d):
    p = table(spark, d, "part").select(N.alnum_key(F.col("p_brand")).alias("v"), "p_brand")
    g = p.groupBy("v").agg(F.min("p_brand").alias("example"), F.count("*").alias("n"))
    return tidy(g.orderBy(F.desc("n"), "v").limit(200))


def _q(select: str, ctes: str = LABELS) -> str:
    return f"WITH {ctes} {select}"


_RING_SQL = f", {RING}"

QUERIES = {
    "c1_route_labels": (c1_route_labels, _q("SELECT call_id, status, expected, label, round(d_routed, 2) AS d_routed, round(d_expected, 2) AS d_expected FROM l")),
    "c3_boundaries": (c3_boundaries, """SELECT CASE WHEN k % 5 = 3 THEN '' ELSE k::VARCHAR END AS psap_id, 'N' || k AS nena_id, CASE WHEN k % 5 = 3 THEN CASE WHEN k % 4 = 1 THEN 'MISSING_FCC_AND_PARSE_ERROR' ELSE 'MISSING_FCC_ID' END WHEN k % 4 = 1 THEN 'PARSE_ERROR' ELSE 'OK' END AS parse_status,
        CASE WHEN ok THEN 4 END::BIGINT AS n_edges, CASE WHEN ok THEN 1.0 END::DOUBLE AS area, CASE WHEN ok THEN k % 5 END::DOUBLE AS west, CASE WHEN ok THEN 30 + k // 5 END::DOUBLE AS south FROM (SELECT n_nationkey AS k, n_nationkey % 5 <> 3 AND n_nationkey % 4 <> 1 AS ok FROM nation)"""),
    "c1_from_boundary_texts": (c1_from_boundary_texts, _q("SELECT status, routed, expected, count(*) AS calls, sum(label)::BIGINT AS misroutes, round(max(d_routed), 2) AS max_d_routed FROM l GROUP BY 1, 2, 3")),
    "f20_uncertainty_ring": (f20_uncertainty_ring, _q(_RING_SQL + " SELECT call_id, vertex, round(x, 6) AS x, round(y, 6) AS y, round(uncert, 2) AS distance FROM v", CALLS)),
    "j10_ring_in_polygons": (j10_ring_in_polygons, _q(_RING_SQL + f", {EDGES}" + """ SELECT call_id, psap_id, count(*) AS inside FROM (SELECT call_id, vertex, psap_id, sum(CASE WHEN (y1 > v.y) <> (y2 > v.y) AND v.x < x1 + (v.y - y1) * (x2 - x1) / (y2 - y1) THEN 1 ELSE 0 END) % 2 AS odd FROM v, edges GROUP BY 1, 2, 3) WHERE odd = 1 GROUP BY 1, 2""", CALLS)),
    "c2_route_labels_v1": (c2_route_labels_v1, _q("""SELECT CASE WHEN lon IS NULL THEN 'INVALID_LOCATION' WHEN routed IS NULL THEN 'MISSING_ROUTED_PSAP' WHEN uncert IS NULL OR uncert <= 0 THEN 'INVALID_UNCERTAINTY' WHEN coalesce(has, 0) = 0 THEN 'ROUTED_PSAP_BOUNDARY_MISSING'
        WHEN ins = 0 THEN 'NO_BOUNDARY_AT_REPORTED_CENTER' WHEN ins > 1 THEN 'AMBIGUOUS_OVERLAPPING_BOUNDARIES' WHEN own_cov = 1 AND cov = 1 THEN 'CORRECT_UNAMBIGUOUS' WHEN own_met = 0 AND alt_cov = 1 THEN 'DEFINITE_MISROUTE'
        WHEN own_in = 1 THEN 'ROUTED_PSAP_CONSISTENT_BUT_BOUNDARY_AMBIGUOUS' ELSE 'LIKELY_MISROUTE_BOUNDARY_AMBIGUOUS' END AS status, count(*) AS calls FROM s GROUP BY 1""")),
    "a9_label_distribution": (a9_label_distribution, _q("SELECT status, count(*) AS calls, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM l), 6) AS pct FROM l GROUP BY status")),
    "a10_population_summary": (a10_population_summary, _q("SELECT CASE WHEN call_id % 50 = 0 THEN 'TEST' ELSE 'PRODUCTION' END AS population, count(*) AS calls, count(label) AS strong, sum(label)::BIGINT AS misroutes, round(sum(label)::DOUBLE / count(label), 6) AS rate FROM l GROUP BY 1")),
    "a11_route_pair_summary": (a11_route_pair_summary, _q("SELECT routed, expected, market, count(*) AS misroutes, min(call_time) AS first_seen, max(call_time) AS last_seen, min(round(d_routed, 2)) AS min_d, max(round(d_expected, 2)) AS max_d FROM l WHERE label = 1 GROUP BY ALL")),
    "a12_episode_summary": (a12_episode_summary, _q("SELECT routed, expected, cell, count(*) AS misroutes, count(DISTINCT call_time::DATE) AS active_days FROM l WHERE label = 1 GROUP BY ALL HAVING count(*) >= 2")),
    "a14_entity_risk": (a14_entity_risk, _q("SELECT level, entity, calls, misroutes, active_days, round(k / n, 6) AS rate, round(" + WILSON + ", 6) AS wilson FROM (SELECT level, entity, count(*) AS calls, sum(label)::BIGINT AS misroutes, count(DISTINCT call_time::DATE) AS active_days, sum(label)::DOUBLE AS k, count(*)::DOUBLE AS n FROM ("
        + " UNION ALL ".join(f"SELECT '{lv}' AS level, {c}::VARCHAR AS entity, label, call_time FROM l WHERE label IS NOT NULL" for lv, c in (("psap", "routed"), ("market", "market"), ("priority", "priority"), ("cell", "cell"))) + ") GROUP BY level, entity)")),
    "a16_categorical_lift": (a16_categorical_lift, _q("SELECT feature, value, calls, misroutes, round(misroutes::DOUBLE / calls, 6) AS rate, round(misroutes::DOUBLE / calls / g, 6) AS lift, round(calls * g, 6) AS expected, round(misroutes - calls * g, 6) AS excess FROM (SELECT feature, coalesce(value, '<MISSING>') AS value, count(*) AS calls, sum(label)::BIGINT AS misroutes FROM long GROUP BY 1, 2), (SELECT avg(label)::DOUBLE AS g FROM l WHERE label IS NOT NULL) WHERE calls >= 20 AND misroutes >= 3", LABELS + ", " + LONG)),
    "a18_missingness_lift": (a18_missingness_lift, _q("SELECT f.feature, st.state, count(x.label) AS calls, coalesce(sum(x.label), 0)::BIGINT AS misroutes, round(sum(x.label)::DOUBLE / nullif(count(x.label), 0), 6) AS rate FROM (VALUES ('market'), ('priority')) f(feature), (VALUES ('MISSING'), ('PRESENT')) st(state) LEFT JOIN (SELECT 'market' AS feature, CASE WHEN call_id % 7 = 0 THEN 'MISSING' ELSE 'PRESENT' END AS state, label FROM l WHERE label IS NOT NULL UNION ALL SELECT 'priority', 'PRESENT', label FROM l WHERE label IS NOT NULL) x ON x.feature = f.feature AND x.state = st.state GROUP BY 1, 2")),
    "a19_numeric_comparison": (a19_numeric_comparison, _q("SELECT feature, count(x) FILTER (label = 0) AS n_correct, round(avg(x) FILTER (label = 0), 6) AS mean_correct, round(min(x) FILTER (label = 0), 6) AS min_correct, round(max(x) FILTER (label = 0), 6) AS max_correct, count(x) FILTER (label = 1) AS n_misroute, round(avg(x) FILTER (label = 1), 6) AS mean_misroute, round(min(x) FILTER (label = 1), 6) AS min_misroute, round(max(x) FILTER (label = 1), 6) AS max_misroute, round(avg(x) FILTER (label = 1) - avg(x) FILTER (label = 0), 6) AS difference FROM (SELECT 'uncert' AS feature, uncert AS x, label FROM l WHERE label IS NOT NULL UNION ALL SELECT 'price', price, label FROM l WHERE label IS NOT NULL) GROUP BY feature")),
    "a20_daily_trend": (a20_daily_trend, _q("SELECT date_trunc('month', call_time)::TIMESTAMP AS month, count(*) AS strong, sum(label)::BIGINT AS misroutes, round(avg(label), 6) AS rate FROM l WHERE label IS NOT NULL GROUP BY 1")),
    "a21_missing_boundary": (a21_missing_boundary, _q("SELECT routed, count(*) AS calls, count(DISTINCT cell) AS cells, min(call_time) AS first_seen, max(call_time) AS last_seen FROM l WHERE status = 'MISSING_ROUTED_BOUNDARY' GROUP BY routed")),
    "j11_control_match": (j11_control_match, _q("""SELECT c.call_id, CASE WHEN e.n >= 5 THEN 'exact' WHEN mp.n >= 150 THEN 'market_priority' WHEN m.n >= 200 THEN 'market' ELSE 'population' END AS control_level,
        CASE WHEN e.n >= 5 THEN e.n WHEN mp.n >= 150 THEN mp.n WHEN m.n >= 200 THEN m.n ELSE (SELECT count(*) FROM l WHERE label = 0) END AS controls
        FROM (SELECT * FROM l WHERE label = 1) c LEFT JOIN (SELECT cell, market, count(*) AS n FROM l WHERE label = 0 GROUP BY 1, 2) e ON e.cell = c.cell AND e.market = c.market
        LEFT JOIN (SELECT market, priority, count(*) AS n FROM l WHERE label = 0 GROUP BY 1, 2) mp ON mp.market = c.market AND mp.priority = c.priority LEFT JOIN (SELECT market, count(*) AS n FROM l WHERE label = 0 GROUP BY 1) m ON m.market = c.market""")),
    "a1_call_grain": (a1_call_grain, "SELECT call_id, n_rows, n_l_returnflag, n_l_linestatus, n_l_returnflag > 1 OR n_l_linestatus > 1 AS conflict, l_returnflag, l_linestatus, l_linenumber, l_quantity FROM (SELECT l_orderkey AS call_id, count(*) AS n_rows, count(DISTINCT l_returnflag) AS n_l_returnflag, count(DISTINCT l_linestatus) AS n_l_linestatus FROM lineitem GROUP BY 1) JOIN (SELECT l_orderkey AS call_id, l_returnflag, l_linestatus, l_linenumber::BIGINT AS l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus, l_quantity) AS r FROM lineitem) USING (call_id) WHERE r = 1"),
    "a3_event_aggregate": (a3_event_aggregate, "SELECT l_orderkey AS call_id, count(*) AS n, round(sum(l_quantity)::DOUBLE, 6) AS sum_q, round(avg(l_discount), 6) AS mean_d, round(min(l_tax)::DOUBLE, 6) AS min_t, round(max(l_tax)::DOUBLE, 6) AS max_t, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS any_r FROM lineitem GROUP BY 1"),
    "a4_mode_pack": (a4_mode_pack, "SELECT call_id, v AS mode, n AS mode_count, total, round(n::DOUBLE / total, 6) AS share FROM (SELECT l_orderkey AS call_id, l_returnflag AS v, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_orderkey)::BIGINT AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_returnflag) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1"),
    "j7_safe_bridge": (j7_safe_bridge, "SELECT kind, key, count(DISTINCT call_id) AS n_calls, count(DISTINCT call_id) = 1 AS safe, CASE WHEN count(DISTINCT call_id) = 1 THEN min(call_id) END AS call_id FROM (SELECT l_orderkey AS call_id, 'ICID' AS kind, l_partkey::VARCHAR AS key FROM lineitem UNION SELECT l_orderkey, 'LINE', l_suppkey || '-' || l_partkey FROM lineitem) GROUP BY 1, 2"),
    "j8_event_map": (j8_event_map, """WITH k AS (SELECT l_orderkey AS call_id, 'ICID' AS kind, l_partkey::VARCHAR AS key FROM lineitem UNION SELECT l_orderkey, 'LINE', l_suppkey || '-' || l_partkey FROM lineitem),
        b AS (SELECT kind, key, min(call_id) AS call_id FROM k GROUP BY 1, 2 HAVING count(DISTINCT call_id) = 1),
        e AS (SELECT l_orderkey || '-' || l_linenumber AS event_id, 'ICID' AS kind, l_partkey::VARCHAR AS key FROM lineitem UNION ALL SELECT l_orderkey || '-' || l_linenumber, 'LINE', l_suppkey || '-' || l_partkey FROM lineitem)
        SELECT event_id, count(DISTINCT call_id) AS n_calls, CASE WHEN count(DISTINCT call_id) = 1 THEN min(call_id) END AS call_id, CASE WHEN count(DISTINCT call_id) = 1 THEN min(kind) END AS kind FROM e JOIN b USING (kind, key) GROUP BY event_id"""),
    "j6_reciprocal_asof": (j6_reciprocal_asof, """WITH p AS (SELECT a.event_id AS left_id, b.event_id AS right_id, abs(epoch_us(a.ts) - epoch_us(b.ts))::DOUBLE / 1000000 AS gap, a.ts AS lt, b.ts AS rt FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'error' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 7200000000),
        r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY gap, rt, right_id) AS rl, row_number() OVER (PARTITION BY right_id ORDER BY gap, lt, left_id) AS rr FROM p) SELECT left_id, right_id, round(gap, 6) AS gap FROM r WHERE rl = 1 AND rr = 1"""),
    "a6_mapping_coverage": (a6_mapping_coverage, "SELECT count(*) AS n_rows, count(o_custkey) AS non_null, count(DISTINCT o_custkey) AS distinct_keys, count(c_custkey) AS matched, count(o_custkey) - count(c_custkey) AS unmatched, round(100.0 * count(c_custkey) / count(o_custkey), 2)::DOUBLE AS rate_pct FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "a7_value_profile": (a7_value_profile, "SELECT regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') AS v, min(p_brand) AS example, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, v LIMIT 200"),
}
