"""Point- and area-in-polygon join and route-integrity labels.

Polygons come as edges (psap_id, x1, y1, x2, y2); holes and parts are ordinary edges. They are put into a grid once (edge_index), and a call
meets the edges of its own cells only. The area of a call is the 24-gon around its position. A polygon covers it if the position is inside and no
edge runs through the area, and meets it if the position is inside or an edge does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edge_index import M_PER_LAT, M_PER_LON, EdgeIndex, build, containing, containing_bits, near_edges, nearest_edges

#: The distance up to which a point is on a border. Radius of the sphere in metres. Vertices of a call's area.
ON_BORDER, EARTH_RADIUS, VERTICES = 1e-6, 6_371_008.8, 24
#: Of the radius: an edge nearer than the first runs through the area, one farther than the second doesn't; between them its sides decide. The
#: plane of distances departs from the sphere of rings as areas grow, and so do the bounds; areas of more than so many metres are disks.
SURELY_IN, SURELY_OUT, LARGEST_RING = 0.97, 1.02, 500_000.0


def segment_distance(lon: Column, lat: Column) -> Column:
    """Metres from a point to the edge x1..y2, on a plane scaled at the point's latitude."""
    kx = F.lit(M_PER_LON) * F.cos(F.radians(lat))
    ax, ay = (F.col("x1") - lon) * kx, (F.col("y1") - lat) * M_PER_LAT
    bx, by = (F.col("x2") - lon) * kx, (F.col("y2") - lat) * M_PER_LAT
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length))).otherwise(0.0)
    return F.sqrt((ax + t * dx) * (ax + t * dx) + (ay + t * dy) * (ay + t * dy))


def measure(calls: DataFrame, index: EdgeIndex) -> DataFrame:
    """call_id, psap_id, inside, touched (an edge runs through the call's area) and own (its routed polygon) for each call (call_id, lon, lat, uncert, routed) and each polygon that its area meets, and its routed polygon."""
    lon, lat = F.col("lon"), F.col("lat")
    spread = F.when(F.col("uncert") <= LARGEST_RING, F.col("uncert") / EARTH_RADIUS * (1 + F.tan(F.radians(F.least(F.abs(lat), F.lit(85.0)))))).otherwise(0.0)
    near = near_edges(calls.withColumn("reach", F.col("uncert") * (SURELY_OUT + spread)), index)
    dy, dx = F.col("reach") / M_PER_LAT, F.col("reach") / (F.lit(M_PER_LON) * F.cos(F.radians(lat)))
    boxed = [(F.least(f"{a}1", f"{a}2") <= at + by) & (F.greatest(f"{a}1", f"{a}2") >= at - by) for a, at, by in (("x", lon, dx), ("y", lat, dy))]
    near = near.where(boxed[0] & boxed[1]).withColumn("d", segment_distance(lon, lat))
    sides = F.when(F.col("uncert") > LARGEST_RING, F.col("d") < F.col("uncert")).when(F.col("d") < F.col("uncert") * (SURELY_IN - spread), True).when(F.col("d") > F.col("reach"), False)
    # the ring is made for edges in the band between the bounds alone, and once for each of them
    near = near.withColumn("sure", sides).withColumn("ring", F.when(F.col("sure").isNull(), ring(lon, lat, F.col("uncert"))))
    no = F.lit(False)
    near = near.select("call_id", "psap_id", (F.col("d") <= ON_BORDER).alias("inside"), F.coalesce("sure", runs_through(F.col("ring"))).alias("touched"), no.alias("own"))
    held = containing(calls, index, ["call_id"]).select("call_id", "psap_id", F.lit(True).alias("inside"), no.alias("touched"), no.alias("own"))
    own = calls.select("call_id", F.col("routed").alias("psap_id")).join(index.ids, "psap_id").select("call_id", "psap_id", no.alias("inside"), no.alias("touched"), F.lit(True).alias("own"))
    found = near.unionByName(held).unionByName(own).groupBy("call_id", "psap_id").agg(*(F.max(x).alias(x) for x in ("inside", "touched", "own")))
    return found.where("inside OR touched OR own")


def distances(pairs: DataFrame, index: EdgeIndex) -> DataFrame:
    """pairs (lon, lat, psap_id and what else makes a row unique) with d, the metres to the polygon's border."""
    return nearest_edges(pairs, index).groupBy(*pairs.columns).agg(F.min(segment_distance(F.col("lon"), F.col("lat"))).alias("d"))


def runs_through(polygon: Column) -> Column:
    """Whether the edge x1..y2 runs through a convex polygon (an array of (x, y), clockwise): what its sides leave of the edge has a length."""
    n = F.size(polygon)

    def clip(left: Column, k: Column) -> Column:
        v, w = F.get(polygon, k), F.get(polygon, (k + 1) % n)
        ex, ey = w["x"] - v["x"], w["y"] - v["y"]
        a = ex * (F.col("y1") - v["y"]) - ey * (F.col("x1") - v["x"])
        b = ex * (F.col("y2") - F.col("y1")) - ey * (F.col("x2") - F.col("x1"))
        cut = -a / F.when(b != 0, b)
        lo = F.when(b < 0, F.greatest(left["lo"], cut)).otherwise(left["lo"])
        hi = F.when(b > 0, F.least(left["hi"], cut)).when((b == 0) & (a >= 0), F.lit(-1.0)).otherwise(left["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    whole = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), whole, clip, lambda left: left["lo"] < left["hi"])


def ring(lon: Column, lat: Column, radius: Column, vertices: int = VERTICES) -> Column:
    """Vertices of a regular ring around a point on the sphere, as an array of (x, y), the first from the north, clockwise."""
    arc, phi = radius / EARTH_RADIUS, F.radians(lat)

    def vertex(k: Column) -> Column:
        bearing = F.radians(k * (360.0 / vertices))
        y = F.asin(F.sin(phi) * F.cos(arc) + F.cos(phi) * F.sin(arc) * F.cos(bearing))
        x = F.radians(lon) + F.atan2(F.sin(bearing) * F.sin(arc) * F.cos(phi), F.cos(arc) - F.sin(phi) * F.sin(y))
        return F.struct(F.degrees(x).alias("x"), F.degrees(y).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(vertices - 1)), vertex)


def ring_in_polygons(calls: DataFrame, index: EdgeIndex, vertices: int = VERTICES) -> DataFrame:
    """call_id, psap_id and how many of the ring's vertices lie inside, for each polygon that holds any."""
    calls = calls.select("call_id", "lon", "lat", "uncert").repartition("call_id")  # the one shuffle, before there are rows for vertices
    points = calls.select("call_id", F.posexplode(ring(F.col("lon"), F.col("lat"), F.col("uncert"), vertices)).alias("vertex", "p"))
    points = points.select("call_id", F.floor(F.col("vertex") / 64).alias("word"), (F.col("vertex") % 64).alias("bit"), F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))
    held = containing_bits(points, index, ["call_id", "word"])
    return held.groupBy("call_id", "psap_id").agg(F.sum(F.bit_count("bits")).alias("inside")).where("inside > 0")


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points on the sphere."""
    dy, dx = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dy / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dx / 2), F.lit(2))
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(h))


def nearest_points(pairs: DataFrame, index: EdgeIndex) -> DataFrame:
    """pairs (with call_id, lon, lat, psap_id) with the point of the polygon's border that lies nearest, and its distance (C19). Of equally near points the westernmost, then southernmost."""
    lon, lat = F.col("lon"), F.col("lat")
    kx = F.lit(M_PER_LON) * F.cos(F.radians(lat))
    dx, dy = (F.col("x2") - F.col("x1")) * kx, (F.col("y2") - F.col("y1")) * M_PER_LAT
    along = F.try_divide((lon - F.col("x1")) * kx * dx + (lat - F.col("y1")) * M_PER_LAT * dy, dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    place = F.struct(F.round(segment_distance(lon, lat), 3).alias("d"), F.round(F.col("x1") + t * (F.col("x2") - F.col("x1")), 9).alias("x"), F.round(F.col("y1") + t * (F.col("y2") - F.col("y1")), 9).alias("y"))
    rows = nearest_edges(pairs, index).groupBy(*pairs.columns).agg(F.min(place).alias("p"))
    return rows.select(*pairs.columns, F.col("p.x").alias("near_x"), F.col("p.y").alias("near_y"), F.col("p.d").alias("distance"))


def validity(lat: Column, lon: Column, uncert: Column) -> Column:
    """The first thing wrong with a location, or null."""
    in_range = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(lat.isNull() | lon.isNull(), "MISSING_LOCATION").when(~in_range, "INVALID_LOCATION").when(uncert.isNull() | (uncert <= 0), "INVALID_UNCERTAINTY")


def label_routes(calls: DataFrame, edges: DataFrame | EdgeIndex, policy: str = "strict") -> DataFrame:
    """calls (call_id, lon, lat, uncert, routed, ...) with status, expected, label, d_routed and d_expected. policy: strict or v1."""
    index = edges if isinstance(edges, EdgeIndex) else build(edges)
    calls = calls.withColumn("__bad", validity(F.col("lat"), F.col("lon"), F.col("uncert")))
    usable = calls.where("__bad IS NULL").select("call_id", "lon", "lat", "uncert", "routed")
    found = measure(usable, index)
    covers, meets, own = F.col("inside") & ~F.col("touched"), F.col("inside") | F.col("touched"), F.col("own")
    count, pick = (lambda c: F.count(F.when(c, 1))), (lambda c, v: F.max(F.when(c, F.col(v))))
    per_call = found.groupBy("call_id").agg(
        count(own).alias("has"), count(own & covers).alias("own_cov"), count(own & meets).alias("own_met"), count(meets).alias("met"), count(covers).alias("cov"), count(F.col("inside")).alias("ins"),
        count(~own & covers).alias("alt_cov"), count(~own & meets).alias("alt_met"), count(~own & F.col("inside")).alias("alt_in"), count(own & F.col("inside")).alias("own_in"),
        pick(~own & covers, "psap_id").alias("cov_id"), pick(~own & F.col("inside"), "psap_id").alias("in_id"),
    )
    c = F.col
    right = (c("own_cov") == 1) & (c("met") == 1)
    wrong = (c("own_met") == 0) & (c("alt_cov") == 1) & (c("met") == 1)
    unclear = (c("met") > 1) | ((c("own_met") > 0) & (c("alt_met") > 0))
    no_border = F.coalesce(c("has"), F.lit(0)) == 0
    if policy == "v1":
        bad = F.when(c("__bad").isin("MISSING_LOCATION", "INVALID_LOCATION"), "INVALID_LOCATION").when(c("routed").isNull(), "MISSING_ROUTED_PSAP").otherwise(c("__bad"))
        status = (
            F.when(bad.isNotNull(), bad).when(no_border, "ROUTED_PSAP_BOUNDARY_MISSING").when(c("ins") == 0, "NO_BOUNDARY_AT_REPORTED_CENTER")
            .when(c("ins") > 1, "AMBIGUOUS_OVERLAPPING_BOUNDARIES").when((c("own_cov") == 1) & (c("cov") == 1), "CORRECT_UNAMBIGUOUS")
            .when((c("own_met") == 0) & (c("alt_cov") == 1), "DEFINITE_MISROUTE").when(c("own_in") == 1, "ROUTED_PSAP_CONSISTENT_BUT_BOUNDARY_AMBIGUOUS").otherwise("LIKELY_MISROUTE_BOUNDARY_AMBIGUOUS")
        )
        good = "CORRECT_UNAMBIGUOUS"
    else:
        status = (
            F.when(c("__bad").isNotNull(), c("__bad")).when(no_border, "MISSING_ROUTED_BOUNDARY").when(right, "DEFINITE_CORRECT").when(wrong, "DEFINITE_MISROUTE")
            .when(unclear, "BOUNDARY_AMBIGUOUS").when(c("alt_in") == 1, "POINT_MISMATCH_LOW_CONFIDENCE").when(c("met") == 0, "NO_CONTAINING_PSAP").otherwise("BOUNDARY_AMBIGUOUS")
        )
        good = "DEFINITE_CORRECT"
    by_cover = (c("status") == "BOUNDARY_AMBIGUOUS") & (c("alt_cov") == 1) | (c("status") == "DEFINITE_MISROUTE")
    chosen = F.when(c("status") == good, c("routed")).when(by_cover, c("cov_id")).when(c("status").isin("POINT_MISMATCH_LOW_CONFIDENCE", "LIKELY_MISROUTE_BOUNDARY_AMBIGUOUS"), c("in_id"))
    out = calls.join(per_call, "call_id", "left").withColumn("status", status).withColumn("expected", chosen)
    kept = [x for x in calls.columns if x != "__bad"]
    out = out.select(*kept, "status", "expected", F.when(c("status") == "DEFINITE_MISROUTE", 1).when(c("status") == good, 0).alias("label"), "__bad")
    pairs = out.where("__bad IS NULL").select("call_id", "lon", "lat", F.explode(F.array_distinct(F.array("routed", "expected"))).alias("psap_id")).where("psap_id IS NOT NULL")
    d = distances(pairs, index).groupBy("call_id").agg(F.map_from_entries(F.collect_list(F.struct("psap_id", "d"))).alias("d"))  # two at most
    return out.join(d, "call_id", "left").select(*kept, "status", "expected", "label", F.try_element_at("d", c("routed")).alias("d_routed"), F.try_element_at("d", c("expected")).alias("d_expected"))
