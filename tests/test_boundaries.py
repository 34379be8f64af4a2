"""Boundaries of many shapes: whatever the nesting, the members' order and what else there is."""

import json

import pytest

from routelens.operators import boundaries

RING = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
AREA = {"type": "Polygon", "crs": {"type": "name", "properties": {"name": "x"}}, "coordinates": [RING]}
FAR = {"type": "Polygon", "coordinates": [[[x + 10, y] for x, y in RING]]}
SHORT = {"type": "Polygon", "coordinates": [[[0, 0], [1, 1]]]}
HOLED = {"type": "Polygon", "coordinates": [RING, [[0.5, 0.5, 7], [1, 0.5, 7], [1, 1, 7], [0.5, 0.5, 7]]]}
SHAPES = {
    "crs first": (AREA, 1, 0),
    "holes and heights": (HOLED, 2, 0),
    "multi": ({"coordinates": [AREA["coordinates"], FAR["coordinates"]], "type": "MultiPolygon"}, 2, 0),
    "no type": ({"coordinates": [RING]}, 1, 0),
    "no type, multi": ({"coordinates": [[RING]]}, 1, 0),
    "collection": ({"type": "GeometryCollection", "geometries": [AREA, {"type": "Point", "coordinates": [1, 2]}, FAR]}, 2, 0),
    "features, one bad": ({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": AREA}, {"type": "Feature", "geometry": SHORT}, {"type": "Feature", "geometry": None}]}, 1, 1),
    "properties of a feature don't count": ({"type": "Feature", "properties": FAR, "geometry": AREA}, 1, 0),
    "embedded twice": ({"payload": json.dumps({"geojson": json.dumps([[AREA]])})}, 1, 0),
    "embedded text": ({"geom": "POLYGON ((0 0, 2 0, 2 2, 0 0))"}, 1, 0),
    "deep": ({"a": {"b": [{"c": {"d": {"e": [[[AREA]]]}}}]}}, 1, 0),
    "no number": ({"type": "Polygon", "coordinates": [[[0, "x"], [1, 1], [1, 0], [0, 0]]]}, None, 1),
    "wrong depth": ({"type": "Polygon", "coordinates": RING}, None, 1),
    "line": ({"type": "LineString", "coordinates": RING}, None, 0),
    "only bad": (SHORT, None, 1),
    "empty": ({}, None, 0),
    "number": (5, None, 0),
    "null": (None, None, 0),
}


@pytest.fixture(scope="module")
def parsed(spark):
    texts = [(k, json.dumps(v[0])) for k, v in SHAPES.items()] + [("wkt", "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"), ("rubbish", "{"), ("none", None), ("blank", "")]
    rows = [(k, "N", str(n), t[at : at + 20] if t is not None else None) for k, t in texts for n, at in enumerate(range(0, max(1, len(t or "")), 20))]
    got = boundaries.parse(spark.createDataFrame(rows, "psap_id string, nena_id string, chunk_no string, chunk string"))
    return {r.psap_id: r for r in got.collect()}


@pytest.mark.parametrize("name", [*SHAPES, "wkt", "rubbish", "none", "blank"])
def test_shape(parsed, name):
    _, rings, bad = SHAPES.get(name, (None, 2 if name == "wkt" else None, 0))
    r = parsed[name.upper()]
    assert (len(r.rings) if r.rings else None, r.bad_geometries, r.parse_status) == (rings, bad, "OK" if rings else "PARSE_ERROR")


def test_no_boundaries(spark):
    none = spark.createDataFrame([], "psap_id string, nena_id string, chunk_no string, chunk string")
    assert boundaries.parse(none).collect() == [] and boundaries.edges(boundaries.parse(none)).collect() == []
