"""Jurisdiction boundaries from chunked texts of many shapes, as edges with a parse status.

A text may be GeoJSON (geometry, feature, feature collection, geometry collection, any of them under another key, in arrays, or as an embedded
string, with or without a type) or well-known text. Polygons count; points and lines do not. JSON is walked as variants, a level of nesting for all
boundaries at a time, until nothing is left to open: a feature leads to its geometry, a collection to its members, an object without a type to
the first of GEOMETRY_KEYS that it has, or to all it holds, a string to what it says. So other members, like a crs, don't matter, nor their order. A geometry
with a ring that has too few points, or a point without numbers, is left out and counted; the others of its boundary stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import norm_id
from ..sources.files import scratch

#: Where an object without a type keeps its geometry, in this order. Fixed values.
GEOMETRY_KEYS = ("geometry", "geom", "geojson", "payload", "properties")
MEMBERS = {"FEATURE": "geometry", "FEATURECOLLECTION": "features", "GEOMETRYCOLLECTION": "geometries"}
AREAS, OTHERS = ("POLYGON", "MULTIPOLYGON"), ("POINT", "MULTIPOINT", "LINESTRING", "MULTILINESTRING")


def join_chunks(chunks: DataFrame) -> DataFrame:
    """psap_id, nena_id and the whole text of each boundary. chunks: psap_id, nena_id, chunk_no and chunk; a boundary's chunks are one row's worth."""
    number = F.coalesce(F.col("chunk_no").try_cast("int"), F.lit(0))
    parts = F.array_sort(F.collect_list(F.struct(number.alias("no"), F.coalesce("chunk", F.lit("")).alias("chunk"))))
    return chunks.groupBy(norm_id(F.col("psap_id")).alias("psap_id"), norm_id(F.col("nena_id")).alias("nena_id")).agg(F.array_join(F.transform(parts, lambda x: x["chunk"]), "").alias("text"))


def _member(path: str) -> Column:
    """What v has there, null if it has nothing or a JSON null."""
    got = F.try_variant_get("v", f"$.{path}", "variant")
    return F.when(~F.is_variant_null(got), got)


def geometries(texts: DataFrame, key: list[str]) -> DataFrame:
    """key, coordinates (variant, of a JSON geometry that may be an area) and wkt (text of a well-known one) of all that the texts (columns of key, and text) hold."""
    spark, found, level = texts.sparkSession, [], 0
    said = texts.select(*key, "text")
    nodes = said.select(*key, "text", F.try_parse_json("text").alias("v"))
    at = scratch(spark, "geometries")
    while True:
        path = f"{at}/{level}"
        nodes.write.parquet(path)
        nodes = spark.read.schema(nodes.schema).parquet(path)
        if nodes.isEmpty():
            break
        found.append(nodes.where("v IS NULL").select(*key, F.lit(None).cast("variant").alias("coordinates"), F.col("text").alias("wkt")))
        kind = F.schema_of_variant("v")
        opened = nodes.where("v IS NOT NULL").select(*key, "v", F.regexp_extract(kind, "^[A-Z]+", 0).alias("kind"), F.upper(F.try_variant_get("v", "$.type", "string")).alias("type"), _member("coordinates").alias("coordinates"))
        typed = F.coalesce(F.col("type").isin(*AREAS, *OTHERS, *MEMBERS), F.lit(False))
        area = F.coalesce(F.col("type").isin(*AREAS), F.lit(False)) | (~typed & F.col("coordinates").isNotNull())
        found.append(opened.where(area).select(*key, "coordinates", F.lit(None).cast("string").alias("wkt")))
        rest = opened.where(~area & ~F.coalesce(F.col("type").isin(*OTHERS), F.lit(False)))
        child = F.coalesce(*(F.when(F.col("type") == t, _member(m)) for t, m in MEMBERS.items()), F.when(~typed, F.coalesce(*map(_member, GEOMETRY_KEYS))))
        rest = rest.withColumn("child", F.when(F.col("kind") == "OBJECT", child))
        strings = rest.where("kind = 'STRING'").select(*key, F.try_variant_get("v", "$", "string").alias("text"))
        strings = strings.select(*key, "text", F.try_parse_json("text").alias("v"))
        named = rest.where("child IS NOT NULL").select(*key, F.lit(None).cast("string").alias("text"), F.col("child").alias("v"))
        every = rest.where(F.col("child").isNull() & ((F.col("kind") == "ARRAY") | (F.col("kind") == "OBJECT") & ~typed))
        every = every.select(*key, "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("value").alias("one")))
        every = every.where(~F.is_variant_null("one")).select(*key, F.lit(None).cast("string").alias("text"), F.col("one").alias("v"))
        nodes, level = strings.unionByName(named).unionByName(every), level + 1
    return reduce(DataFrame.unionByName, found) if found else said.select(*key, F.lit(None).cast("variant").alias("coordinates"), F.col("text").alias("wkt"))


def rings(found: DataFrame, key: list[str]) -> DataFrame:
    """key and rings (arrays of (x, y)) of each geometry of geometries(); null where it can't be read. Texts that aren't areas are left out."""
    well_known = F.upper("wkt").rlike(r"^\s*(MULTI)?POLYGON\s*Z?\s*\(")
    wkt = F.transform(F.regexp_extract_all("wkt", F.lit(r"\(([^()]+)\)")), lambda r: F.transform(F.split(r, ","), lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda n: n.try_cast("double"))))
    deep = F.try_variant_get("coordinates", "$[0][0][0][0]", "variant").isNotNull()
    one, many = (F.try_variant_get("coordinates", "$", t) for t in ("array<array<array<double>>>", "array<array<array<array<double>>>>"))
    points = F.when(F.col("wkt").isNotNull(), wkt).when(deep, F.flatten(many)).otherwise(one)
    numbers = F.transform(points, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    usable = found.where(F.col("coordinates").isNotNull() | well_known).withColumn("numbers", numbers)
    bad = F.exists("numbers", lambda r: F.coalesce((F.size(r) < 4) | F.exists(r, lambda p: p["x"].isNull() | p["y"].isNull()), F.lit(True)))
    return usable.select(*key, F.when((F.size("numbers") > 0) & ~bad, F.col("numbers")).alias("rings"))


def parse(chunks: DataFrame) -> DataFrame:
    """psap_id, nena_id, rings, bad_geometries (how many were left out) and parse_status (OK, PARSE_ERROR, MISSING_FCC_ID, MISSING_FCC_AND_PARSE_ERROR) of each boundary."""
    key, at = ["psap_id", "nena_id"], scratch(chunks.sparkSession, "boundaries")
    join_chunks(chunks).write.parquet(at)
    texts = chunks.sparkSession.read.schema("psap_id string, nena_id string, text string").parquet(at)
    read = rings(geometries(texts, key), key).groupBy(*key).agg(F.flatten(F.collect_list("rings")).alias("rings"), F.count(F.when(F.col("rings").isNull(), 1)).alias("bad_geometries"))
    read = texts.select(*key).join(read, key, "left").select(*key, F.when(F.size("rings") > 0, F.col("rings")).alias("rings"), F.coalesce("bad_geometries", F.lit(0)).alias("bad_geometries"))
    fine, named = F.col("rings").isNotNull(), F.col("psap_id") != ""
    return read.withColumn("parse_status", F.when(named, F.when(fine, "OK").otherwise("PARSE_ERROR")).otherwise(F.when(fine, "MISSING_FCC_ID").otherwise("MISSING_FCC_AND_PARSE_ERROR")))


def edges(parsed: DataFrame) -> DataFrame:
    """psap_id, part and the edges x1, y1, x2, y2 of the boundaries that were read; open rings are closed. Pieces of one id are its parts."""
    rings = parsed.where("parse_status = 'OK'").select("psap_id", F.xxhash64("nena_id").alias("part"), F.explode("rings").alias("ring"))
    closed = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.array(F.element_at("ring", 1))))
    sides = F.transform(F.sequence(F.lit(1), F.size("closed") - 1), lambda i: F.struct(F.element_at("closed", i).alias("a"), F.element_at("closed", i + 1).alias("b")))
    return rings.withColumn("closed", closed).select("psap_id", "part", F.explode(sides).alias("e")).select("psap_id", "part", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
