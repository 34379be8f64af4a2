"""Delimited files with their own headers, and roles of features by name."""

import pytest
from pyspark.sql import functions as F

from routelens.sources import contracts, tables


def test_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text('SQL> x\n"open quote\nCall ID,Name,name\n1,"a, ""b""\nc",dup\n,,\n2,,\n1,"a, ""b""\nc",dup\n')
    (tmp_path / "2.csv").write_text("﻿NAME,extra,CALL_ID,zone\nx,0,3,z1\nshort\n", encoding="utf-8")
    got = sorted(map(str, (tuple(r) for r in tables.read_delimited(spark, str(tmp_path), ["call_id", "name", "zone"]).collect())))
    assert got == sorted(map(str, [("1", 'a, "b"\nc', None), ("1", 'a, "b"\nc', None), ("2", None, None), ("3", "x", "z1"), (None, "short", None)]))
    (tmp_path / "3.csv").write_text("no header\n1,2\n")
    with pytest.raises(Exception, match="no header line"):
        tables.read_delimited(spark, str(tmp_path), ["call_id", "name"]).collect()


def test_roles(spark):
    want = {"GMLC_LATITUDE": "LABEL_OR_GEOMETRY_LEAKAGE", "GMLC_LSR_CTID": "TECHNICAL_JOIN_KEY", "X_MISROUTE": "LABEL_OR_GEOMETRY_LEAKAGE", "CALL_DATE": "RAW_TIME_KEY", "DR_CNT": "POST_ROUTING_CONSEQUENCE", "CELL": "PREDICTOR_CANDIDATE", None: None, "": "PREDICTOR_CANDIDATE"}
    got = spark.createDataFrame([(k,) for k in want], "name string").select("name", contracts.role(F.col("name")).alias("role")).collect()
    assert {r.name: r.role for r in got} == want


def test_profile_reads_rows(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (2, None)], "a long, b string")
    got = {r.column: tuple(r)[1:] for r in contracts.column_profile(df, ["a", "c"]).collect()}
    assert got == {"a": (True, True, 3, 2), "b": (True, False, 1, 1), "c": (False, True, 0, 0)}
    empty = {r.column: (r.filled, r.distinct_values) for r in contracts.column_profile(df.where("a < 0"), []).collect()}
    assert empty == {"a": (0, 0), "b": (0, 0)}
