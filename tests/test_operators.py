import datetime as dt

from pyspark.sql import functions as F

from routelens.functions import normalize as N
from routelens.operators import geo, grain, kpi
from routelens.sources import tables
from routelens.streaming import kpi as stream


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


def test_ids(spark):
    cases = {" 12.0 ": "12", '"abc"': '"ABC"', "007": "7", "-5.00": "-5", "NaN": None, "": None, None: None, "+3": "3", "A.0": "A.0"}
    for raw, want in cases.items():
        assert one(spark, raw, N.normalize_id) == want, raw


def test_issue_words(spark):
    cases = {"401": True, "404": True, "E-CSCF 404": False, "4012": False, "TIMEOUT": True, "UNKNOWN": False, "200 OK": False, None: None}
    for raw, want in cases.items():
        assert one(spark, raw, N.issue_flag) == want, raw


def test_times(spark):
    assert one(spark, "01-Jul-26 13:02:03 UTC", N.parse_utc) == dt.datetime(2026, 7, 1, 13, 2, 3)
    assert one(spark, "2026-07-01T13:02:03+00:00", N.parse_utc) == dt.datetime(2026, 7, 1, 13, 2, 3)
    assert one(spark, "rubbish", N.parse_utc) is None


def square(psap, x, y):
    ring = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
    return [(psap, *map(float, a), *map(float, b)) for a, b in zip(ring, ring[1:] + ring[:1])]


def test_labels(spark):
    edges = spark.createDataFrame(square(1, 0, 0) + square(2, 1, 0), "psap_id long, x1 double, y1 double, x2 double, y2 double")
    calls = [(1, 0.5, 0.5, 100.0, 1), (2, 0.5, 0.5, 100.0, 2), (3, 0.9999, 0.5, 1000.0, 1), (4, 0.5, 95.0, 1.0, 1), (5, None, 0.5, 1.0, 1), (6, 0.5, 0.5, 0.0, 1), (7, 0.5, 0.5, 5.0, 9), (8, 9.0, 9.0, 5.0, 1)]
    got = geo.label_routes(spark.createDataFrame(calls, "call_id long, lon double, lat double, uncert double, routed long"), edges)
    status = {r.call_id: (r.status, r.expected, r.label) for r in got.collect()}
    assert status[1] == ("DEFINITE_CORRECT", 1, 0)
    assert status[2] == ("DEFINITE_MISROUTE", 1, 1)
    assert status[3][0] == "BOUNDARY_AMBIGUOUS"
    assert [status[i][0] for i in (4, 5, 6, 7, 8)] == ["INVALID_LOCATION", "MISSING_LOCATION", "INVALID_UNCERTAINTY", "MISSING_ROUTED_BOUNDARY", "NO_CONTAINING_PSAP"]


def test_episodes_split_above_the_gap(spark):
    t = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    rows = spark.createDataFrame([(1, t(h)) for h in (0, 1, 2.5, 4.5)], "psap_id long, hour_start_utc timestamp")
    got = kpi.episodes(rows).orderBy("episode").collect()
    assert [r.alert_hours for r in got] == [3, 1]


def test_streaming_episodes_equal_batch(spark, tmp_path):
    t = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    rows = spark.createDataFrame([(1, t(h)) for h in (0, 1, 2.5, 4.5)] + [(2, t(0)), (9, t(500))], "psap_id long, ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream.episodes(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("episodes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.psap_id, r.alert_hours) for r in spark.table("episodes").collect()}
    assert {(1, 3), (1, 1), (2, 1)} <= got


def test_chunks_round_trip(spark):
    df = spark.createDataFrame([(1, "x" * 9001), (2, "")], "id long, text string")
    back = tables.join_chunks(tables.split_chunks(df, "id", "text"), "id")
    assert {(r.id, len(r.text)) for r in back.collect()} == {(1, 9001), (2, 0)}


def test_detector_failure_becomes_a_status(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2026, 1, 1), 1.0), (2, dt.datetime(2026, 1, 1), 2.0)], "head long, hour_start_utc timestamp, x double")

    def detector(pdf):
        if pdf["head"].iloc[0] == 2:
            raise ValueError("no")
        return pdf["x"], 1.0

    got = kpi.score_with(rows, "head", detector, "head long, hour_start_utc timestamp, x double, raw_score double, raw_threshold double, head_status string")
    assert {(r["head"], r.head_status) for r in got.collect()} == {(1, "SCORED"), (2, "SCORING_ERROR: ValueError")}


def test_grain_conflict(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("b", 2, None)], "k string, n int, v string")
    got = {r.k: (r.n_rows, r.conflict, r.n) for r in grain.call_grain(rows, "k", ["v"], [F.col("n")]).collect()}
    assert got == {"a": (2, False, 1), "b": (2, True, 1)}
