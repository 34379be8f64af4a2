"""Grades, thresholds, ranks by parts and large disks on small fixtures."""

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from routelens.operators import assoc, edge_index, geo, kpi, report, screen
from routelens.sources import contracts


def test_health_grades_and_missing_metrics(spark):
    rows = [("event_recall", 0.9), ("event_precision", 0.7), ("median_delay_hours", 5.0), ("invalid_rows", 0.0), ("median_ratio_lift", None)]
    got = {r.check: r for r in report.model_health(spark.createDataFrame(rows, "metric string, value double")).collect()}
    assert len(got) == 18
    assert [got[c].status for c in ("synthetic_event_detection", "time_to_detection", "score_threshold_integrity", "score_lift", "reference_drift")] == ["WARN", "FAIL", "PASS", "UNKNOWN", "UNKNOWN"]
    assert {r.overall for r in got.values()} == {"FAIL"}


def test_classifier_is_critical_with_three_failed_sections(spark):
    rows = [("ticket_count", 10.0), ("missing_text_rate_pct", 5.0), ("average_prediction_confidence", 0.4), ("token_distribution_jsd", 0.3)]
    got = report.classifier_health(spark.createDataFrame(rows, "metric string, value double")).collect()
    assert {(r.overall, r.collection_status) for r in got} == {("CRITICAL", "PARTIAL")}
    assert {r.metric: r.status for r in got if r.value is not None}["ticket_count"] == "WARN"


@pytest.mark.parametrize("parts", [2, 64])
def test_sums_below_do_not_depend_on_parts(spark, parts):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"), (F.col("id") % 7).alias("n"))
    for r in assoc.below(rows, ["g"], "x", "n", parts=parts).collect():
        assert r.below == sum(i % 7 for i in range(r.x) if i % 3 == r.g)


def test_threshold_of_enough_precision_or_best_f1(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.1, 0)], "score double, target int")
    assert screen.operating_threshold(rows, 0.9) == 0.8
    assert screen.operating_threshold(rows.where("target = 0 OR score = 0.6"), 0.9) == 0.6
    top = report.top_shares(rows, (0.4,)).first()
    assert (top.rows, top.precision, top.recall) == (2, 1.0, pytest.approx(2 / 3))


def test_features_without_columns_that_weigh_zero(spark):
    rows = [(1, 1.0, float(k), "ab"[k % 2], f"note {k % 3} seldom{k}", "") for k in range(8)]
    train = screen.filled(spark.createDataFrame(rows, "target int, weight double, x double, c string, note string, blank string"), ["x"], ["c"], ["note", "blank"])
    prepared = Pipeline(stages=screen.preparation(["x"], ["c"], ["note", "blank"], 64)).fit(train)
    new = train.where("x < 3").withColumn("note", F.concat_ws(" ", "note", F.lit("never seen before")))
    for df in (train, new):
        full, less = ([r.features for r in m.transform(df).orderBy("x").select("features").collect()] for m in (prepared, screen.without_zeros(prepared)))
        assert len(less[0]) < len(full[0]) // 4
        assert [[v for v in f.toArray() if v] for f in full] == [[v for v in f.toArray() if v] for f in less]


def test_disk_of_any_size_meets_each_polygon_once(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    edges = [(1, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1])] + [(2, a[0] + 5, a[1], b[0] + 5, b[1]) for a, b in zip(ring, ring[1:] + ring[:1])]
    edges = spark.createDataFrame(edges, "psap_id long, x1 double, y1 double, x2 double, y2 double")
    calls = spark.createDataFrame([(1, 0.5, 0.5, 1.0, 9), (2, 3.0, 0.5, 300_000.0, None), (3, 0.5, 0.5, 30_000_000.0, 1)], "call_id long, lon double, lat double, uncert double, routed long")
    got = sorted((r.call_id, r.psap_id) for r in geo.measure(calls, edge_index.build(edges)).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2)]


def test_parts_of_a_boundary(spark):
    square = lambda psap, part, x: [(psap, part, *a, *b) for a, b in zip(*(lambda r: (r, r[1:] + r[:1]))([(x, 0.0), (x + 2, 0.0), (x + 2, 2.0), (x, 2.0)]))]
    edges = spark.createDataFrame(square(1, 1, 0.0) + square(1, 2, 1.0), "psap_id long, part long, x1 double, y1 double, x2 double, y2 double")
    calls = spark.createDataFrame([(1, 1.5, 1.0, 1.0, 1), (2, 9.0, 1.0, 1.0, 1)], "call_id long, lon double, lat double, uncert double, routed long")
    assert {r.call_id: r.inside for r in geo.measure(calls, edge_index.build(edges)).collect()} == {1: True, 2: False}


def test_replay_refuses_rows_before_the_cutoff(spark):
    truth = spark.createDataFrame([("c", "volume_spike", 1, 5.0, 9.0)], "cell_id string, pattern string, psap_id long, call_volume double, injected_call_volume double").withColumn("hour_start_utc", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    thresholds = spark.createDataFrame([(1, 6.0)], "psap_id long, threshold double")
    with pytest.raises(ValueError):
        kpi.replay(truth, thresholds, "2024-01-01 00:00:00")
    r = kpi.replay(truth, thresholds, "2023-01-01 00:00:00").first()
    assert (r.cells, r.detected, r.contaminated, r.recall, r.median_lift) == (1, 1, 0, 1.0, pytest.approx(4 / 6))


def test_no_time_column_is_an_error(spark):
    with pytest.raises(ValueError):
        contracts.best_time_column(spark.createDataFrame([("x",)], "a string"), ["a", "b"])
