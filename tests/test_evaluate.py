import datetime as dt

import pytest
from pyspark.sql import functions as F

from routelens.operators import assoc, evaluate, grain, rca

HOUR = dt.datetime(2026, 1, 1, 6)


def test_truth_falls_back_to_the_largest_score(spark):
    truth = spark.createDataFrame([("a", 1, HOUR), ("b", 2, HOUR), ("c", 3, HOUR)], "event_id string, psap_id long, hour_start_utc timestamp")
    scores = spark.createDataFrame([("a", 1, HOUR, 0.5), (None, 1, HOUR, 9.0), (None, 2, HOUR, 1.5), (None, 2, HOUR, 0.1)], "event_id string, psap_id long, hour_start_utc timestamp, ratio double")
    got = {r.event_id: r.ratio for r in evaluate.truth_scores(truth, scores).collect()}
    assert got == {"a": 0.5, "b": 1.5, "c": None}


def test_pairs_without_any_score_never_alert(spark):
    truth = spark.createDataFrame([("a", 1, HOUR)], "event_id string, psap_id long, hour_start_utc timestamp")
    none = spark.createDataFrame([], "event_id string, psap_id long, hour_start_utc timestamp, ratio double")
    r = evaluate.paired(truth, none, none).first()
    assert (r.lift, r.new_alert, r.lost_alert, r.baseline_alert) == (None, False, False, False)


def test_minimum_severity_needs_every_higher_level(spark):
    rows = [("p", 0.1, True), ("p", 0.25, False), ("p", 0.5, True), ("q", 0.1, True), ("q", 0.5, True), ("r", 0.5, False)]
    events = spark.createDataFrame(rows, "pattern string, severity double, detected boolean")
    got = {r.pattern: r.minimum_severity for r in evaluate.minimum_severity(events, ["pattern"], 0.9).collect()}
    assert got == {"p": 0.5, "q": 0.1, "r": None}


def test_attributable_recall_leaves_out_contaminated_events(spark):
    events = spark.createDataFrame([("p", True, True), ("p", True, False), ("p", False, False), ("q", True, True)], "pattern string, detected boolean, contaminated boolean")
    got = {r.pattern: (r.clean_events, r.recall) for r in evaluate.attributable_recall(events, ["pattern"]).collect()}
    assert got == {"p": (2, 0.5), "q": (0, None)}


def test_score_integrity_counts_each_fault(spark):
    rows = [(float("nan"), 1.0, False, True), (None, 1.0, False, True), (2.0, 0.0, False, True), (2.0, 1.0, False, False), (2.0, 1.0, True, True), (1.0, 1.0, False, True)]
    r = evaluate.score_integrity(spark.createDataFrame(rows, "score double, threshold double, alert boolean, eligible boolean")).first()
    assert (r.n, r.non_finite, r.bad_threshold, r.alert_mismatch, r.suppression_rate) == (6, 2, 1, 1, 0.5)


def test_mapping_changes_and_conflicts(spark):
    schema = "psap_id long, hour_start_utc timestamp, cluster long, head_id long"
    later = HOUR + dt.timedelta(hours=1)
    a = spark.createDataFrame([(1, HOUR, 1, 1), (1, later, 2, 1), (2, HOUR, 1, 1)], schema)
    b = spark.createDataFrame([(1, HOUR, 2, 5), (3, HOUR, 1, 1)], schema)
    r = evaluate.mapping_stability(a, b).first()
    assert (r.common, r.gone, r.added, r.cluster_change, r.head_change) == (1, 1, 1, 0.0, 1.0)
    assert [(c.psap_id, c.clusters) for c in evaluate.mapping_conflicts(a.where("psap_id = 1"), b).collect()] == [(1, 2)]


def test_trusted_rows_are_mature_and_last(spark):
    day = lambda n: dt.datetime(2026, 1, n)
    rows = spark.createDataFrame([(1, day(1), "a"), (1, day(3), "b"), (1, day(20), "c"), (2, day(19), "d")], "id long, at timestamp, label string")
    got = evaluate.trusted(rows, "id", "at", F.lit(day(20))).collect()
    assert [(r.id, r.label) for r in got] == [(1, "b")]


def test_complete_grain_drops_conflicts_and_prefers_full_rows(spark):
    rows = spark.createDataFrame([(1, 1, None, "x"), (1, 2, 5, "x"), (2, 1, 5, "x"), (2, 2, 5, "y"), (3, 1, None, None)], "k long, n long, v long, s string")
    got = {r.k: (r.n, r.completeness) for r in grain.complete_grain(rows, "k", ["v"], ["s"], [F.col("n")]).collect()}
    assert got == {1: (2, 1), 3: (1, 0)}


def test_key_coverage_takes_keys_that_occur_once(spark):
    left = spark.createDataFrame([(1,), (2,), (None,), (9,)], "a long")
    right = spark.createDataFrame([(1, 1), (2, 1), (2, None)], "x long, y long")
    got = {r.right_key: (r.coverage, r.accepted) for r in grain.key_coverage(left, right, [("a", "x"), ("a", "y")], 0.25).collect()}
    assert got == {"x": (0.25, True), "y": (0.0, False)}


def test_strong_pairs_name_how_many_more_ids(spark):
    rows = spark.createDataFrame([(1, 2, 1, f"m{i:02d}", HOUR, 5.0, 1.0) for i in range(17)], "routed long, expected long, label long, m string, call_time timestamp, d_routed double, uncert double")
    r = rca.strong_pairs(rows, [], "m").first()
    assert r.calls == 17 and r.min_clearance == 4.0 and r.m_ids.endswith("m14 | +2 more")


def test_information_of_a_copy_and_of_a_constant(spark):
    rows = [("copy", str(i % 2), i % 2) for i in range(10)] + [("flat", None, i % 2) for i in range(10)]
    got = {r.feature: r for r in assoc.mutual_information(spark.createDataFrame(rows, "feature string, value string, target long")).collect()}
    assert got["copy"].nmi == pytest.approx(1.0) and got["flat"].mi == pytest.approx(0.0)


def test_terms_of_many_documents_and_of_all(spark):
    """Products of counts beyond 64 bits, and a term without variance, whose chi-square SQL has as NaN."""
    docs = spark.range(20_000).select((F.col("id") % 2).alias("target"), F.when(F.col("id") % 2 == 1, "all mark").otherwise("all").alias("text"))
    got = {r.term: (r.case_docs, r.df, r.chi2) for r in assoc.terms(docs, "text").collect()}
    assert got["mark"] == (10_000, 10_000, 20_000.0) and got["all"][:2] == (10_000, 20_000) and got["all"][2] != got["all"][2]


@pytest.mark.parametrize("cases, want", [(5, (2, 6)), (0, (0, 0))])
def test_sample_is_capped_weighted_and_repeatable(spark, cases, want):
    rows = spark.createDataFrame([(i, 1 if i < cases else 0) for i in range(50)], "key long, target long")
    got = assoc.case_control_sample(rows, "key", most_cases=2).collect()
    assert (sum(r.target == 1 for r in got), sum(r.target == 0 for r in got)) == want
    assert sorted(got) == sorted(assoc.case_control_sample(rows.repartition(5), "key", most_cases=2).collect())
    assert all(r.weight == (2.5 if r.target else 7.5) for r in got)
