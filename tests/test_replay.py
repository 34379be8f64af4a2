"""Replay of a detector in stages: pairs, resuming, the chronology guard and failing detectors."""

import datetime as dt

import pytest

from routelens.operators import replay

START = dt.datetime(2024, 1, 1)
HOURLY = "psap_id long, hour_start_utc timestamp_ntz, call_volume double, lsr_sr double, asr_sr double, bid_sr double, csr_sr double"


def hourly(spark, extra=()):
    return spark.createDataFrame([(p, START + dt.timedelta(hours=h), 10.0 + p, 99.0, 98.0, 97.0, 96.0) for p in (1, 2, 3) for h in range(12)] + list(extra), HOURLY)


def cells(spark, rows=None):
    rows = [(f"c{p}{k}", "low", p, k, 0.5, 3) for p in (1, 2, 3) for k in ("volume_spike", "volume_drop")] if rows is None else rows
    return spark.createDataFrame(rows, "cell_id string, stratum string, psap_id long, pattern string, severity double, duration int")


def heads(spark):
    return spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "member_psap_id long, cluster_head_psap_id long, cluster_head_rank int")


def models(spark):
    return spark.createDataFrame([(1, 10.0), (2, 20.0)], "head_id long, volume_limit double")


def by_volume():
    def detector(rows):  # within a function, as workers can't import this module
        return rows["call_volume"], rows["volume_limit"]

    return detector


def run(spark, folder, detector=None, **more):
    a = {"hourly": hourly(spark), "cells": cells(spark), "cutoff": "2023-12-31 00:00:00"} | more
    return replay.replay_evaluation(a["hourly"], a["cells"], heads(spark), models(spark), detector or by_volume(), a["cutoff"], 1, folder)


def test_pairs_and_resuming(spark, tmp_path):
    out = run(spark, str(tmp_path))
    assert list(out) == ["truth", "rows", "heads", "scored", "pairs"]
    got = {(r.psap_id, r.pattern, r.baseline_score and round(r.baseline_score, 4), r.injected_score and round(r.injected_score, 4), r.baseline_status) for r in out["pairs"].collect()}
    # 1 is scored by heads 1 and 2, 2 is its own head, 3 has no detector: 11 calls become 17 or 5, 12 become 18 or 6
    assert got == {
        (1, "volume_spike", 0.825, 1.275, "SCORED"), (1, "volume_drop", 0.825, 0.375, "SCORED"), (2, "volume_spike", 0.6, 0.9, "SCORED"),
        (2, "volume_drop", 0.6, 0.3, "SCORED"), (3, "volume_spike", None, None, "SKIPPED_NO_DETECTOR"), (3, "volume_drop", None, None, "SKIPPED_NO_DETECTOR"),
    }
    e = {r.pattern: r for r in replay.evidence(out["pairs"]).collect()}
    assert (e["volume_spike"].events, e["volume_spike"].rows, e["volume_spike"].unscored, e["volume_spike"].detected, e["volume_spike"].new_alerts, e["volume_spike"].contaminated) == (3, 9, 3, 1, 3, 0)
    assert e["volume_drop"].recall == 0

    def broken(_):
        raise AssertionError("a finished stage is not run again")

    again = run(spark, str(tmp_path), broken)
    assert again["heads"].where("head_status LIKE 'SCORING_ERROR%'").count() == 0
    assert sorted(map(str, again["pairs"].collect())) == sorted(map(str, out["pairs"].collect()))


def test_hours_before_the_cutoff_fail_the_job(spark, tmp_path):
    with pytest.raises(Exception, match="chronological leakage"):
        run(spark, str(tmp_path / "a"), cutoff="2024-01-01 05:00:00")
    with pytest.raises(Exception, match="hour NULL is not after"):
        run(spark, str(tmp_path / "b"), hourly=hourly(spark, [(2, None, 1.0, 99.0, 99.0, 99.0, 99.0)]))


def test_failing_detectors_empty_campaigns_and_bad_rows(spark, tmp_path):
    score = by_volume()

    def picky(rows):
        if rows["volume_limit"].iloc[0] == 20:
            raise KeyError("weights")
        return score(rows)

    bad = [(2, START + dt.timedelta(days=9), -1.0, 99.0, 99.0, 99.0, 99.0), (2, START + dt.timedelta(days=9, hours=1), 5.0, None, 99.0, 99.0, 99.0)]
    out = run(spark, str(tmp_path / "a"), picky, hourly=hourly(spark, bad), cells=cells(spark, []))
    assert out["pairs"].count() == 0 and replay.evidence(out["pairs"]).count() == 0
    assert {(r.head_id, r.head_status) for r in out["heads"].collect()} == {(1, "SCORED"), (2, "SCORING_ERROR: KeyError: 'weights'"), (2, "INVALID_INPUT"), (3, "NO_DETECTOR")}
    status = {(r.psap_id, r.scoring_status, r.gate) for r in out["scored"].collect()}
    assert status == {(1, "SCORED_PARTIAL_HEADS", "OK"), (2, "SCORING_ERROR", "NON_FINITE"), (2, "SKIPPED_INVALID_INPUT", "NON_FINITE"), (3, "SKIPPED_NO_DETECTOR", "NON_FINITE")}
    empty = run(spark, str(tmp_path / "b"), hourly=hourly(spark).limit(0))
    assert all(df.count() == 0 for df in empty.values())
