"""Two-stage enrichment: reasons, odd rows, and a run that resumes."""

from routelens.operators import enrich

CALLS = [(1, "a"), (2, "b"), (2, "b"), (3, "c"), (None, "d")]
#: call, icid, line, number, category
EXACT = [(1, "k1", "m1", 5.0, "x"), (1, "k1", None, 7.0, "y"), (1, "k9", "m1", None, "y"), (2, "k2", "m2", 1.0, None), (2, "k9", None, 2.0, None), (7, "k7", "m7", 9.0, "x"), (None, "k8", "m8", 9.0, "x")]
#: event, icid, line, number, category
EVENTS = [("e1", "k1", None, 1.0, "p"), ("e2", "k1", "m1", 2.0, "q"), ("e3", "k1", "m2", 4.0, "q"), ("e4", "k9", None, 8.0, "q"), ("e5", None, None, 16.0, "q"), ("e6", "k7", "m8", 32.0, "q"), ("e7", "k9", "m2", 64.0, None)]


def run(spark, folder, calls=CALLS, exact=EXACT, events=EVENTS):
    c = spark.createDataFrame(calls, "call_id long, cell string")
    x = spark.createDataFrame(exact, "call long, icid string, line string, n double, c string")
    e = spark.createDataFrame(events, "event string, icid string, line string, n double, c string")
    keys = {"ICID": "icid", "LINE": "line"}
    return enrich.two_stage(c, "call_id", enrich.Source(x, "call", keys, "n", "c"), enrich.Source(e, "event", keys, "n", "c"), folder)


def test_reasons_quarantine_and_figures(spark, tmp_path):
    t = run(spark, f"file://{tmp_path}/run")
    assert {r["__event"]: (r.reason, r["__call"]) for r in t["events"].collect()} == {
        "e1": ("MATCHED", 1), "e2": ("MATCHED", 1), "e3": ("CALLS_DISAGREE", None), "e4": ("QUARANTINED_KEYS", None), "e5": ("NO_KEY", None), "e6": ("NO_BRIDGE", None), "e7": ("MATCHED", 2)
    }
    assert [tuple(r) for r in t["quarantine"].collect()] == [("ICID", "k9", 2)]
    got = sorted(map(str, ((r.call_id, r.exact_rows, r.exact_sum, r.exact_mode, r.bridged_rows, r.bridged_sum, r.bridged_mode) for r in t["enriched"].collect())))
    assert got == sorted(map(str, [(1, 3, 12.0, "y", 2, 3.0, "p"), (2, 2, 3.0, "<MISSING>", 1, 64.0, "<MISSING>"), (2, 2, 3.0, "<MISSING>", 1, 64.0, "<MISSING>"), (3, *[None] * 6), (None, *[None] * 6)]))
    d = {r.stage: r for r in t["diagnostics"].collect()}
    assert (d["EXACT"].source_rows, d["EXACT"].eligible_rows, d["EXACT"].matched_rows, d["EXACT"].calls, d["EXACT"].no_key, d["EXACT"].no_bridge) == (7, 6, 5, 2, 1, 1)
    assert (d["BRIDGED"].source_rows, d["BRIDGED"].matched_rows, d["BRIDGED"].calls, d["BRIDGED"].coverage) == (7, 3, 2, 0.5)
    assert (d["BRIDGED"].no_key, d["BRIDGED"].no_bridge, d["BRIDGED"].quarantined_keys, d["BRIDGED"].calls_disagree) == (1, 1, 1, 1)


def test_a_run_resumes_by_stage(spark, tmp_path):
    run(spark, f"file://{tmp_path}/run")
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "run").iterdir()}
    (tmp_path / "run" / "enriched" / "_SUCCESS").unlink()
    assert run(spark, f"file://{tmp_path}/run")["enriched"].count() == len(CALLS)
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "run").iterdir()}
    assert {k for k in after if after[k] != before[k]} == {"enriched"}


def test_empty_tables(spark, tmp_path):
    t = run(spark, f"file://{tmp_path}/sources", exact=[], events=[])
    assert t["enriched"].count() == len(CALLS) and t["quarantine"].count() == 0
    assert {(r.stage, r.source_rows, r.coverage) for r in t["diagnostics"].collect()} == {("EXACT", 0, None), ("BRIDGED", 0, None)}
    assert run(spark, f"file://{tmp_path}/calls", calls=[])["enriched"].count() == 0
