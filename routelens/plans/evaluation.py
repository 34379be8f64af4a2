"""Queries over replay evaluation, bound to hourly KPIs with a known event of three hours for each entity and day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import evaluate as E
from ..operators import health, kpi, replay, report
from ..sources.files import scratch
from ..sources.tables import table
from . import monitoring as M
from .common import tidy

SIGN = {"volume_drop": -1.0, "volume_spike": 4.0, "rate_drop": 1.0}


def truth(spark, d):
    day = F.date_trunc("day", "event_start").cast("timestamp_ntz")
    ev = M.events_of(spark, d).withColumn("pattern", F.element_at(F.array(*map(F.lit, SIGN)), (F.col("psap_id") % 3 + 1).cast("int")))
    ev = ev.withColumn("severity", F.element_at(F.array(F.lit(0.10), F.lit(0.25), F.lit(0.50)), F.dayofmonth("event_start") % 3 + 1)).withColumn("stratum", F.when(F.col("psap_id") < 6, "low").otherwise("high"))
    return ev.select("event_id", "psap_id", "pattern", "severity", "stratum", F.explode(F.sequence("event_start", "event_end", F.expr("INTERVAL 1 HOUR"))).alias("hour_start_utc"), day.alias("day")).drop("day")


def untouched(spark, d):
    return M.scored(spark, d).select("psap_id", "hour_start_utc", (F.col("call_volume") / F.col("threshold")).alias("ratio"))


def injected(spark, d):
    """Scores of injected rows; those of entities 3, 7 and 11 have lost their event and come twice."""
    sign = F.when(F.col("pattern") == "volume_drop", -1.0).when(F.col("pattern") == "volume_spike", 4.0).otherwise(1.0)
    j = truth(spark, d).join(untouched(spark, d), E.KEY).withColumn("ratio", F.col("ratio") * (1 + F.col("severity") * sign))
    copies = F.explode(F.when(F.col("psap_id") % 4 == 3, F.array(F.lit(1.0), F.lit(0.5))).otherwise(F.array(F.lit(1.0)))).alias("f")
    return j.select("*", copies).select(F.when(F.col("psap_id") % 4 != 3, F.col("event_id")).alias("event_id"), "psap_id", "hour_start_utc", (F.col("ratio") * F.col("f")).alias("ratio"))


def pairs(spark, d):
    return E.paired(truth(spark, d), untouched(spark, d), injected(spark, d))


def outcomes(spark, d):
    return E.event_outcomes(pairs(spark, d), ["pattern", "severity", "stratum"])


def heads(spark, d):
    """Three heads per row; head 7 has no score for rows of two calls."""
    s = M.scored(spark, d)
    fan = s.select("psap_id", "hour_start_utc", "call_volume", F.posexplode(F.array(F.col("psap_id"), (F.col("psap_id") + 1) % 12, (F.col("psap_id") + 5) % 12)).alias("head_rank", "head_id"))
    t = s.select(F.col("psap_id").alias("head_id"), "threshold").distinct()  # one row per entity
    fan = fan.join(t, "head_id").withColumn("ratio", F.when((F.col("head_id") != 7) | (F.col("call_volume") != 2), F.col("call_volume") / F.col("threshold")))
    return fan.withColumn("sanity", (F.col("call_volume") >= 3).cast("int")).withColumn("status", F.when(F.col("ratio").isNotNull(), F.concat(F.lit("HEAD_"), F.col("head_id").cast("string"))))


TR = M.S + """, ev AS (SELECT DISTINCT psap_id || '-' || strftime(hour_start_utc, '%Y%m%d') AS event_id, psap_id, date_trunc('day', hour_start_utc)::TIMESTAMP AS d FROM h),
  tr AS (SELECT event_id, psap_id, CASE psap_id % 3 WHEN 0 THEN 'volume_drop' WHEN 1 THEN 'volume_spike' ELSE 'rate_drop' END AS pattern, CASE day(d) % 3 WHEN 0 THEN 0.10::DOUBLE WHEN 1 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS severity,
    CASE WHEN psap_id < 6 THEN 'low' ELSE 'high' END AS stratum, d + to_hours(o) AS hour_start_utc FROM ev, (SELECT unnest([6, 7, 8]) AS o)),
  u AS (SELECT psap_id, hour_start_utc, call_volume / threshold AS ratio FROM s),
  j AS (SELECT tr.*, ratio * (1 + severity * CASE pattern WHEN 'volume_drop' THEN -1.0::DOUBLE WHEN 'volume_spike' THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END) AS ratio FROM tr JOIN u USING (psap_id, hour_start_utc)),
  inj AS (SELECT CASE WHEN psap_id % 4 <> 3 THEN event_id END AS event_id, psap_id, hour_start_utc, ratio FROM j UNION ALL SELECT NULL, psap_id, hour_start_utc, ratio * 0.5 FROM j WHERE psap_id % 4 = 3),
  p0 AS (SELECT tr.*, u.ratio AS baseline_ratio, coalesce((SELECT max(ratio) FROM inj WHERE inj.event_id = tr.event_id AND inj.psap_id = tr.psap_id AND inj.hour_start_utc = tr.hour_start_utc), (SELECT max(ratio) FROM inj WHERE inj.psap_id = tr.psap_id AND inj.hour_start_utc = tr.hour_start_utc)) AS injected_ratio
    FROM tr LEFT JOIN u USING (psap_id, hour_start_utc)),
  pr AS (SELECT *, injected_ratio - baseline_ratio AS lift, coalesce(baseline_ratio > 1, false) AS was, coalesce(injected_ratio > 1, false) AS now_ FROM p0),
  oc AS (SELECT event_id, pattern, severity, stratum, count(*) AS affected, count(*) FILTER (now_) AS alerted, count(*) FILTER (now_) > 0 AS detected, count(*) FILTER (was) AS untouched_alerts, count(*) FILTER (was) > 0 AS contaminated FROM pr GROUP BY 1, 2, 3, 4)"""
HD = M.S + """, hd AS (SELECT a.psap_id, hour_start_utc, call_volume, r AS head_rank, t.psap_id AS head_id, CASE WHEN t.psap_id <> 7 OR call_volume <> 2 THEN call_volume / t.threshold END AS ratio, CASE WHEN call_volume >= 3 THEN 1 ELSE 0 END AS sanity
  FROM (SELECT psap_id, hour_start_utc, call_volume, r, CASE r WHEN 0 THEN psap_id WHEN 1 THEN (psap_id + 1) % 12 ELSE (psap_id + 5) % 12 END AS hid FROM h, (SELECT unnest([0, 1, 2]) AS r)) a JOIN t ON t.psap_id = hid)"""
SHARE = "avg(CASE WHEN {} THEN 1.0::DOUBLE ELSE 0 END)"


def sh(cond: str, name: str) -> str:
    return f"round({SHARE.format(cond)}, 6) AS {name}"


def j24_paired_rows(spark, d):
    return tidy(pairs(spark, d))


def j16_truth_scores(spark, d):
    return tidy(E.truth_scores(truth(spark, d), injected(spark, d)).select("event_id", "hour_start_utc", "ratio"))


def j14_injected_truth(spark, d):
    return tidy(injected(spark, d).join(truth(spark, d).select("psap_id", "hour_start_utc", "pattern"), E.KEY))


def j18_contamination(spark, d):
    return tidy(outcomes(spark, d).select("event_id", "untouched_alerts", "contaminated"))


def a31_logical_rows(spark, d):
    return tidy(E.logical_rows(heads(spark, d), E.KEY))


def a32_scoring_metadata(spark, d):
    planned = truth(spark, d).select("pattern", *E.KEY)
    scores = untouched(spark, d).withColumn("status", F.when(F.col("psap_id") == 5, "SCORING_ERROR").otherwise("SCORED"))
    return tidy(E.scoring_metadata(scores, planned, ["pattern"]))


def a35_recall_sets(spark, d):
    return tidy(E.recall_sets(outcomes(spark, d), [["pattern"], ["severity"], ["stratum"], ["pattern", "severity", "stratum"], []]))


def a53_blind_spot(spark, d):
    return tidy(E.recall_sets(outcomes(spark, d).where("pattern = 'volume_drop'"), [["severity"], []]))


def a36_detection_delay(spark, d):
    m = health.match_episodes(kpi.episodes(M.scored(spark, d).where("alert")), M.events_of(spark, d), 1.0)
    return tidy(E.detection_delay(m, ["psap_id"]))


def a37_score_lift(spark, d):
    return tidy(E.score_lift(pairs(spark, d), ["pattern"]))


def a38_temporal_coverage(spark, d):
    return tidy(E.temporal_coverage(outcomes(spark, d), ["pattern"]))


def a39_attributable_recall(spark, d):
    return tidy(E.attributable_recall(outcomes(spark, d), ["pattern"]))


def a40_benign_controls(spark, d):
    return tidy(E.benign(pairs(spark, d).where("pattern = 'volume_drop'"), ["stratum"]))


def a41_minimum_severity(spark, d):
    return tidy(E.minimum_severity(outcomes(spark, d), ["pattern", "stratum"], 0.5))


def a42_coverage(spark, d):
    return tidy(E.scoring_metadata(untouched(spark, d).withColumn("status", F.lit("SCORED")), truth(spark, d).select("stratum", *E.KEY), ["stratum"]))


def a43_components(spark, d):
    return tidy(E.component_availability(heads(spark, d)))


def a44_head_agreement(spark, d):
    return tidy(E.head_agreement(heads(spark, d)))


def a45_score_integrity(spark, d):
    s = M.scored(spark, d).withColumn("score", F.when(F.col("psap_id") == 2, float("nan")).otherwise(F.col("call_volume"))).withColumn("eligible", kpi.tier_gate())
    return tidy(E.score_integrity(s.withColumn("threshold", F.when(F.col("psap_id") == 4, 0.0).otherwise(F.col("threshold")))))


def _mapping(spark, d):
    h = M.hourly(spark, d)
    return h.select("psap_id", "hour_start_utc", (F.col("call_volume").cast("long") % 3).alias("cluster"), ((F.col("psap_id") + F.dayofmonth("hour_start_utc") % 2) % 12).alias("head_id"))


def t27_mapping_stability(spark, d):
    m = _mapping(spark, d)
    first = F.dayofmonth("hour_start_utc") <= 15
    return tidy(E.mapping_stability(m.where(first & (F.col("psap_id") != 1)), m.where(~first & (F.col("psap_id") != 2))))


def j19_latest_mapping(spark, d):
    return tidy(E.latest_mapping(_mapping(spark, d)))


def j23_mapping_conflicts(spark, d):
    h = M.hourly(spark, d).groupBy("psap_id").agg(F.max("call_volume").cast("long").alias("v"))
    return tidy(E.mapping_conflicts(h.select("psap_id", (F.col("v") % 2).alias("cluster")), h.select("psap_id", (F.col("v") % 3).alias("cluster"))))


def j20_campaign(spark, d):
    reps = kpi.representatives(kpi.volume_strata(M.hourly(spark, d)), 1).select("stratum", "psap_id")
    return tidy(E.campaign(list(kpi.PATTERNS), [0.10, 0.25, 0.50], [1, 2, 3, 6], reps))


CELLS = (("volume_spike", "volume_drop", "flapping"), (0.25, 0.50), (1, 3, 6))


def _campaign(spark, d):
    h = M.hourly(spark, d)
    reps = kpi.representatives(kpi.volume_strata(h), 2).select("stratum", "psap_id")
    return kpi.campaign(h, E.campaign(*map(list, CELLS), reps), 42)


def c12_campaign(spark, d):
    return tidy(_campaign(spark, d)[0])


def c13_replay(spark, d):
    t = M.scored(spark, d).select("psap_id", "threshold").distinct()
    return tidy(kpi.replay(_campaign(spark, d)[1], t, "2000-01-01 00:00:00"))


def volume_and_rates(rows):
    """A frozen detector: calls, and a tenth of what the rates lack of 100, against the head's limit."""
    return rows["call_volume"] + 0.0137 + 0.1 * (400 - rows["lsr_sr"] - rows["asr_sr"] - rows["bid_sr"] - rows["csr_sr"]), rows["volume_limit"]


def _chain(spark, d):
    """A replay through three heads an entity; 7 and 11 are their own heads, head 7 has no detector, and some hours of entity 4 are invalid."""
    h = M.hourly(spark, d).withColumn("asr_sr", F.when((F.col("psap_id") == 4) & (F.hour("hour_start_utc") < 3), 101.0).otherwise(F.col("asr_sr")))
    reps = kpi.representatives(kpi.volume_strata(h), 2).select("stratum", "psap_id")
    ids = h.where("psap_id NOT IN (7, 11)").select(F.col("psap_id").alias("member_psap_id")).distinct()
    p = F.col("member_psap_id")
    heads = ids.select("member_psap_id", F.posexplode(F.array(p, (p + 1) % 12, (p + 5) % 12)).alias("k", "cluster_head_psap_id")).withColumn("cluster_head_rank", F.col("k") + 1)
    models = h.where("psap_id <> 7").groupBy(F.col("psap_id").alias("head_id")).agg(F.percentile("call_volume", F.lit(0.9)).alias("volume_limit"))
    return replay.replay_evaluation(h, E.campaign(*map(list, CELLS), reps), heads, models, volume_and_rates, "2000-01-01 00:00:00", 42, scratch(spark, "replay"))


def c13_chain_pairs(spark, d):
    return tidy(_chain(spark, d)["pairs"].drop("event_id", "is_active", "has_numeric_change"))


def c13_chain_scored(spark, d):
    return tidy(_chain(spark, d)["scored"].drop("event_id", *replay.KPIS))


def c13_chain_evidence(spark, d):
    return tidy(replay.evidence(_chain(spark, d)["pairs"]))


def c16_trusted_rows(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    now = e.agg(F.max("ts").alias("now"))
    e = e.crossJoin(F.broadcast(now))  # one row
    return tidy(E.trusted(e.select("user_id", "ts", "event_type", "now"), "user_id", "ts", F.col("now")).drop("now"))


def t22_psi_by_hour(spark, d):
    ref, cur = (x.withColumn("bucket", F.hour("hour_start_utc")) for x in M._halves(spark, d))
    return tidy(health.psi(ref, cur, "asr_sr", ["bucket"]))


def after(spark, d):
    """All hours of all entities with the injected score where there is one."""
    p = pairs(spark, d).select(*E.KEY, "injected_ratio")
    return untouched(spark, d).join(p, E.KEY, "left").select(*E.KEY, F.coalesce("injected_ratio", "ratio").alias("ratio"))


def t25_severity_monotonicity(spark, d):
    return tidy(report.monotonicity(pairs(spark, d)))


def t22_drift_groups(spark, d):
    ref, cur = M._halves(spark, d)
    dims = {"cluster": F.col("psap_id") % 4, "market": F.when(F.col("psap_id") < 6, "EAST").otherwise("WEST"), "psap": F.col("psap_id"), "time_bucket": N.time_bucket(F.col("hour_start_utc"))}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), v.cast("string").alias("group")) for k, v in dims.items())))
    long = lambda df: df.select("asr_sr", each.alias("x")).select("asr_sr", "x.*")
    return tidy(report.drift_groups(health.psi(long(ref), long(cur), "asr_sr", ["dimension", "group"])))


def metrics(spark, d):
    """metric and value of the health report, from one aggregate for each table."""
    s, p, o, h, a = M.scored(spark, d), pairs(spark, d), outcomes(spark, d), heads(spark, d), after(spark, d)
    rate = lambda k, n: F.try_divide(F.sum(F.coalesce(k, F.lit(False)).cast("double")), F.sum(F.coalesce(n, F.lit(False)).cast("double")))
    truth_row = F.col("pattern") != "volume_drop"
    rows = a.join(p.select(*E.KEY, "pattern"), E.KEY, "left").withColumns({"alert": F.col("ratio") > 1, "truth": F.coalesce(truth_row, F.lit(False))})
    ep = kpi.episodes(rows.where("alert"))
    events = o.where(truth_row).select("event_id").join(M.events_of(spark, d), "event_id")
    matched = health.match_episodes(ep, events, 1.0)
    found = matched.agg(F.count("*").alias("n"), F.count("detected_at").alias("tp"), F.percentile("delay_hours", F.lit(0.5)).alias("delay"))
    used = health.unmatched_episodes(ep, events, 1.0).agg(F.count("*").alias("fp"))
    levels = E.minimum_severity(o.where(truth_row).withColumn("severity", F.round(F.col("severity") / 0.25 + 1)), ["pattern"], 0.8)
    episodes, flap = kpi.episodes(s.where("alert")), kpi.flapping(s.select(*E.KEY, "alert"))
    psi = health.psi(*M._halves(spark, d), "asr_sr", [])
    m = _mapping(spark, d)
    early = F.dayofmonth("hour_start_utc") <= 15
    stable = E.mapping_stability(m.where(early & (F.col("psap_id") != 1)), m.where(~early & (F.col("psap_id") != 2)))
    parts = [
        found.crossJoin(used).select((F.col("tp") / F.col("n")).alias("event_recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("event_precision"), F.col("delay").alias("median_delay_hours")),  # one row each
        rows.agg(rate(F.col("alert") & F.col("truth"), F.col("truth")).alias("row_recall"), rate(F.col("alert") & F.col("truth"), F.col("alert")).alias("row_precision"), E.share(F.col("ratio").isNotNull()).alias("injected_coverage")),
        p.where(truth_row).agg(F.percentile("lift", F.lit(0.5)).alias("median_ratio_lift")),
        report.monotonicity(p.where(truth_row)).agg(F.percentile("spearman", F.lit(0.5)).alias("median_spearman")),
        levels.agg(F.when(F.count("*") > F.count("minimum_severity"), 99.0).otherwise(F.max("minimum_severity")).alias("worst_minimum_severity")),
        o.where(truth_row).agg(F.avg(F.col("alerted") / F.col("affected")).alias("mean_temporal_coverage"), rate(F.col("detected") & ~F.col("contaminated"), ~F.col("contaminated")).alias("attributable_recall")),
        s.agg((1000 * E.share(F.col("alert"))).alias("alerts_per_1000"), E.share(F.col("call_volume").isNotNull()).alias("baseline_coverage"), F.sum((F.isnan("call_volume") | (F.col("threshold") <= 0)).cast("double")).alias("invalid_rows")),
        h.agg(E.share(F.col("ratio").isNull()).alias("missing_head_rate")), E.head_agreement(h).select("majority_agreement", F.col("p95_spread").alias("p95_dispersion")),
        psi.select(F.col("psi").alias("assessed_psi")), episodes.agg(E.share(F.col("alert_hours") == 1).alias("one_hour_episode_share")), flap.agg((F.sum("transitions") / F.sum("opportunities")).alias("flapping_rate")),
        stable.select(F.col("cluster_change").alias("cluster_change_rate"), F.col("head_change").alias("mapping_change_rate"), (F.col("common") / (F.col("common") + F.col("added"))).alias("mapping_coverage")),
        p.where(~truth_row).agg(E.share(F.col("new_alert")).alias("benign_new_alert_rate"), E.share(F.col("lift") > 1e-6).alias("benign_score_increase_rate")),
        h.agg(F.least(F.lit(1.0), F.sum("sanity").cast("double")).alias("sanity_rows_scored")),
    ]
    out = None
    for part in parts:
        long = part.select(*(F.col(c).cast("double").alias(c) for c in part.columns)).unpivot([], part.columns, "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out


def c14_health_metrics(spark, d):
    return tidy(metrics(spark, d))


def c14_model_health(spark, d):
    return tidy(report.model_health(metrics(spark, d).withColumn("value", F.round("value", 9))))


def _q(select: str, ctes: str = TR) -> str:
    return f"WITH {ctes} {select}"


_RECALL = "count(*) AS events, count(*) FILTER (detected) AS found, " + sh("detected", "recall")
_COVER = "count(*) AS planned, count(ratio) AS scored, {e} AS errors, count(*) FILTER (ratio > 1) AS crossings, " + sh("ratio IS NOT NULL", "coverage")
_MAP = M.H + ", mp AS (SELECT psap_id, hour_start_utc, call_volume::BIGINT % 3 AS cluster, (psap_id + day(hour_start_utc) % 2) % 12 AS head_id FROM h)"
_LAST = "SELECT psap_id, max(x).c AS cluster, max(x).i AS head_id FROM (SELECT psap_id, {{'t': hour_start_utc, 'c': cluster, 'i': head_id}} AS x FROM mp {w}) GROUP BY 1"
_AGREE = "ag AS (SELECT greatest(v, 1 - v) AS m, spread FROM (SELECT psap_id, hour_start_utc, count(*) AS n, avg(CASE WHEN ratio > 1 THEN 1.0::DOUBLE ELSE 0 END) AS v, stddev_pop(ratio) AS spread FROM hd WHERE ratio IS NOT NULL GROUP BY 1, 2) WHERE n >= 2)"
AF = TR + """, af AS (SELECT u.psap_id, u.hour_start_utc, coalesce(injected_ratio, ratio) AS ratio, pattern, coalesce(injected_ratio, ratio) > 1 AS alert, coalesce(pattern <> 'volume_drop', false) AS truth FROM u LEFT JOIN pr USING (psap_id, hour_start_utc)),
  ag0 AS (SELECT psap_id, hour_start_utc, CASE WHEN epoch(hour_start_utc) - epoch(lag(hour_start_utc) OVER (PARTITION BY psap_id ORDER BY hour_start_utc)) <= 5400 THEN 0 ELSE 1 END AS n FROM af WHERE alert),
  ae AS (SELECT psap_id, e, min(hour_start_utc) AS a, max(hour_start_utc) AS z FROM (SELECT *, sum(n) OVER (PARTITION BY psap_id ORDER BY hour_start_utc) AS e FROM ag0) GROUP BY 1, 2),
  te AS (SELECT event_id, psap_id, d + INTERVAL 6 HOUR AS a, d + INTERVAL 8 HOUR AS z FROM ev WHERE event_id IN (SELECT event_id FROM oc WHERE pattern <> 'volume_drop')),
  mt AS (SELECT te.event_id, te.a, min(ae.a) AS det FROM te LEFT JOIN ae ON ae.psap_id = te.psap_id AND ae.z >= te.a AND ae.a <= te.z + INTERVAL 1 HOUR GROUP BY 1, 2),
  fp AS (SELECT count(*) AS n FROM ae WHERE NOT EXISTS (SELECT 1 FROM te WHERE ae.psap_id = te.psap_id AND ae.z >= te.a AND ae.a <= te.z + INTERVAL 1 HOUR AND NOT EXISTS (SELECT 1 FROM ae b WHERE b.psap_id = te.psap_id AND b.z >= te.a AND b.a <= te.z + INTERVAL 1 HOUR AND b.a < ae.a))),
  lv AS (SELECT pattern, severity, quantile_cont(lift, 0.5) AS lift FROM pr WHERE lift IS NOT NULL GROUP BY 1, 2),
  lr AS (SELECT pattern, rank() OVER (PARTITION BY pattern ORDER BY severity) AS s, rank() OVER (PARTITION BY pattern ORDER BY lift) + (count(*) OVER (PARTITION BY pattern, lift) - 1) / 2.0::DOUBLE AS r, lift - lag(lift) OVER (PARTITION BY pattern ORDER BY severity) AS step FROM lv),
  mo AS (SELECT pattern, count(*) AS levels, corr(s, r) AS spearman, avg(CASE WHEN step IS NOT NULL THEN (step < 0)::INT::DOUBLE END) AS inversion_rate FROM lr GROUP BY 1 HAVING count(*) >= 2),
  ms AS (SELECT pattern, min(severity) FILTER (ok) AS least FROM (SELECT pattern, severity, min(r) OVER (PARTITION BY pattern ORDER BY severity DESC) >= 0.8 AS ok FROM (SELECT pattern, round(severity / 0.25 + 1) AS severity, avg(detected::INT) AS r FROM oc WHERE pattern <> 'volume_drop' GROUP BY 1, 2)) GROUP BY 1)"""
_EP = M.EP.removeprefix(M.S + ", ")
_MP = _MAP.removeprefix(M.H + ", ")
_PS = M._PSI.format(k="1", x="asr_sr")
_METRICS = {
    "event_recall": "SELECT count(det)::DOUBLE / count(*) FROM mt", "event_precision": "SELECT count(det)::DOUBLE / (count(det) + (SELECT n FROM fp)) FROM mt",
    "median_delay_hours": "SELECT quantile_cont(greatest(0.0::DOUBLE, (epoch(det) - epoch(a)) / 3600.0), 0.5) FROM mt WHERE det IS NOT NULL",
    "row_recall": "SELECT (count(*) FILTER (alert AND truth))::DOUBLE / count(*) FILTER (truth) FROM af", "row_precision": "SELECT (count(*) FILTER (alert AND truth))::DOUBLE / count(*) FILTER (alert) FROM af",
    "injected_coverage": f"SELECT {SHARE.format('ratio IS NOT NULL')} FROM af", "median_ratio_lift": "SELECT quantile_cont(lift, 0.5) FROM pr WHERE pattern <> 'volume_drop'", "median_spearman": "SELECT quantile_cont(spearman, 0.5) FROM mo WHERE pattern <> 'volume_drop'",
    "worst_minimum_severity": "SELECT CASE WHEN count(*) > count(least) THEN 99 ELSE max(least) END FROM ms", "mean_temporal_coverage": "SELECT avg(alerted::DOUBLE / affected) FROM oc WHERE pattern <> 'volume_drop'",
    "attributable_recall": "SELECT (count(*) FILTER (detected AND NOT contaminated))::DOUBLE / nullif(count(*) FILTER (NOT contaminated), 0) FROM oc WHERE pattern <> 'volume_drop'", "alerts_per_1000": f"SELECT 1000 * {SHARE.format('alert')} FROM s",
    "baseline_coverage": "SELECT 1.0", "invalid_rows": "SELECT count(*) FILTER (threshold <= 0) FROM s", "missing_head_rate": f"SELECT {SHARE.format('ratio IS NULL')} FROM hd", "majority_agreement": "SELECT avg(m) FROM ag", "p95_dispersion": "SELECT quantile_cont(spread, 0.95) FROM ag",
    "assessed_psi": f"WITH {_PS} SELECT sum((s - p) * ln(s / p)) FROM g", "one_hour_episode_share": f"SELECT {SHARE.format('alert_hours = 1')} FROM ep",
    "flapping_rate": "SELECT (count(*) FILTER (gap > 0 AND gap <= 5400 AND alert <> was))::DOUBLE / count(*) FILTER (gap > 0 AND gap <= 5400) FROM (SELECT alert, lag(alert) OVER w AS was, epoch(hour_start_utc) - epoch(lag(hour_start_utc) OVER w) AS gap FROM s WINDOW w AS (PARTITION BY psap_id ORDER BY hour_start_utc))",
    "cluster_change_rate": "SELECT avg(CASE WHEN a.psap_id IS NOT NULL AND b.psap_id IS NOT NULL THEN (a.cluster <> b.cluster)::INT END) FROM la a FULL JOIN lb b ON a.psap_id = b.psap_id",
    "mapping_change_rate": "SELECT avg(CASE WHEN a.psap_id IS NOT NULL AND b.psap_id IS NOT NULL THEN (a.head_id <> b.head_id)::INT END) FROM la a FULL JOIN lb b ON a.psap_id = b.psap_id",
    "mapping_coverage": "SELECT (count(*) FILTER (a.psap_id IS NOT NULL))::DOUBLE / count(*) FROM lb b LEFT JOIN la a ON a.psap_id = b.psap_id", "benign_new_alert_rate": f"SELECT {SHARE.format('now_ AND NOT was')} FROM pr WHERE pattern = 'volume_drop'",
    "benign_score_increase_rate": f"SELECT {SHARE.format('lift > 0.000001')} FROM pr WHERE pattern = 'volume_drop'", "sanity_rows_scored": "SELECT least(1.0, sum(sanity)) FROM hd",
}
_RP = f"""{AF}, {HD.removeprefix(M.S + ', ')}, {_AGREE}, {_EP}, {_MP}, la AS ({_LAST.format(w='WHERE day(hour_start_utc) <= 15 AND psap_id <> 1')}), lb AS ({_LAST.format(w='WHERE day(hour_start_utc) > 15 AND psap_id <> 2')}),
  me AS ({" UNION ALL ".join(f"SELECT '{k}' AS metric, ({q})::DOUBLE AS value" for k, q in _METRICS.items())}),
  li(c, metric, dir, a, b) AS (VALUES {", ".join(f"('{c}', '{m}', '{x}', {a}::DOUBLE, {b}::DOUBLE)" for c, own in report.CHECKS.items() for m, (x, a, b) in own.items())}),
  gr AS (SELECT c, CASE WHEN v IS NULL OR isnan(v) THEN 0 WHEN dir = 'high' THEN CASE WHEN v >= a THEN 1 WHEN v >= b THEN 2 ELSE 3 END ELSE CASE WHEN v <= a THEN 1 WHEN v <= b THEN 2 ELSE 3 END END AS g FROM (SELECT li.*, round(value, 9) AS v FROM li LEFT JOIN me USING (metric)))"""

_BUCKET = "CASE WHEN isodow(hour_start_utc) >= 6 THEN 'WEEKEND' ELSE 'WEEKDAY' END || '_H' || lpad((hour(hour_start_utc) // 4 * 4)::VARCHAR, 2, '0') || '_' || lpad((hour(hour_start_utc) // 4 * 4 + 3)::VARCHAR, 2, '0')"
_DIM_SQL = {"cluster": "(psap_id % 4)::VARCHAR", "market": "CASE WHEN psap_id < 6 THEN 'EAST' ELSE 'WEST' END", "psap": "psap_id::VARCHAR", "time_bucket": _BUCKET}
_DIMS = ", ".join(
    f"dg_{n} AS (WITH {M._PSI.format(k=k, x='asr_sr')} SELECT '{n}' AS dimension, k, CASE WHEN max(hi) = max(lo) THEN 0 ELSE sum((s - p) * ln(s / p)) END AS psi, max(nr) AS nr, max(nc) AS nc FROM g GROUP BY k HAVING max(nr) >= 12 AND max(nc) >= 12)" for n, k in _DIM_SQL.items()
)

_CELLS = M.H + """, ce AS (SELECT concat_ws('|', stratum, psap_id, pattern, severity, duration) AS cell_id, stratum, psap_id, pattern, severity, duration FROM
    (SELECT stratum, psap_id FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY abs(median_volume - mid), psap_id) AS rank FROM (SELECT *, median(median_volume) OVER (PARTITION BY stratum) AS mid FROM
     (SELECT psap_id, median_volume, CASE round_even(2.0 * pos / greatest(n - 1, 1), 0) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS stratum FROM (SELECT psap_id, median(call_volume) AS median_volume, row_number() OVER (ORDER BY median(call_volume), psap_id) - 1 AS pos, count(*) OVER () AS n FROM h GROUP BY 1)))) WHERE rank <= 2),
    (SELECT unnest(['volume_spike', 'volume_drop', 'flapping']) AS pattern), (SELECT unnest([0.25::DOUBLE, 0.50::DOUBLE]) AS severity), (SELECT unnest([1, 3, 6]) AS duration)),
  lw AS (SELECT *, lead(hour_start_utc, 2) OVER w AS z3, lead(hour_start_utc, 5) OVER w AS z6 FROM h WINDOW w AS (PARTITION BY psap_id ORDER BY hour_start_utc)),
  cw AS (SELECT * FROM (SELECT ce.*, hour_start_utc, sha256(concat_ws('|', '42', cell_id, pattern, severity, duration, ce.psap_id, strftime(hour_start_utc, '%Y-%m-%d %H:%M:%S'))) AS event_id, row_number() OVER (PARTITION BY cell_id ORDER BY sha256(concat_ws('|', '42', cell_id, pattern, severity, duration, ce.psap_id, strftime(hour_start_utc, '%Y-%m-%d %H:%M:%S')))) AS r
    FROM ce JOIN lw ON lw.psap_id = ce.psap_id AND (duration = 1 OR (duration = 3 AND z3 = hour_start_utc + INTERVAL 2 HOUR) OR (duration = 6 AND z6 = hour_start_utc + INTERVAL 5 HOUR))) WHERE r = 1),
  cp AS (SELECT cell_id, pattern, h.call_volume / threshold AS was, CASE pattern WHEN 'volume_spike' THEN greatest(ceil(h.call_volume * (1 + severity)), h.call_volume + 1) WHEN 'volume_drop' THEN greatest(0, floor(h.call_volume * (1 - severity))) ELSE h.call_volume END / threshold AS now_
    FROM (SELECT *, unnest(range(0, duration)) AS o FROM cw) c JOIN h ON h.psap_id = c.psap_id AND h.hour_start_utc = c.hour_start_utc + to_hours(o) JOIN (SELECT psap_id, quantile_cont(call_volume, 0.9) AS threshold FROM h GROUP BY 1) t ON t.psap_id = c.psap_id)"""

_INJECT = "CASE WHEN pattern = 'flapping' AND o % 2 = 0 THEN least(100, greatest(0, {0} * (1 - severity))) ELSE {0} END AS {0}"
_RATES = "lsr_sr, asr_sr, bid_sr, csr_sr"
_CHAIN = f"""{_CELLS}, hx AS (SELECT * REPLACE (CASE WHEN psap_id = 4 AND hour(hour_start_utc) < 3 THEN 101.0::DOUBLE ELSE asr_sr END AS asr_sr) FROM h),
  cx AS (SELECT c.* EXCLUDE (hour_start_utc, r), hx.hour_start_utc, call_volume, {_RATES} FROM (SELECT *, unnest(range(0, duration)) AS o FROM cw) c JOIN hx ON hx.psap_id = c.psap_id AND hx.hour_start_utc = c.hour_start_utc + to_hours(o)),
  rw AS (SELECT 'UNTOUCHED_BASELINE' AS evaluation_set, NULL AS event_id, NULL AS o, psap_id, hour_start_utc, call_volume, {_RATES} FROM hx UNION ALL SELECT 'PAIRED_UNTOUCHED_BASELINE', event_id, o, psap_id, hour_start_utc, call_volume, {_RATES} FROM cx
    UNION ALL SELECT 'SYNTHETIC_CHALLENGE', event_id, o, psap_id, hour_start_utc, CASE pattern WHEN 'volume_spike' THEN greatest(ceil(call_volume * (1 + severity)), call_volume + 1) WHEN 'volume_drop' THEN greatest(0, floor(call_volume * (1 - severity))) ELSE call_volume END, {", ".join(_INJECT.format(k) for k in _RATES.split(", "))} FROM cx),
  hl AS (SELECT psap_id AS head_id, quantile_cont(call_volume, 0.9) AS volume_limit FROM h WHERE psap_id <> 7 GROUP BY 1),
  fa AS (SELECT *, unnest(CASE WHEN psap_id IN (7, 11) THEN [psap_id] ELSE [psap_id, (psap_id + 1) % 12, (psap_id + 5) % 12] END) AS head_id FROM rw),
  hs AS (SELECT fa.*, asr_sr <= 100 AS valid, volume_limit IS NOT NULL AS known, CASE WHEN asr_sr <= 100 THEN (call_volume + 0.0137::DOUBLE + 0.1::DOUBLE * (400 - lsr_sr - asr_sr - bid_sr - csr_sr)) / volume_limit END AS r FROM fa LEFT JOIN hl USING (head_id)),
  ag0 AS (SELECT evaluation_set, event_id, o, psap_id, hour_start_utc, call_volume, {_RATES}, count(*) AS heads, count(r) AS scored_heads, avg(r) AS anomaly_score, count(*) FILTER (r > 1) AS votes, stddev_pop(r) AS head_ratio_std, bool_and(valid) AS valid, bool_or(known) AS known FROM hs GROUP BY ALL),
  ag1 AS (SELECT *, votes::DOUBLE / nullif(scored_heads, 0) AS vote_fraction, coalesce(anomaly_score > 1, false) AS alert, CASE WHEN NOT valid THEN 'SKIPPED_INVALID_INPUT' WHEN NOT known THEN 'SKIPPED_NO_DETECTOR' WHEN scored_heads = 0 THEN 'SCORING_ERROR' WHEN scored_heads < heads THEN 'SCORED_PARTIAL_HEADS' ELSE 'SCORED' END AS scoring_status,
    CASE WHEN anomaly_score IS NULL THEN 'NON_FINITE' WHEN asr_sr > 100 THEN 'RATE_OUT_OF_RANGE_ASR_SR' WHEN call_volume <= 0 THEN 'NO_VOLUME' WHEN anomaly_score <= 1 THEN 'SCORE_NOT_ABOVE_THRESHOLD' ELSE 'OK' END AS gate FROM ag0),
  sg AS (SELECT *, alert AND gate = 'OK' AND ({M.TIER}) AS eligible FROM ag1),
  pp AS (SELECT cx.event_id, cx.o, cell_id, stratum, pattern, severity, duration, cx.psap_id, cx.hour_start_utc, b.anomaly_score AS baseline_score, b.alert AS baseline_alert, b.eligible AS baseline_eligible, b.scoring_status AS baseline_status, i.anomaly_score AS injected_score, i.alert AS injected_alert, i.eligible AS injected_eligible, i.scoring_status AS injected_status
    FROM cx LEFT JOIN sg b ON b.evaluation_set = 'PAIRED_UNTOUCHED_BASELINE' AND b.event_id = cx.event_id AND b.o = cx.o LEFT JOIN sg i ON i.evaluation_set = 'SYNTHETIC_CHALLENGE' AND i.event_id = cx.event_id AND i.o = cx.o),
  pe AS (SELECT pattern, event_id, count(*) AS n, count(*) FILTER (injected_score IS NULL OR baseline_score IS NULL) AS unscored, bool_or(injected_alert) AS det, bool_or(injected_eligible) AS pas, bool_or(baseline_alert) AS con, count(*) FILTER (injected_alert AND NOT baseline_alert) AS fresh, count(*) FILTER (baseline_alert AND NOT injected_alert) AS lost FROM pp GROUP BY 1, 2)"""

QUERIES = {
    "c13_chain_pairs": (c13_chain_pairs, _q("""SELECT o::BIGINT AS offset_hour, cell_id, stratum, pattern, severity, duration::BIGINT AS duration, psap_id, hour_start_utc, round(baseline_score, 6) AS baseline_score, baseline_alert, baseline_eligible, baseline_status, round(injected_score, 6) AS injected_score, injected_alert, injected_eligible, injected_status,
        round(injected_score - baseline_score, 6) AS lift, injected_alert AND NOT baseline_alert AS new_alert, baseline_alert AND NOT injected_alert AS lost_alert FROM pp""", _CHAIN)),
    "c13_chain_scored": (c13_chain_scored, _q("SELECT evaluation_set, o::BIGINT AS offset_hour, psap_id, hour_start_utc, heads, scored_heads, round(anomaly_score, 6) AS anomaly_score, votes, round(head_ratio_std, 6) AS head_ratio_std, round(vote_fraction, 6) AS vote_fraction, alert, scoring_status, gate, eligible FROM sg", _CHAIN)),
    "c13_chain_evidence": (c13_chain_evidence, _q("""SELECT pattern, count(*) AS events, sum(n)::BIGINT AS rows, sum(unscored)::BIGINT AS unscored, count(*) FILTER (det) AS detected, count(*) FILTER (pas) AS passed_on, count(*) FILTER (con) AS contaminated, count(*) FILTER (det AND NOT con) AS attributable, sum(fresh)::BIGINT AS new_alerts, sum(lost)::BIGINT AS lost_alerts,
        round((count(*) FILTER (det))::DOUBLE / count(*), 6) AS recall, round((count(*) FILTER (det AND NOT con))::DOUBLE / nullif(count(*) FILTER (NOT con), 0), 6) AS attributable_recall, round(max(ml), 6) AS median_lift FROM pe JOIN (SELECT pattern, quantile_cont(injected_score - baseline_score, 0.5) AS ml FROM pp GROUP BY 1) USING (pattern) GROUP BY 1""", _CHAIN)),
    "c12_campaign": (c12_campaign, _q("SELECT ce.cell_id, ce.stratum, ce.psap_id, ce.pattern, ce.severity, ce.duration::BIGINT AS duration, hour_start_utc, event_id, CASE WHEN event_id IS NULL THEN 'SKIPPED_NO_WINDOW' ELSE 'INJECTED' END AS status FROM ce LEFT JOIN cw USING (cell_id)", _CELLS)),
    "c13_replay": (c13_replay, _q("""SELECT pattern, count(*) AS cells, count(*) FILTER (det) AS detected, count(*) FILTER (con) AS contaminated, round((count(*) FILTER (det))::DOUBLE / count(*), 6) AS recall, round((count(*) FILTER (det AND NOT con))::DOUBLE / nullif(count(*) FILTER (NOT con), 0), 6) AS attributable_recall, round(max(ml), 6) AS median_lift
        FROM (SELECT cell_id, pattern, max(now_) > 1 AS det, max(was) > 1 AS con FROM cp GROUP BY 1, 2) JOIN (SELECT pattern, quantile_cont(now_ - was, 0.5) AS ml FROM cp GROUP BY 1) USING (pattern) GROUP BY 1""", _CELLS)),
    "j24_paired_rows": (j24_paired_rows, _q("SELECT psap_id, hour_start_utc, event_id, pattern, severity, stratum, round(baseline_ratio, 6) AS baseline_ratio, round(injected_ratio, 6) AS injected_ratio, round(lift, 6) AS lift, was AS baseline_alert, now_ AS injected_alert, now_ AND NOT was AS new_alert, was AND NOT now_ AS lost_alert FROM pr")),
    "j16_truth_scores": (j16_truth_scores, _q("SELECT event_id, hour_start_utc, round(injected_ratio, 6) AS ratio FROM pr")),
    "j14_injected_truth": (j14_injected_truth, _q("SELECT inj.psap_id, inj.hour_start_utc, inj.event_id, round(ratio, 6) AS ratio, pattern FROM inj JOIN tr USING (psap_id, hour_start_utc)")),
    "j18_contamination": (j18_contamination, _q("SELECT event_id, untouched_alerts, contaminated FROM oc")),
    "a31_logical_rows": (a31_logical_rows, _q("SELECT psap_id, hour_start_utc, round(avg(ratio), 6) AS ratio, max(sanity)::BIGINT AS sanity, count(*) AS heads, arg_min('HEAD_' || head_id, head_rank) FILTER (ratio IS NOT NULL) AS status FROM hd GROUP BY 1, 2", HD)),
    "a32_scoring_metadata": (a32_scoring_metadata, _q(f"SELECT pattern, {_COVER.format(e='count(*) FILTER (psap_id = 5 AND ratio IS NOT NULL)')} FROM tr LEFT JOIN u USING (psap_id, hour_start_utc) GROUP BY 1")),
    "a35_recall_sets": (a35_recall_sets, _q(f"SELECT pattern, severity, stratum, {_RECALL} FROM oc GROUP BY GROUPING SETS ((pattern), (severity), (stratum), (pattern, severity, stratum), ())")),
    "a53_blind_spot": (a53_blind_spot, _q(f"SELECT severity, {_RECALL} FROM oc WHERE pattern = 'volume_drop' GROUP BY GROUPING SETS ((severity), ())")),
    "a36_detection_delay": (a36_detection_delay, _q("""SELECT psap_id, count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.9), 6) AS p90, round(max(x), 6) AS max FROM
        (SELECT e.psap_id, a, greatest(0.0::DOUBLE, (epoch(min(episode_start)) - epoch(a)) / 3600.0) AS x FROM (SELECT psap_id, d + INTERVAL 6 HOUR AS a, d + INTERVAL 8 HOUR AS z FROM ev) e JOIN ep ON ep.psap_id = e.psap_id AND episode_end >= a AND episode_start <= z + INTERVAL 1 HOUR GROUP BY 1, 2) GROUP BY 1""", TR + ", " + M.EP.removeprefix(M.S + ", "))),
    "a37_score_lift": (a37_score_lift, _q(f"SELECT pattern, count(*) AS n, round(avg(lift), 6) AS mean, round(quantile_cont(lift, 0.25), 6) AS p25, round(quantile_cont(lift, 0.5), 6) AS median, round(quantile_cont(lift, 0.75), 6) AS p75, {sh('lift > 0', 'positive_rate')} FROM pr WHERE lift IS NOT NULL GROUP BY 1")),
    "a38_temporal_coverage": (a38_temporal_coverage, _q(f"SELECT pattern, count(*) AS events, round(avg(alerted::DOUBLE / affected), 6) AS mean, round(quantile_cont(alerted::DOUBLE / affected, 0.5), 6) AS median, {sh('alerted = affected', 'fully_covered')} FROM oc GROUP BY 1")),
    "a39_attributable_recall": (a39_attributable_recall, _q("SELECT pattern, count(*) AS events, count(*) FILTER (NOT contaminated) AS clean_events, count(*) FILTER (NOT contaminated AND detected) AS found, round((count(*) FILTER (NOT contaminated AND detected))::DOUBLE / nullif(count(*) FILTER (NOT contaminated), 0), 6) AS recall FROM oc GROUP BY 1")),
    "a40_benign_controls": (a40_benign_controls, _q(f"SELECT stratum, count(*) AS n, {sh('now_ AND NOT was', 'new_alert_rate')}, {sh('lift > 0', 'increase_rate')}, round(quantile_cont(lift, 0.5), 6) AS median_delta, round(max(lift), 6) AS max_delta FROM pr WHERE pattern = 'volume_drop' GROUP BY 1")),
    "a41_minimum_severity": (a41_minimum_severity, _q(f"SELECT pattern, stratum, count(*) AS levels, min(severity) FILTER (ok) AS minimum_severity FROM (SELECT pattern, stratum, severity, min(r) OVER (PARTITION BY pattern, stratum ORDER BY severity DESC) >= 0.5 AS ok FROM (SELECT pattern, stratum, severity, {SHARE.format('detected')} AS r FROM oc GROUP BY 1, 2, 3)) GROUP BY 1, 2")),
    "a42_coverage": (a42_coverage, _q(f"SELECT stratum, {_COVER.format(e='0::BIGINT')} FROM tr LEFT JOIN u USING (psap_id, hour_start_utc) GROUP BY 1")),
    "a43_components": (a43_components, _q(f"SELECT head_id, count(*) AS n, count(*) FILTER (ratio IS NULL) AS missing, {sh('ratio IS NULL', 'missing_rate')} FROM hd GROUP BY 1", HD)),
    "a44_head_agreement": (a44_head_agreement, _q(f"SELECT count(*) AS n, round(avg(m), 6) AS majority_agreement, {sh('m >= 1', 'all_agree')}, round(avg(spread), 6) AS mean_spread, round(quantile_cont(spread, 0.95), 6) AS p95_spread FROM ag", f"{HD}, {_AGREE}")),
    "a45_score_integrity": (a45_score_integrity, _q(f"""SELECT count(*) AS n, count(*) FILTER (psap_id = 2) AS non_finite, count(*) FILTER (psap_id = 4) AS bad_threshold, count(*) FILTER (alert <> crossing) AS alert_mismatch, round((count(*) FILTER (crossing AND NOT eligible))::DOUBLE / nullif(count(*) FILTER (crossing), 0), 6) AS suppression_rate,
        round(quantile_cont(ratio, 0.5), 6) AS ratio_p50, round(quantile_cont(ratio, 0.95), 6) AS ratio_p95, round(quantile_cont(ratio, 0.99), 6) AS ratio_p99 FROM (SELECT psap_id, alert, psap_id NOT IN (2, 4) AND call_volume > threshold AS crossing, CASE WHEN psap_id NOT IN (2, 4) THEN call_volume / threshold END AS ratio, {M.TIER} AS eligible FROM s)""", M.S)),
    "t27_mapping_stability": (t27_mapping_stability, _q(f"""SELECT count(*) FILTER (a.psap_id IS NOT NULL AND b.psap_id IS NOT NULL) AS common, count(*) FILTER (b.psap_id IS NULL) AS gone, count(*) FILTER (a.psap_id IS NULL) AS added, round(avg(CASE WHEN a.psap_id IS NOT NULL AND b.psap_id IS NOT NULL THEN (a.cluster <> b.cluster)::INT END), 6) AS cluster_change,
        round(avg(CASE WHEN a.psap_id IS NOT NULL AND b.psap_id IS NOT NULL THEN (a.head_id <> b.head_id)::INT END), 6) AS head_change FROM ({_LAST.format(w='WHERE day(hour_start_utc) <= 15 AND psap_id <> 1')}) a FULL JOIN ({_LAST.format(w='WHERE day(hour_start_utc) > 15 AND psap_id <> 2')}) b ON a.psap_id = b.psap_id""", _MAP)),
    "j19_latest_mapping": (j19_latest_mapping, _q(_LAST.format(w=""), _MAP)),
    "j23_mapping_conflicts": (j23_mapping_conflicts, _q("SELECT psap_id, 2::BIGINT AS clusters, least(v % 2, v % 3) AS lowest, greatest(v % 2, v % 3) AS highest FROM (SELECT psap_id, max(call_volume)::BIGINT AS v FROM h GROUP BY 1) WHERE v % 2 <> v % 3", M.H)),
    "j20_campaign": (j20_campaign, _q("""SELECT concat_ws('|', stratum, psap_id, pattern, severity, duration) AS cell_id, stratum, psap_id, pattern, severity, duration::BIGINT AS duration FROM
        (SELECT stratum, psap_id FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY abs(median_volume - mid), psap_id) AS rank FROM (SELECT *, median(median_volume) OVER (PARTITION BY stratum) AS mid FROM
         (SELECT psap_id, median_volume, CASE round_even(2.0 * pos / greatest(n - 1, 1), 0) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS stratum FROM (SELECT psap_id, median(call_volume) AS median_volume, row_number() OVER (ORDER BY median(call_volume), psap_id) - 1 AS pos, count(*) OVER () AS n FROM h GROUP BY 1)))) WHERE rank = 1),
        (SELECT unnest([""" + ", ".join(f"'{p}'" for p in kpi.PATTERNS) + """]) AS pattern), (SELECT unnest([0.10::DOUBLE, 0.25::DOUBLE, 0.50::DOUBLE]) AS severity), (SELECT unnest([1, 2, 3, 6]) AS duration)""", M.H)),
    "c16_trusted_rows": (c16_trusted_rows, "SELECT user_id, max(x).ts AS ts, max(x).e AS event_type FROM (SELECT user_id, {'ts': ts::TIMESTAMP, 'e': event_type} AS x FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 168 HOUR) GROUP BY 1"),
    "t22_psi_by_hour": (t22_psi_by_hour, _q("SELECT k AS bucket, CASE WHEN max(nr) >= 2 AND max(nc) >= 2 THEN round(CASE WHEN max(hi) = max(lo) THEN 0 ELSE sum((s - p) * ln(s / p)) END, 6) END AS psi, max(nr) AS n_reference, max(nc) AS n_current FROM g GROUP BY 1", M.H + ", " + M._PSI.format(k="hour(hour_start_utc)", x="asr_sr"))),
    "c14_health_metrics": (c14_health_metrics, _q("SELECT metric, round(value, 6) AS value FROM me", _RP)),
    "c14_model_health": (c14_model_health, _q("SELECT c AS \"check\", list_extract(['UNKNOWN', 'PASS', 'WARN', 'FAIL'], g + 1) AS status, list_extract(['UNKNOWN', 'PASS', 'WARN', 'FAIL'], (max(g) OVER ()) + 1) AS overall FROM (SELECT c, max(g) AS g FROM gr GROUP BY 1)", _RP)),
    "t25_severity_monotonicity": (t25_severity_monotonicity, _q("SELECT pattern, levels, round(spearman, 6) AS spearman, round(inversion_rate, 6) AS inversion_rate FROM mo", AF)),
    "t22_drift_groups": (t22_drift_groups, _q("SELECT dimension, k AS \"group\", round(psi, 6) AS psi, nr AS n_reference, nc AS n_current, groups, round(max_psi, 6) AS max_psi, round(p95, 6) AS p95_psi, rank FROM (SELECT *, count(*) OVER w AS groups, max(psi) OVER w AS max_psi, quantile_cont(psi, 0.95) OVER w AS p95, row_number() OVER (PARTITION BY dimension ORDER BY psi DESC, k) AS rank FROM dg WINDOW w AS (PARTITION BY dimension)) WHERE rank <= 20",
        M.H + ", " + _DIMS + ", dg AS (" + " UNION ALL ".join(f"SELECT * FROM dg_{n}" for n in ("cluster", "market", "psap", "time_bucket")) + ")")),
}
