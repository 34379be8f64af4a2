"""Queries over hourly KPIs, scores, alerts and classified texts, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import health, kpi, report
from ..sources.tables import table
from .common import tidy


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rate = lambda kind: (100 * F.avg((F.col("event_type") != kind).cast("double"))).alias
    g = e.groupBy((F.col("user_id") % 12).alias("psap_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_start_utc"))
    return g.agg(F.count("*").cast("double").alias("call_volume"), rate("error")("lsr_sr"), rate("view")("asr_sr"), rate("click")("bid_sr"), rate("purchase")("csr_sr"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir)
    t = h.groupBy("psap_id").agg(F.percentile("call_volume", F.lit(0.9)).alias("threshold"))
    return h.join(F.broadcast(t), "psap_id").withColumn("alert", F.col("call_volume") > F.col("threshold"))


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known event of three hours for each entity and day: hours 6 to 8."""
    days = hourly(spark, sf_dir).select("psap_id", F.date_trunc("day", "hour_start_utc").cast("timestamp_ntz").alias("day")).distinct()
    return days.select(F.concat_ws("-", "psap_id", F.date_format("day", "yyyyMMdd")).alias("event_id"), "psap_id", (F.col("day") + F.expr("INTERVAL 6 HOURS")).alias("event_start"), (F.col("day") + F.expr("INTERVAL 8 HOURS")).alias("event_end"))


H = """h AS (SELECT user_id % 12 AS psap_id, date_trunc('hour', ts)::TIMESTAMP AS hour_start_utc, count(*)::DOUBLE AS call_volume, 100 * avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0 END) AS lsr_sr,
  100 * avg(CASE WHEN event_type <> 'view' THEN 1.0::DOUBLE ELSE 0 END) AS asr_sr, 100 * avg(CASE WHEN event_type <> 'click' THEN 1.0::DOUBLE ELSE 0 END) AS bid_sr, 100 * avg(CASE WHEN event_type <> 'purchase' THEN 1.0::DOUBLE ELSE 0 END) AS csr_sr FROM events GROUP BY 1, 2)"""
S = H + """, t AS (SELECT psap_id, quantile_cont(call_volume, 0.9) AS threshold FROM h GROUP BY 1), s AS (SELECT h.*, threshold, call_volume > threshold AS alert FROM h JOIN t USING (psap_id))"""
EP = S + """, g AS (SELECT psap_id, hour_start_utc, CASE WHEN epoch(hour_start_utc) - epoch(lag(hour_start_utc) OVER (PARTITION BY psap_id ORDER BY hour_start_utc)) <= 5400 THEN 0 ELSE 1 END AS n FROM s WHERE alert),
  r AS (SELECT *, sum(n) OVER (PARTITION BY psap_id ORDER BY hour_start_utc)::BIGINT AS episode FROM g), ep AS (SELECT psap_id, episode, min(hour_start_utc) AS episode_start, max(hour_start_utc) AS episode_end, count(*) AS alert_hours FROM r GROUP BY 1, 2)"""
TIER = """CASE WHEN bid_sr >= 95 AND csr_sr >= 95 AND asr_sr >= 85 AND lsr_sr >= 85 THEN false WHEN bid_sr >= 90 AND csr_sr >= 90 THEN lsr_sr <= 45 AND asr_sr <= 45 AND call_volume > 20
  WHEN bid_sr >= 82 AND csr_sr >= 82 THEN lsr_sr <= 65 AND asr_sr <= 65 AND call_volume > 15 WHEN bid_sr < 82 AND csr_sr < 82 THEN call_volume > 9 ELSE (lsr_sr < 70 OR asr_sr < 70) AND call_volume > 12 END"""


def c20_hourly_kpi(spark, d):
    return tidy(hourly(spark, d))


def p15_quality_issues(spark, d):
    h = hourly(spark, d).withColumn("psap_id", F.when(F.col("psap_id") == 3, -1).otherwise(F.col("psap_id"))).withColumn("asr_sr", F.when(F.col("call_volume") > 4, 101.0).otherwise(F.col("asr_sr")))
    return tidy(h.groupBy(kpi.quality_issues().alias("issues")).agg(F.count("*").alias("n")))


def p17_tier_gate(spark, d):
    return tidy(hourly(spark, d).withColumn("call_volume", F.col("call_volume") * 4).select("psap_id", "hour_start_utc", kpi.tier_gate().alias("passes")))


def p16_hard_gate(spark, d):
    return tidy(scored(spark, d).groupBy(kpi.hard_gate(F.col("call_volume"), F.col("threshold")).alias("reason")).agg(F.count("*").alias("n")))


def a28_volume_strata(spark, d):
    return tidy(kpi.volume_strata(hourly(spark, d)))


def a29_representatives(spark, d):
    return tidy(kpi.representatives(kpi.volume_strata(hourly(spark, d)), 2))


def a30_multi_head(spark, d):
    s = scored(spark, d)
    heads = spark.range(12).select(F.col("id").alias("member_psap_id"), F.posexplode(F.array(F.col("id"), (F.col("id") + 1) % 12, (F.col("id") + 5) % 12)).alias("r", "cluster_head_psap_id")).withColumn("cluster_head_rank", F.col("r") + 1)
    thresholds = s.select(F.col("psap_id").alias("head_id"), "threshold").distinct()
    fan = kpi.fan_out(s.drop("threshold"), heads).join(F.broadcast(thresholds), "head_id")
    return tidy(kpi.aggregate_heads(fan.select("psap_id", "hour_start_utc", F.when((F.col("head_id") != 7) | (F.col("call_volume") != 2), F.col("call_volume")).alias("raw_score"), F.col("threshold").alias("raw_threshold"), (F.col("call_volume") != 5).alias("input_valid"), (~F.col("head_id").isin(2, 9, 10)).alias("has_detector"))).drop("anomaly_score", "alert"))


def a33_distribution(spark, d):
    return tidy(health.distribution(hourly(spark, d), "call_volume", ["psap_id"]))


def a34_confusion(spark, d):
    s = scored(spark, d).withColumn("alert", F.when(F.col("psap_id") % 5 != 4, F.col("alert"))).withColumn("truth", F.hour("hour_start_utc").between(6, 8))
    return tidy(health.confusion(s, ["psap_id"]))


def a46_alert_burden(spark, d):
    s = scored(spark, d).withColumn("call_volume", F.col("call_volume"))
    gated = F.col("alert") & kpi.tier_gate()
    per = lambda c: (1000 * F.avg(c.cast("double")))
    return tidy(s.agg(F.count("*").alias("entity_hours"), per(F.col("alert")).alias("raw_per_1000"), per(gated).alias("gated_per_1000")))


def a47_replay_quality(spark, d):
    h = hourly(spark, d)
    m = kpi.missing_hours(h).groupBy("psap_id").agg(F.count("*").alias("missing_hours"))
    g = h.groupBy("psap_id").agg(F.count("*").alias("hours"), F.min("hour_start_utc").alias("first_hour"), F.max("hour_start_utc").alias("last_hour"), F.sum("call_volume").alias("volume"))
    return tidy(g.join(m, "psap_id", "left").na.fill(0, ["missing_hours"]))


def w4_alert_episodes(spark, d):
    return tidy(kpi.episodes(scored(spark, d).where("alert")))


def w5_flapping(spark, d):
    return tidy(kpi.flapping(scored(spark, d).select("psap_id", "hour_start_utc", "alert")))


def w6_isolated(spark, d):
    return tidy(kpi.isolated(kpi.episodes(scored(spark, d).where("alert"))))


def w7_windows(spark, d):
    return tidy(kpi.windows(hourly(spark, d), 3))


def o3_missing_hours(spark, d):
    return tidy(kpi.missing_hours(hourly(spark, d)))


def _specs(spark):
    rows = [(p, s, n) for p in kpi.PATTERNS for s in (0.10, 0.25, 0.50) for n in (1, 2, 3)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal long, pattern string, severity double, duration int")


def w8_chosen_windows(spark, d):
    return tidy(kpi.choose_windows(hourly(spark, d), _specs(spark), 42))


def c11_perturbation(spark, d):
    h = hourly(spark, d)
    return tidy(kpi.perturb(h, kpi.choose_windows(h, _specs(spark), 42)))


def j17_episode_match(spark, d):
    return tidy(health.match_episodes(kpi.episodes(scored(spark, d).where("alert")), events_of(spark, d), 1.0))


def a35_event_recall(spark, d):
    m = health.match_episodes(kpi.episodes(scored(spark, d).where("alert")), events_of(spark, d), 1.0)
    hit = F.col("detected_at").isNotNull()
    g = m.withColumn("band", F.when(F.col("psap_id") < 6, "low").otherwise("high")).rollup("band", "psap_id")
    return tidy(g.agg(F.count("*").alias("events"), F.count(F.when(hit, 1)).alias("detected"), F.avg(hit.cast("double")).alias("recall"), F.avg("delay_hours").alias("mean_delay")))


def _halves(spark, d):
    h = hourly(spark, d)
    middle = h.agg((F.min("hour_start_utc") + F.expr("INTERVAL 15 DAYS")).alias("m"))
    both = h.crossJoin(F.broadcast(middle))
    return both.where("hour_start_utc < m").drop("m"), both.where("hour_start_utc >= m").drop("m")


def t21_psi(spark, d):
    ref, cur = _halves(spark, d)
    return tidy(health.psi(ref, cur, "lsr_sr", []))


def t22_psi_by_entity(spark, d):
    ref, cur = _halves(spark, d)
    return tidy(health.psi(ref, cur, "asr_sr", ["psap_id"]))


def tickets(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "text", "lang", F.col("quality").cast("string").alias("actual"), (F.col("n_chars") > 400).cast("int").cast("string").alias("prediction"), ((F.col("doc_id") % 100) / 100).alias("confidence"))


def a48_classification(spark, d):
    return tidy(health.classification(tickets(spark, d), "actual", "prediction"))


def a49_token_counts(spark, d):
    return tidy(health.token_counts(table(spark, d, "documents"), "text", ["lang"]))


def a50_input_health(spark, d):
    return tidy(health.input_health(table(spark, d, "documents"), "text", "doc_id"))


def a51_prediction_health(spark, d):
    t = tickets(spark, d)
    return tidy(t.agg(F.count("*").alias("n"), (100 * F.avg(F.col("prediction").isNotNull().cast("double"))).alias("coverage_pct"), F.avg("confidence").alias("mean_confidence"), (100 * F.avg((F.col("confidence") < 0.5).cast("double"))).alias("low_confidence_pct")))


def t23_text_divergence(spark, d):
    docs = table(spark, d, "documents")
    side = lambda r: health.token_counts(docs.where(F.col("doc_id") % 2 == r), "text", [])
    return tidy(health.divergence(side(0), side(1), "token"))


def classifier_metrics(spark, d):
    docs, t = table(spark, d, "documents"), tickets(spark, d)
    half = lambda r: F.col("doc_id") % 2 == r
    health_in = health.input_health(docs, "text", "doc_id").select(F.col("tickets").alias("ticket_count"), F.col("missing_pct").alias("missing_text_rate_pct"), F.col("short_pct").alias("short_text_rate_pct"), F.col("duplicate_pct").alias("duplicate_id_rate_pct"))
    sure = t.agg(F.avg("confidence").alias("average_prediction_confidence"), (100 * F.avg((F.col("confidence") < 0.6).cast("double"))).alias("low_confidence_rate_pct"))
    counts = lambda r: t.where(half(r)).groupBy("prediction").agg(F.count("*").alias("n"))
    shift = health.divergence(counts(0), counts(1), "prediction").select(F.col("js_divergence").alias("prediction_distribution_jsd"))
    words = lambda r: health.token_counts(docs.where(half(r)), "text", [])
    text = health.divergence(words(0), words(1), "token").select(F.col("js_divergence").alias("token_distribution_jsd"), (100 * F.col("unseen_rate")).alias("unseen_token_rate_pct"))
    scores = health.classification(t, "actual", "prediction").select(F.col("accuracy").alias("production_accuracy"), F.col("weighted_f1").alias("production_weighted_f1"))
    out = None
    for part in (health_in, sure, shift, text, scores):
        long = part.select(*(F.col(c).cast("double").alias(c) for c in part.columns)).unpivot([], part.columns, "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out


def c15_classifier_health(spark, d):
    return tidy(report.classifier_health(classifier_metrics(spark, d).withColumn("value", F.round("value", 9))))


def t26_text_challenger(spark, d):
    from ..operators import screen

    t = tickets(spark, d).where("actual IS NOT NULL")
    return tidy(screen.text_challenger(t.where("doc_id % 3 <> 0"), t.where("doc_id % 3 = 0"), "text", "actual", "prediction", 1 << 12))


def c18_detector_scores(spark, d):
    """A detector for each head: volume over its median, threshold 2; head 5 fails, and head 7 has no threshold."""
    h = hourly(spark, d).select(F.col("psap_id").alias("head"), "hour_start_utc", "call_volume")

    def detector(pdf):
        if pdf["head"].iloc[0] == 5:
            raise ValueError("no detector")
        return pdf["call_volume"] / pdf["call_volume"].median(), 0.0 if pdf["head"].iloc[0] == 7 else 2.0

    got = kpi.score_with(h, "head", detector, "head long, hour_start_utc timestamp_ntz, call_volume double, raw_score double, raw_threshold double, head_status string")
    return tidy(got.select("head", "hour_start_utc", F.when(F.col("head_status") == "SCORED", F.col("raw_score")).alias("score"), "head_status"))


def t25_mid_ranks(spark, d):
    h = hourly(spark, d)
    return tidy(h.select("psap_id", "hour_start_utc", health.mid_rank(["psap_id"], "call_volume").alias("mid_rank")))


def _q(select: str, ctes: str = H) -> str:
    return f"WITH {ctes} {select}"


_PSI = """b AS (SELECT *, hour_start_utc < (SELECT min(hour_start_utc) FROM h) + INTERVAL 15 DAY AS ref FROM h),
  q AS (SELECT {k} AS k, list_sort(list_distinct(quantile_cont({x}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FILTER (ref))) AS e, min({x}) AS lo, max({x}) AS hi, count(*) FILTER (ref) AS nr, count(*) FILTER (NOT ref) AS nc FROM b GROUP BY 1),
  q2 AS (SELECT k, lo, hi, nr, nc, CASE WHEN len(e) < 3 THEN list_transform(range(0, 11), lambda i: lo + (hi - lo) * i / 10) ELSE e END AS e FROM q),
  i AS (SELECT *, list_slice(e, 2, len(e) - 1) AS inn FROM q2), c AS (SELECT k, len(list_filter(inn, lambda z: z <= {x})) AS bin, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM b JOIN i ON i.k = {k} GROUP BY 1, 2),
  g AS (SELECT i.k, nr, nc, lo, hi, greatest(coalesce(r, 0)::DOUBLE / nr, 1e-6) AS p, greatest(coalesce(c, 0)::DOUBLE / nc, 1e-6) AS s FROM (SELECT k, nr, nc, lo, hi, unnest(range(0, len(inn) + 1)) AS bin FROM i) i LEFT JOIN c ON c.k = i.k AND c.bin = i.bin)"""

_SPECS = [(p, s, n) for p in kpi.PATTERNS for s in (0.10, 0.25, 0.50) for n in (1, 2, 3)]
W8 = H + ", sp(ordinal, pattern, severity, duration) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{p}', {s}::DOUBLE, {n})" for i, (p, s, n) in enumerate(_SPECS)) + """),
  fw AS (SELECT psap_id, hour_start_utc, n AS duration FROM (SELECT psap_id, hour_start_utc, 1 AS n, hour_start_utc AS z FROM h UNION ALL SELECT psap_id, hour_start_utc, 2, lead(hour_start_utc, 1) OVER w FROM h WINDOW w AS (PARTITION BY psap_id ORDER BY hour_start_utc)
    UNION ALL SELECT psap_id, hour_start_utc, 3, lead(hour_start_utc, 2) OVER w FROM h WINDOW w AS (PARTITION BY psap_id ORDER BY hour_start_utc)) WHERE z = hour_start_utc + to_hours(n - 1)),
  ch AS (SELECT ordinal, pattern, severity, duration, psap_id, hour_start_utc, x AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY x, psap_id, hour_start_utc) AS r FROM
    (SELECT sp.*, psap_id, hour_start_utc, sha256(concat_ws('|', '42', ordinal, pattern, severity, duration, psap_id, strftime(hour_start_utc, '%Y-%m-%d %H:%M:%S'))) AS x FROM sp JOIN fw USING (duration))) WHERE r = 1)"""
_UP, _DOWN = "greatest(ceil(v * (1 + f)), v + 1)", "greatest(0.0, floor(v * (1 - f)))"
_LOW, _BETTER = "least(100.0, greatest(0.0, v * (1 - f)))", "least(100.0, v + (100 - v) * f)"


def _injected(name: str) -> str:
    cases = " ".join(f"WHEN on_ AND pattern = '{p}' THEN {({'up': _UP, 'down': _DOWN if name == 'call_volume' else _LOW, 'improve': _BETTER}[how]).replace('v ', name + ' ').replace(' v)', ' ' + name + ')')}" for p, (targets, how) in kpi.PATTERNS.items() if name in targets)
    return f"(CASE {cases} ELSE {name} END)::DOUBLE AS injected_{name}"


_KPIS = ("call_volume", *kpi.RATES)
C11 = W8 + ", pt AS (SELECT *, " + ", ".join(map(_injected, _KPIS)) + """ FROM (SELECT ordinal, pattern, severity, duration, event_id, c.psap_id, o AS offset_hour, h.hour_start_utc, call_volume, lsr_sr, asr_sr, bid_sr, csr_sr, pattern <> 'flapping' OR o % 2 = 0 AS on_,
    severity * CASE WHEN pattern = 'slow_burn' THEN (o + 1)::DOUBLE / duration ELSE 1 END AS f FROM (SELECT *, unnest(range(0, duration)) AS o FROM ch) c JOIN h ON h.psap_id = c.psap_id AND h.hour_start_utc = c.hour_start_utc + to_hours(o)))"""

QUERIES = {
    "c20_hourly_kpi": (c20_hourly_kpi, _q("SELECT psap_id, hour_start_utc, call_volume, round(lsr_sr, 6) AS lsr_sr, round(asr_sr, 6) AS asr_sr, round(bid_sr, 6) AS bid_sr, round(csr_sr, 6) AS csr_sr FROM h")),
    "p15_quality_issues": (p15_quality_issues, _q("SELECT concat_ws(';', CASE WHEN psap_id = 3 THEN 'INVALID_PSAP_ID' END, CASE WHEN call_volume > 4 THEN 'OUT_OF_RANGE_ASR_SR' END) AS issues, count(*) AS n FROM h GROUP BY 1")),
    "p17_tier_gate": (p17_tier_gate, _q(f"SELECT psap_id, hour_start_utc, {TIER} AS passes FROM (SELECT * REPLACE (call_volume * 4 AS call_volume) FROM h)")),
    "p16_hard_gate": (p16_hard_gate, _q("SELECT CASE WHEN call_volume <= threshold THEN 'SCORE_NOT_ABOVE_THRESHOLD' ELSE 'OK' END AS reason, count(*) AS n FROM s GROUP BY 1", S)),
    "a28_volume_strata": (a28_volume_strata, _q("SELECT psap_id, median_volume, CASE round_even(2.0 * pos / greatest(n - 1, 1), 0) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS stratum FROM (SELECT psap_id, median(call_volume) AS median_volume, row_number() OVER (ORDER BY median(call_volume), psap_id) - 1 AS pos, count(*) OVER () AS n FROM h GROUP BY 1)")),
    "a29_representatives": (a29_representatives, _q("""SELECT stratum, rank, psap_id, median_volume FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY abs(median_volume - mid), psap_id) AS rank FROM (SELECT *, median(median_volume) OVER (PARTITION BY stratum) AS mid FROM
        (SELECT psap_id, median_volume, CASE round_even(2.0 * pos / greatest(n - 1, 1), 0) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS stratum FROM (SELECT psap_id, median(call_volume) AS median_volume, row_number() OVER (ORDER BY median(call_volume), psap_id) - 1 AS pos, count(*) OVER () AS n FROM h GROUP BY 1)))) WHERE rank <= 2""")),
    "a30_multi_head": (a30_multi_head, _q("""SELECT psap_id, hour_start_utc, heads, scored_heads, votes, round(std, 6) AS head_ratio_std, round(votes::DOUBLE / nullif(scored_heads, 0), 6) AS vote_fraction, CASE WHEN NOT valid THEN 'SKIPPED_INVALID_INPUT' WHEN scored_heads = 0 AND NOT detector THEN 'SKIPPED_NO_DETECTOR' WHEN scored_heads = 0 THEN 'SCORING_ERROR' WHEN scored_heads < heads THEN 'SCORED_PARTIAL_HEADS' ELSE 'SCORED' END AS scoring_status FROM
        (SELECT h.psap_id, hour_start_utc, count(*) AS heads, count(r) AS scored_heads, count(*) FILTER (r > 1) AS votes, stddev_pop(r) AS std, bool_and(call_volume <> 5) AS valid, bool_or(dt) AS detector FROM (SELECT h.psap_id, hour_start_utc, call_volume, t.psap_id NOT IN (2, 9, 10) AS dt, CASE WHEN (t.psap_id <> 7 OR call_volume <> 2) AND threshold > 0 AND call_volume <> 5 AND t.psap_id NOT IN (2, 9, 10) THEN call_volume / threshold END AS r FROM h JOIN t ON t.psap_id IN (h.psap_id, (h.psap_id + 1) % 12, (h.psap_id + 5) % 12)) h GROUP BY 1, 2)""", S)),
    "a33_distribution": (a33_distribution, _q("SELECT psap_id, count(*) AS n, round(avg(call_volume), 6) AS mean, round(stddev_pop(call_volume), 6) AS std, min(call_volume) AS min, max(call_volume) AS max, " + ", ".join(f"round(quantile_cont(call_volume, {int(q[1:]) / 100}), 6) AS {q}" for q in health.QUANTILES) + " FROM h GROUP BY 1")),
    "a34_confusion": (a34_confusion, _q("""SELECT psap_id, tp, fp, tn, fn, round(coverage, 6) AS coverage, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(CASE WHEN tp + fp > 0 AND tp + fn > 0 AND tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM
        (SELECT psap_id, count(*) FILTER (truth AND a) AS tp, count(*) FILTER (NOT truth AND a) AS fp, count(*) FILTER (NOT truth AND a IS NOT NULL AND NOT a) AS tn, count(*) FILTER (truth AND (a IS NULL OR NOT a)) AS fn, avg(CASE WHEN a IS NULL THEN 0.0::DOUBLE ELSE 1 END) AS coverage
         FROM (SELECT psap_id, hour(hour_start_utc) BETWEEN 6 AND 8 AS truth, CASE WHEN psap_id % 5 <> 4 THEN alert END AS a FROM s) GROUP BY 1)""", S)),
    "a46_alert_burden": (a46_alert_burden, _q(f"SELECT count(*) AS entity_hours, round(1000 * avg(CASE WHEN alert THEN 1.0::DOUBLE ELSE 0 END), 6) AS raw_per_1000, round(1000 * avg(CASE WHEN alert AND {TIER} THEN 1.0::DOUBLE ELSE 0 END), 6) AS gated_per_1000 FROM s", S)),
    "a47_replay_quality": (a47_replay_quality, _q("SELECT psap_id, count(*) AS hours, min(hour_start_utc) AS first_hour, max(hour_start_utc) AS last_hour, sum(call_volume) AS volume, ((epoch(max(hour_start_utc)) - epoch(min(hour_start_utc))) / 3600 + 1 - count(*))::BIGINT AS missing_hours FROM h GROUP BY 1")),
    "w4_alert_episodes": (w4_alert_episodes, _q("SELECT * FROM ep", EP)),
    "w5_flapping": (w5_flapping, _q("SELECT psap_id, count(*) FILTER (gap > 0 AND gap <= 5400 AND alert <> was) AS transitions, count(*) FILTER (gap > 0 AND gap <= 5400) AS opportunities FROM (SELECT psap_id, alert, lag(alert) OVER w AS was, epoch(hour_start_utc) - epoch(lag(hour_start_utc) OVER w) AS gap FROM s WINDOW w AS (PARTITION BY psap_id ORDER BY hour_start_utc)) GROUP BY 1", S)),
    "w6_isolated": (w6_isolated, _q("SELECT psap_id, count(*) FILTER (alert_hours = 1) AS isolated, count(*) AS episodes FROM ep GROUP BY 1 HAVING count(*) FILTER (alert_hours = 1) >= 2", EP)),
    "w7_windows": (w7_windows, _q("SELECT psap_id, hour_start_utc FROM (SELECT psap_id, hour_start_utc, lead(hour_start_utc, 2) OVER (PARTITION BY psap_id ORDER BY hour_start_utc) AS l FROM h) WHERE l = hour_start_utc + INTERVAL 2 HOUR")),
    "o3_missing_hours": (o3_missing_hours, _q("SELECT g.psap_id, g.hour_start_utc FROM (SELECT psap_id, unnest(generate_series(min(hour_start_utc), max(hour_start_utc), INTERVAL 1 HOUR)) AS hour_start_utc FROM h GROUP BY 1) g ANTI JOIN h USING (psap_id, hour_start_utc)")),
    "w8_chosen_windows": (w8_chosen_windows, _q("SELECT ordinal, pattern, severity, duration::BIGINT AS duration, psap_id, hour_start_utc, event_id FROM ch", W8)),
    "c11_perturbation": (c11_perturbation, _q("SELECT ordinal, pattern, severity, duration::BIGINT AS duration, event_id, psap_id, offset_hour::BIGINT AS offset_hour, hour_start_utc, on_ AS is_active, call_volume, " + ", ".join(f"round({k}, 6) AS {k}" for k in kpi.RATES) + ", "
        + ", ".join(f"round(injected_{k}, 6) AS injected_{k}" for k in _KPIS) + ", " + " OR ".join(f"abs(injected_{k} - {k}) > 1e-12" for k in _KPIS) + " AS has_numeric_change FROM pt", C11)),
    "j17_episode_match": (j17_episode_match, _q("""SELECT event_id, e.psap_id, event_start, event_end, min(episode_start) AS detected_at, CASE WHEN min(episode_start) IS NOT NULL THEN round(greatest(0.0, (epoch(min(episode_start)) - epoch(event_start)) / 3600.0), 6)::DOUBLE END AS delay_hours FROM
        (SELECT DISTINCT psap_id || '-' || strftime(hour_start_utc, '%Y%m%d') AS event_id, psap_id, date_trunc('day', hour_start_utc)::TIMESTAMP + INTERVAL 6 HOUR AS event_start, date_trunc('day', hour_start_utc)::TIMESTAMP + INTERVAL 8 HOUR AS event_end FROM h) e
        LEFT JOIN ep ON ep.psap_id = e.psap_id AND episode_end >= event_start AND episode_start <= event_end + INTERVAL 1 HOUR GROUP BY 1, 2, 3, 4""", EP)),
    "a35_event_recall": (a35_event_recall, _q("""SELECT band, psap_id, count(*) AS events, count(detected_at) AS detected, round(avg(CASE WHEN detected_at IS NULL THEN 0.0::DOUBLE ELSE 1 END), 6) AS recall, round(avg(delay), 6) AS mean_delay FROM
        (SELECT CASE WHEN e.psap_id < 6 THEN 'low' ELSE 'high' END AS band, e.psap_id, event_start, min(episode_start) AS detected_at, CASE WHEN min(episode_start) IS NOT NULL THEN greatest(0.0::DOUBLE, (epoch(min(episode_start)) - epoch(event_start)) / 3600) END AS delay FROM
         (SELECT DISTINCT psap_id, date_trunc('day', hour_start_utc)::TIMESTAMP + INTERVAL 6 HOUR AS event_start, date_trunc('day', hour_start_utc)::TIMESTAMP + INTERVAL 8 HOUR AS event_end FROM h) e
         LEFT JOIN ep ON ep.psap_id = e.psap_id AND episode_end >= event_start AND episode_start <= event_end + INTERVAL 1 HOUR GROUP BY 1, e.psap_id, event_start) GROUP BY ROLLUP (band, psap_id)""", EP)),
    "t21_psi": (t21_psi, _q("SELECT round(sum((s - p) * ln(s / p)), 6) AS psi, max(nr) AS n_reference, max(nc) AS n_current FROM g", H + ", " + _PSI.format(k="1", x="lsr_sr"))),
    "t22_psi_by_entity": (t22_psi_by_entity, _q("SELECT k AS psap_id, round(sum((s - p) * ln(s / p)), 6) AS psi, max(nr) AS n_reference, max(nc) AS n_current FROM g GROUP BY 1", H + ", " + _PSI.format(k="psap_id", x="asr_sr"))),
    "a48_classification": (a48_classification, """WITH t AS (SELECT quality::VARCHAR AS a, CASE WHEN n_chars > 400 THEN '1' ELSE '0' END AS p FROM documents JOIN labels USING (doc_id)), k AS (SELECT DISTINCT a AS k FROM t)
        SELECT sum(support)::BIGINT AS n, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(sum(support * 2.0::DOUBLE * tp / (support + predicted)) / sum(support), 6) AS weighted_f1 FROM (SELECT k, (SELECT count(*) FROM t WHERE a = k) AS support, (SELECT count(*) FROM t WHERE p = k) AS predicted, (SELECT count(*) FROM t WHERE a = k AND p = k) AS tp FROM k)"""),
    "a49_token_counts": (a49_token_counts, "SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS token FROM documents) GROUP BY 1, 2"),
    "a50_input_health": (a50_input_health, "SELECT count(*) AS tickets, round(100 * avg(CASE WHEN trim(coalesce(text, '')) = '' THEN 1.0::DOUBLE ELSE 0 END), 6) AS missing_pct, round(100 * avg(CASE WHEN trim(coalesce(text, '')) <> '' AND length(trim(text)) < 20 THEN 1.0::DOUBLE ELSE 0 END), 6) AS short_pct, round(100 * (1 - count(DISTINCT doc_id)::DOUBLE / count(*)), 6) AS duplicate_pct FROM documents"),
    "a51_prediction_health": (a51_prediction_health, "SELECT count(*) AS n, 100.0::DOUBLE AS coverage_pct, round(avg((doc_id % 100) / 100.0::DOUBLE), 6) AS mean_confidence, round(100 * avg(CASE WHEN doc_id % 100 < 50 THEN 1.0::DOUBLE ELSE 0 END), 6) AS low_confidence_pct FROM documents JOIN labels USING (doc_id)"),
    "t23_text_divergence": (t23_text_divergence, """WITH k AS (SELECT token, count(*) FILTER (r = 0) AS r, count(*) FILTER (r = 1) AS c FROM (SELECT doc_id % 2 AS r, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS token FROM documents) GROUP BY 1),
        s AS (SELECT r::DOUBLE / (SELECT sum(r) FROM k) AS p, c::DOUBLE / (SELECT sum(c) FROM k) AS q FROM k) SELECT round(sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 6) AS js_divergence, round(sum(CASE WHEN p = 0 THEN q ELSE 0 END), 6) AS unseen_rate FROM s"""),
    "c15_classifier_health": (c15_classifier_health, """WITH t AS (SELECT doc_id, quality::VARCHAR AS a, CASE WHEN n_chars > 400 THEN '1' ELSE '0' END AS p, (doc_id % 100) / 100.0::DOUBLE AS c FROM documents JOIN labels USING (doc_id)),
        k AS (SELECT DISTINCT a AS k FROM t), f AS (SELECT (SELECT count(*) FROM t WHERE a = k) AS support, (SELECT count(*) FROM t WHERE p = k) AS predicted, (SELECT count(*) FROM t WHERE a = k AND p = k) AS tp FROM k),
        w AS (SELECT token AS k, count(*) FILTER (r = 0) AS r, count(*) FILTER (r = 1) AS c FROM (SELECT doc_id % 2 AS r, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS token FROM documents) GROUP BY 1), q AS (SELECT p AS k, count(*) FILTER (doc_id % 2 = 0) AS r, count(*) FILTER (doc_id % 2 = 1) AS c FROM t GROUP BY 1),
        ws AS (SELECT r::DOUBLE / (SELECT sum(r) FROM w) AS x, c::DOUBLE / (SELECT sum(c) FROM w) AS y FROM w), qs AS (SELECT r::DOUBLE / (SELECT sum(r) FROM q) AS x, c::DOUBLE / (SELECT sum(c) FROM q) AS y FROM q),
        m AS (SELECT 'ticket_count' AS metric, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'missing_text_rate_pct', 100 * avg(CASE WHEN trim(coalesce(text, '')) = '' THEN 1.0::DOUBLE ELSE 0 END) FROM documents
          UNION ALL SELECT 'short_text_rate_pct', 100 * avg(CASE WHEN trim(coalesce(text, '')) <> '' AND length(trim(text)) < 20 THEN 1.0::DOUBLE ELSE 0 END) FROM documents UNION ALL SELECT 'duplicate_id_rate_pct', 100 * (1 - count(DISTINCT doc_id)::DOUBLE / count(*)) FROM documents
          UNION ALL SELECT 'average_prediction_confidence', avg(c) FROM t UNION ALL SELECT 'low_confidence_rate_pct', 100 * avg(CASE WHEN doc_id % 100 < 60 THEN 1.0::DOUBLE ELSE 0 END) FROM t
          UNION ALL SELECT 'prediction_distribution_jsd', sum((CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2) FROM qs
          UNION ALL SELECT 'token_distribution_jsd', sum((CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2) FROM ws UNION ALL SELECT 'unseen_token_rate_pct', 100 * sum(CASE WHEN x = 0 THEN y ELSE 0 END) FROM ws
          UNION ALL SELECT 'production_accuracy', sum(tp)::DOUBLE / sum(support) FROM f UNION ALL SELECT 'production_weighted_f1', sum(support * 2.0::DOUBLE * tp / (support + predicted)) / sum(support) FROM f),
        l(section, metric, dir, warn, fail) AS (VALUES """ + ", ".join(f"('{s}', '{m}', '{x}', {a}::DOUBLE, {b}::DOUBLE)" for s, own in report.SECTIONS.items() for m, (x, a, b) in own.items()) + """),
        g AS (SELECT section, metric, value, CASE WHEN value IS NULL THEN 'UNKNOWN' WHEN dir = 'high' THEN CASE WHEN round(value, 9) >= fail THEN 'FAIL' WHEN round(value, 9) >= warn THEN 'WARN' ELSE 'PASS' END ELSE CASE WHEN round(value, 9) <= fail THEN 'FAIL' WHEN round(value, 9) <= warn THEN 'WARN' ELSE 'PASS' END END AS status FROM l LEFT JOIN m USING (metric)),
        o AS (SELECT count(DISTINCT section) FILTER (status = 'FAIL') AS failed, bool_or(status = 'WARN') AS warned FROM g)
        SELECT section, metric, round(value, 6) AS value, status, status IN ('WARN', 'FAIL') AS signal, CASE WHEN failed >= 3 THEN 'CRITICAL' WHEN failed >= 1 THEN 'DEGRADED' WHEN warned THEN 'WARNING' ELSE 'HEALTHY' END AS overall, 'PARTIAL' AS collection_status FROM g, o"""),
    "t26_text_challenger": (t26_text_challenger, None),
    "c18_detector_scores": (c18_detector_scores, _q("SELECT psap_id AS head, hour_start_utc, CASE WHEN psap_id NOT IN (5, 7) THEN round(call_volume / m, 6) END AS score, CASE psap_id WHEN 5 THEN 'SCORING_ERROR: ValueError' WHEN 7 THEN 'INVALID_SCORE_OR_THRESHOLD' ELSE 'SCORED' END AS head_status FROM h JOIN (SELECT psap_id, median(call_volume) AS m FROM h GROUP BY 1) USING (psap_id)")),
    "t25_mid_ranks": (t25_mid_ranks, _q("SELECT psap_id, hour_start_utc, rank() OVER (PARTITION BY psap_id ORDER BY call_volume) + (count(*) OVER (PARTITION BY psap_id, call_volume) - 1) / 2.0::DOUBLE AS mid_rank FROM h")),
}
