"""Queries over feature association with a binary target, bound to order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assoc, report, screen
from ..operators.rca import long_form
from ..sources.tables import table
from .common import tidy

CATEGORIES, NUMBERS = ["l_returnflag", "l_linestatus", "ship_month"], ["l_quantity", "l_tax", "l_extendedprice"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("target", (F.col("l_discount") > 0.05).cast("bigint")).withColumn("ship_month", F.month("l_shipdate"))


def categorical(spark, d):
    return long_form(lines(spark, d), CATEGORIES, ["target"])


def numeric(spark, d):
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in NUMBERS)))
    return lines(spark, d).select("target", pairs.alias("p")).select("p.feature", "p.x", "target")


BASE = "b AS (SELECT *, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS target, month(l_shipdate) AS ship_month FROM lineitem)"
CAT = BASE + ", c AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::VARCHAR AS value, target FROM b" for f in CATEGORIES) + ")"
_X = "x AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS x, target FROM b" for f in NUMBERS) + ")"
NUM, BOTH = f"{BASE}, {_X}", f"{CAT}, {_X}"


def t1_mann_whitney(spark, d):
    return tidy(assoc.mann_whitney(numeric(spark, d)))


def t2_standardized_difference(spark, d):
    return tidy(assoc.standardized_difference(numeric(spark, d)))


def t3_benjamini_hochberg(spark, d):
    tests = numeric(spark, d).groupBy("feature").agg((F.avg("x") % 1).alias("p"))
    more = categorical(spark, d).groupBy(F.concat_ws("=", "feature", "value").alias("feature")).agg(F.avg("target").alias("p"))
    return tidy(assoc.benjamini_hochberg(more.unionByName(tests).select("feature", F.round("p", 9).alias("p"))))


def t4_cramers_v(spark, d):
    return tidy(assoc.cramers_v(categorical(spark, d)))


def t5_level_rates(spark, d):
    return tidy(assoc.level_rates(categorical(spark, d)))


def t12_terms(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("target", F.col("toxic").cast("bigint"))
    return tidy(assoc.terms(docs, "text"))


def t20_average_precision(spark, d):
    return tidy(assoc.average_precision(lines(spark, d).select(F.col("l_quantity").alias("score"), "target")))


def p13_feature_profile(spark, d):
    g = categorical(spark, d).unionByName(numeric(spark, d).select("feature", F.col("x").cast("string").alias("value"), "target")).groupBy("feature")
    return tidy(g.agg(F.count("*").alias("n"), F.count("value").alias("non_null"), F.count_distinct("value").alias("levels"), F.avg(F.col("value").try_cast("double").isNotNull().cast("double")).alias("numeric_rate")))


def t15_chronological_split(spark, d):
    from pyspark.sql import Window as W

    days = lines(spark, d).groupBy("l_shipdate").agg(F.count("*").alias("n"), F.sum("target").alias("cases"))
    w = W.orderBy("l_shipdate").rowsBetween(W.unboundedPreceding, -1)  # over days, not rows
    total = days.agg(F.sum("n").alias("t"))
    f = F.coalesce(F.sum("n").over(w), F.lit(0)) / F.col("t")
    rows = days.crossJoin(F.broadcast(total)).withColumn("part", F.when(f < 0.70, "train").when(f < 0.85, "validation").otherwise("test"))
    return tidy(rows.groupBy("part").agg(F.sum("n").alias("rows_"), F.sum("cases").alias("cases"), F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day")))


def t20_top_shares(spark, d):
    return tidy(report.top_shares(lines(spark, d).select(F.col("l_quantity").cast("double").alias("score"), "target")))


def t8_weighted_auc(spark, d):
    rows = lines(spark, d).withColumn("weight", F.when(F.col("l_linestatus") == "O", 2.0).otherwise(0.5))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in NUMBERS)))
    return tidy(assoc.weighted_auc(rows.select("target", "weight", pairs.alias("p")).select("p.feature", "p.x", "target", "weight")))


def p13_feature_inventory(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(
        "o_orderkey", "o_orderdate", F.col("o_custkey").alias("CELL_X"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 1000 == 0, "a").alias("seldom"),
        F.when(F.col("o_orderkey") % 2 == 0, "one").otherwise("two").alias("pair"), F.concat(F.lit("a rather long text about "), F.col("o_orderkey").cast("string")).alias("words"), F.col("o_orderpriority").alias("STATUS_TEXT"), F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("code"),
    )
    return tidy(report.feature_inventory(rows, ("CELL",), ("ORDERKEY",), ("_TEXT",)).drop("average_length"))


def _parts(spark, d):
    rows = lines(spark, d).select("target", F.lit(1.0).alias("weight"), *NUMBERS, "l_returnflag", "l_linestatus", F.concat_ws(" ", "l_returnflag", F.col("l_shipdate").cast("string")).alias("note"), F.xxhash64("l_orderkey", "l_linenumber").alias("__row"))
    part = F.pmod("__row", F.lit(10))
    return rows.where(part < 6), rows.where((part >= 6) & (part < 8)), rows.where(part >= 8)


def t17_baseline_and_forest(spark, d):
    return tidy(screen.baseline_and_forest(*_parts(spark, d), NUMBERS, ["l_returnflag", "l_linestatus"], ["note"], trees=20, depth=6))


def t19_permutation_importance(spark, d):
    from pyspark.ml import Pipeline

    train, _, test = (screen.filled(x, NUMBERS, ["l_returnflag"]) for x in _parts(spark, d))
    model = Pipeline(stages=[*screen.preparation(NUMBERS, ["l_returnflag"]), screen.logistic()]).fit(train)
    return tidy(screen.permutation_importance(model, test, ["l_quantity", "l_returnflag"], repeats=2))


def _weighted(spark, d):
    """Cases weigh 1 and controls 3; a seventh of the return flags is missing."""
    rows = lines(spark, d).withColumn("l_returnflag", F.when(F.col("l_partkey") % 7 != 0, F.col("l_returnflag"))).withColumn("weight", F.when(F.col("target") == 1, 1.0).otherwise(3.0))
    return long_form(rows, CATEGORIES, ["target", "weight"])


def t9_mutual_information(spark, d):
    return tidy(assoc.mutual_information(assoc.quantile_bins(numeric(spark, d))).drop("nmi"))


def t10_normalized_information(spark, d):
    return tidy(assoc.mutual_information(categorical(spark, d)))


def t11_weighted_missingness(spark, d):
    return tidy(assoc.weighted_missingness(_weighted(spark, d)))


def a27_weighted_levels(spark, d):
    return tidy(assoc.weighted_levels(_weighted(spark, d)))


def t13_association_master(spark, d):
    parts = {"categorical": assoc.mutual_information(categorical(spark, d)), "numeric": assoc.mutual_information(assoc.quantile_bins(numeric(spark, d)))}
    return tidy(assoc.association_master(parts, "mi"))


def _sampled(spark, d):
    rows = lines(spark, d).withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return assoc.case_control_sample(rows, "key")


def t14_case_control_sample(spark, d):
    return tidy(_sampled(spark, d).select("key", "target", "weight"))


def t16_screening_models(spark, d):
    """Models of heavily discounted lines, on the sample of T14, with a fifth of the keys held out."""
    s = _sampled(spark, d).select("key", "target", "weight", "l_returnflag", "l_linestatus", *NUMBERS)
    held = F.crc32("key") % 5 == 0
    return tidy(screen.screen(s.where(~held), s.where(held), NUMBERS, ["l_returnflag", "l_linestatus"]))


def _q(select: str, ctes: str) -> str:
    return f"WITH {ctes} {select}"


_BIN = "nb AS (SELECT feature, len(list_filter(e, lambda z: z < x))::VARCHAR AS value, target FROM x JOIN (SELECT feature, list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM x GROUP BY 1) USING (feature) WHERE x IS NOT NULL)"
_INF = """{c} AS (SELECT feature, value, target, count(*)::DOUBLE AS k FROM {t} GROUP BY 1, 2, 3),
  {i} AS (SELECT feature, n, mi, CASE WHEN hv + ht > 0 THEN 2 * mi / (hv + ht) ELSE 0 END AS nmi FROM (SELECT feature, max(t)::BIGINT AS n, sum(k / t * ln(k * t / (nv * nt))) AS mi, -sum(k / t * ln(nv / t)) AS hv, -sum(k / t * ln(nt / t)) AS ht FROM
    (SELECT feature, k, sum(k) OVER (PARTITION BY feature) AS t, sum(k) OVER (PARTITION BY feature, value) AS nv, sum(k) OVER (PARTITION BY feature, target) AS nt FROM {c}) GROUP BY 1))"""
_WT = BASE + ", wt AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {'CASE WHEN l_partkey % 7 <> 0 THEN l_returnflag END' if f == 'l_returnflag' else f + '::VARCHAR'} AS value, target, CASE WHEN target = 1 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END AS weight FROM b" for f in CATEGORIES) + ")"

QUERIES = {
    "t1_mann_whitney": (t1_mann_whitney, _q("""SELECT feature, a::BIGINT AS cases, b::BIGINT AS controls, u, round(u / a / b, 6) AS auc, round(2 * u / a / b - 1, 6) AS cliffs_delta, round((u - a * b / 2) / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))), 6) AS z FROM
        (SELECT feature, sum(n1)::DOUBLE AS a, sum(n - n1)::DOUBLE AS b, sum(mid * n1)::DOUBLE - sum(n1)::DOUBLE * (sum(n1)::DOUBLE + 1) / 2 AS u, sum(n::DOUBLE * n * n - n) AS ties FROM
         (SELECT *, coalesce(sum(n) OVER (PARTITION BY feature ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + (n + 1) / 2.0::DOUBLE AS mid FROM (SELECT feature, x, count(*) AS n, sum(target) AS n1 FROM x GROUP BY 1, 2)) GROUP BY 1)""", NUM)),
    "t2_standardized_difference": (t2_standardized_difference, _q("SELECT feature, round(avg(x) FILTER (target = 1), 6) AS case_mean, round(avg(x) FILTER (target = 0), 6) AS control_mean, round((avg(x) FILTER (target = 1) - avg(x) FILTER (target = 0)) / sqrt((var_samp(x) FILTER (target = 1) + var_samp(x) FILTER (target = 0)) / 2), 6) AS smd, round(corr(x, target), 6) AS r_pb FROM x GROUP BY 1", NUM)),
    "t3_benjamini_hochberg": (t3_benjamini_hochberg, _q("""SELECT feature, round(p, 6) AS p, round(least(1.0, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM (SELECT feature, p, row_number() OVER (ORDER BY p, feature) AS r, count(*) OVER () AS m FROM
        (SELECT feature, round(p, 9) AS p FROM (SELECT feature || '=' || value AS feature, avg(target) AS p FROM c GROUP BY 1 UNION ALL SELECT feature, avg(x) % 1 FROM x GROUP BY 1)))""", BOTH)),
    "t4_cramers_v": (t4_cramers_v, _q("""SELECT feature, k AS levels, n, round(chi2, 6) AS chi2, round(sqrt(greatest(0, chi2 / n - (k - 1.0::DOUBLE) / (n - 1)) / (least(k - (k - 1.0::DOUBLE) * (k - 1) / (n - 1), 2 - 1.0::DOUBLE / (n - 1)) - 1)), 6) AS cramers_v FROM
        (SELECT feature, count(*) AS k, max(t)::BIGINT AS n, sum(n1 * n1 / (n * t1 / t) + (n - n1) * (n - n1) / (n * (t - t1) / t)) - max(t) AS chi2 FROM (SELECT feature, n::DOUBLE AS n, n1::DOUBLE AS n1, sum(n) OVER (PARTITION BY feature)::DOUBLE AS t, sum(n1) OVER (PARTITION BY feature)::DOUBLE AS t1 FROM (SELECT feature, value, count(*) AS n, sum(target) AS n1 FROM c GROUP BY 1, 2)) GROUP BY 1)""", CAT)),
    "t5_level_rates": (t5_level_rates, _q("SELECT feature, value, n::BIGINT AS calls, k::BIGINT AS cases, round(k / n, 6) AS rate, round((k + 0.5) / (n + 1) / ((t1 - k + 0.5) / (t - n + 1)), 6) AS rate_ratio, round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt((k / n * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS wilson FROM (SELECT feature, value, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS k, sum(count(*)) OVER (PARTITION BY feature)::DOUBLE AS t, sum(sum(target)) OVER (PARTITION BY feature)::DOUBLE AS t1 FROM c GROUP BY 1, 2) WHERE n >= 5", CAT)),
    "t12_terms": (t12_terms, """WITH d AS (SELECT doc_id, toxic AS target, regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(replace(coalesce(text, ''), 'ß', 'SS')), '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b', ' <IP> ', 'g'), '[A-Z0-9._%+-]+@[A-Z0-9.-]+', ' <URI> ', 'g'), '\\b[0-9A-F]{12,}\\b', ' <HEXID> ', 'g'), '\\b\\d{4,}\\b', ' <NUM> ', 'g')), '[a-z0-9_]{2,}') AS t FROM documents JOIN labels USING (doc_id)),
        g AS (SELECT DISTINCT doc_id, target, term FROM (SELECT doc_id, target, unnest(t) AS term FROM d UNION ALL SELECT doc_id, target, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM d WHERE len(t) > 1)),
        k AS (SELECT term, sum(target)::DOUBLE AS a, count(*)::DOUBLE AS df FROM g GROUP BY 1 HAVING count(*) >= 20), n AS (SELECT sum(target)::DOUBLE AS n1, count(*)::DOUBLE AS n FROM d)
        SELECT term, a::BIGINT AS case_docs, df::BIGINT AS df, round(n * (a * (n - n1 - df + a) - (df - a) * (n1 - a)) * (a * (n - n1 - df + a) - (df - a) * (n1 - a)) / (df * (n - df) * n1 * (n - n1)), 6) AS chi2, round(ln((a + 0.5) / (n1 - a + 0.5)) - ln((df - a + 0.5) / (n - n1 - df + a + 0.5)), 6) AS log_odds FROM k, n"""),
    "t20_average_precision": (t20_average_precision, _q("""SELECT round(sum(p / tp_all * tp / k), 6) AS average_precision, round(sum((n - p) * (tp - p / 2)) / max(tp_all) / (max(n_all) - max(tp_all)), 6) AS roc_auc FROM (SELECT n, p, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER () AS tp_all, sum(n) OVER () AS n_all FROM
        (SELECT l_quantity AS score, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS p FROM b GROUP BY 1) WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))""", BASE)),
    "t20_top_shares": (t20_top_shares, """WITH b AS (SELECT l_quantity::DOUBLE AS score, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS target FROM lineitem), v AS (SELECT score, sum(target) AS p, count(*) AS n FROM b GROUP BY 1),
        c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v), t AS (SELECT sum(target)::DOUBLE AS all_p, count(*)::DOUBLE AS all_n FROM b),
        k AS (SELECT share, ceil(all_n * share) AS cut, all_p, all_n FROM t, (SELECT unnest([0.05::DOUBLE, 0.10::DOUBLE]) AS share)), g AS (SELECT share, cut, all_p, all_n, sum(p * greatest(0.0, least(1.0, (cut - before) / n)))::DOUBLE AS hits FROM k, c GROUP BY ALL)
        SELECT share, cut::BIGINT AS rows, round(hits / cut, 6) AS precision, round(hits / all_p, 6) AS recall, round(hits / cut / (all_p / all_n), 6) AS lift FROM g"""),
    "t8_weighted_auc": (t8_weighted_auc, f"""WITH {NUM.replace("month(l_shipdate) AS ship_month", "month(l_shipdate) AS ship_month, CASE WHEN l_linestatus = 'O' THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS weight").replace(", target FROM b", ", target, weight FROM b")}, v AS (SELECT feature, x, sum(weight) FILTER (target = 1) AS w1, sum(weight) FILTER (target = 0) AS w0 FROM x GROUP BY 1, 2),
        c AS (SELECT feature, coalesce(w1, 0) AS w1, coalesce(w0, 0) AS w0, coalesce(sum(coalesce(w0, 0)) OVER (PARTITION BY feature ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM v)
        SELECT feature, round(auc, 6) AS auc, round(2 * abs(auc - 0.5), 6) AS strength FROM (SELECT feature, sum(w1 * (b + w0 / 2)) / (sum(w1) * sum(w0)) AS auc FROM c GROUP BY 1)"""),
    "p13_feature_inventory": (p13_feature_inventory, """WITH f AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS k, count(DISTINCT o_orderdate) AS dd, count(DISTINCT o_custkey) AS c, count(DISTINCT o_totalprice) AS p, count(DISTINCT o_orderstatus) AS s, count(*) FILTER (o_orderkey % 1000 = 0) AS few, count(DISTINCT o_orderpriority) AS pr FROM orders)
        SELECT 'o_orderkey' AS feature, n AS n_rows, n AS non_null, k AS n_unique, 1.0::DOUBLE AS numeric_ratio, 'UNIQUE_IDENTIFIER' AS inferred_type FROM f UNION ALL SELECT 'o_orderdate', n, n, dd, 0, 'DATETIME' FROM f UNION ALL SELECT 'CELL_X', n, n, c, 1, 'CATEGORICAL_ENTITY' FROM f UNION ALL SELECT 'price', n, n, p, 1, 'NUMERIC' FROM f
        UNION ALL SELECT 'status', n, n, s, 0, 'CATEGORICAL' FROM f UNION ALL SELECT 'seldom', n, few, least(few, 1), 0, CASE WHEN few < 100 THEN 'INSUFFICIENT_DATA' ELSE 'CATEGORICAL' END FROM f UNION ALL SELECT 'pair', n, n, (SELECT count(DISTINCT o_orderkey % 2) FROM orders), 0, 'CATEGORICAL' FROM f
        UNION ALL SELECT 'words', n, n, k, 0, 'TEXT' FROM f UNION ALL SELECT 'STATUS_TEXT', n, n, pr, 0, 'TEXT' FROM f UNION ALL SELECT 'code', n, n, k, 0, CASE WHEN k <= 300 THEN 'CATEGORICAL' ELSE 'HIGH_CARDINALITY' END FROM f"""),
    "t17_baseline_and_forest": (t17_baseline_and_forest, None),
    "t19_permutation_importance": (t19_permutation_importance, None),
    "p13_feature_profile": (p13_feature_profile, _q("SELECT feature, count(*) AS n, count(value) AS non_null, count(DISTINCT value) AS levels, round(avg(CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN 0.0::DOUBLE ELSE 1 END), 6) AS numeric_rate FROM (SELECT feature, value FROM c UNION ALL SELECT feature, x::VARCHAR FROM x) GROUP BY 1", BOTH)),
    "t15_chronological_split": (t15_chronological_split, _q("SELECT part, sum(n)::BIGINT AS rows_, sum(cases)::BIGINT AS cases, min(day) AS first_day, max(day) AS last_day FROM (SELECT *, CASE WHEN f < 0.70 THEN 'train' WHEN f < 0.85 THEN 'validation' ELSE 'test' END AS part FROM (SELECT l_shipdate AS day, count(*) AS n, sum(target) AS cases, coalesce(sum(count(*)) OVER (ORDER BY l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / (SELECT count(*) FROM b) AS f FROM b GROUP BY 1)) GROUP BY 1", BASE)),
    "t9_mutual_information": (t9_mutual_information, _q("SELECT feature, n, round(mi, 6) AS mi FROM inf", f"{NUM}, {_BIN}, {_INF.format(t='nb', c='ce', i='inf')}")),
    "t10_normalized_information": (t10_normalized_information, _q("SELECT feature, n, round(mi, 6) AS mi, round(nmi, 6) AS nmi FROM inf", f"{CAT}, {_INF.format(t='c', c='ce', i='inf')}")),
    "t11_weighted_missingness": (t11_weighted_missingness, _q("SELECT feature, round(a, 6) AS case_missing, round(b, 6) AS control_missing, round(a - b, 6) AS difference FROM (SELECT feature, avg(CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0 END) FILTER (target = 1) AS a, avg(CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0 END) FILTER (target = 0) AS b FROM wt GROUP BY 1)", _WT)),
    "a27_weighted_levels": (a27_weighted_levels, _q(f"""SELECT feature, value, n::BIGINT AS n, k::BIGINT AS cases, round(wk / w, 6) AS rate, round((wk + 20 * prior) / (w + 20), 6) AS smoothed, round(wk / w / prior, 6) AS lift, round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt((k / n * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS wilson FROM
        (SELECT *, sum(wk) OVER (PARTITION BY feature) / sum(w) OVER (PARTITION BY feature) AS prior FROM (SELECT feature, coalesce(value, '<MISSING>') AS value, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS k, sum(weight)::DOUBLE AS w, sum(weight * target)::DOUBLE AS wk FROM wt GROUP BY 1, 2))""", _WT)),
    "t13_association_master": (t13_association_master, _q("SELECT *, rank <= 2 AS shortlisted FROM (SELECT kind, feature, round(mi, 6) AS strength, row_number() OVER (PARTITION BY kind ORDER BY round(mi, 9) DESC, feature) AS rank FROM (SELECT 'categorical' AS kind, feature, mi FROM inf UNION ALL SELECT 'numeric', feature, mi FROM inn))", f"{BOTH}, {_BIN}, {_INF.format(t='c', c='ce', i='inf')}, {_INF.format(t='nb', c='cn', i='inn')}")),
    "t14_case_control_sample": (t14_case_control_sample, _q("""SELECT key, target::BIGINT AS target, round(pop::DOUBLE / CASE target WHEN 1 THEN nc ELSE least(pop, 40000, 3 * nc) END, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5(key || '|42'), key) AS r, count(*) OVER (PARTITION BY target) AS pop FROM
        (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS key, target FROM b)), (SELECT least(20000, sum(target)) AS nc FROM b) WHERE r <= CASE target WHEN 1 THEN nc ELSE least(40000, 3 * nc) END""", BASE)),
    "t16_screening_models": (t16_screening_models, None),
}
