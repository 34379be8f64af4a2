"""Association of features with a binary target (T1-T13, T15, T20). Values are aggregated before any ranking or pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalize import redact, wilson_lower


def _value_counts(long: DataFrame) -> DataFrame:
    """feature, x, n1, n0: cases and controls at each distinct value, so that ranks run over values, not rows."""
    return long.groupBy("feature", "x").agg(F.sum("target").alias("n1"), F.sum(1 - F.col("target")).alias("n0"))


def below(values: DataFrame, by: list[str], x: str, n: str, name: str = "below", parts: int = 64) -> DataFrame:
    """values with the sum of n over all smaller x of the same group. values: one row for each distinct x.

    Approximate quantiles cut each group into parts; sums run within a part, and each part starts from the sums of those before it.
    So no task needs all values of a group, and the result is exact whatever the cuts.
    """
    keys = by or [F.lit(1).alias("__one")]
    values = values if by else values.withColumn("__one", F.lit(1))
    names = by or ["__one"]
    edges = values.groupBy(*keys).agg(F.percentile_approx(x, F.array(*(F.lit(k / parts) for k in range(1, parts))), 1000).alias("__edges"))
    cut = values.join(F.broadcast(edges), names).withColumn("__part", F.size(F.filter("__edges", lambda e: e < F.col(x)))).drop("__edges")  # parts - 1 numbers a group
    sums = cut.groupBy(*names, "__part").agg(F.sum(n).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(W.partitionBy(*names).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*names, "__part", before.alias("__start"))  # at most `parts` rows a group
    within = F.coalesce(F.sum(n).over(W.partitionBy(*names, "__part").orderBy(x).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("__within", within).join(F.broadcast(starts), [*names, "__part"]).withColumn(name, F.col("__start") + F.col("__within")).drop("__start", "__within", "__part", "__one")


def mann_whitney(long: DataFrame, least: int = 5) -> DataFrame:
    """U, AUC, Cliff's delta and tie-corrected z per feature (T1, T8). long: feature, x, target."""
    v = _value_counts(long.where("x IS NOT NULL"))
    n = F.col("n1") + F.col("n0")
    v = below(v.withColumn("n", n), ["feature"], "x", "n").withColumn("mid", F.col("below") + (n + 1) / 2)
    g = v.groupBy("feature").agg(F.sum("n1").alias("a"), F.sum("n0").alias("b"), F.sum(F.col("mid") * F.col("n1")).alias("rank_sum"), F.sum(n.cast("double") * n * n - n).alias("ties"), F.count("*").alias("levels")).where((F.col("a") >= least) & (F.col("b") >= least) & (F.col("levels") >= 2))
    u = F.col("rank_sum") - F.col("a") * (F.col("a") + 1) / 2
    total = F.col("a") + F.col("b")
    var = F.col("a") * F.col("b") / 12.0 * ((total + 1) - F.col("ties") / (total * (total - 1)))
    g = g.withColumn("u", u).withColumn("auc", u / F.col("a") / F.col("b")).withColumn("z", (u - F.col("a") * F.col("b") / 2) / F.sqrt(var))
    return g.select("feature", F.col("a").alias("cases"), F.col("b").alias("controls"), "u", "auc", (2 * F.col("auc") - 1).alias("cliffs_delta"), "z")


def weighted_auc(long: DataFrame) -> DataFrame:
    """Weighted AUC and strength 2 x |AUC - 1/2| per feature (T8). long: feature, x, target, weight."""
    v = long.where("x IS NOT NULL").groupBy("feature", "x").agg(F.sum(F.when(F.col("target") == 1, F.col("weight")).otherwise(0.0)).alias("w1"), F.sum(F.when(F.col("target") == 0, F.col("weight")).otherwise(0.0)).alias("w0"))
    g = below(v, ["feature"], "x", "w0").groupBy("feature").agg(F.sum(F.col("w1") * (F.col("below") + F.col("w0") / 2)).alias("u"), F.sum("w1").alias("a"), F.sum("w0").alias("b"))
    auc = F.try_divide("u", F.col("a") * F.col("b"))
    return g.select("feature", auc.alias("auc"), (2 * F.abs(auc - 0.5)).alias("strength"))


def standardized_difference(long: DataFrame) -> DataFrame:
    """Means, standardized mean difference and point-biserial correlation per feature."""
    c, k = F.when(F.col("target") == 1, F.col("x")), F.when(F.col("target") == 0, F.col("x"))
    g = long.groupBy("feature").agg(F.avg(c).alias("case_mean"), F.avg(k).alias("control_mean"), F.sqrt((F.var_samp(c) + F.var_samp(k)) / 2).alias("__s"), F.corr(F.col("x"), F.col("target").cast("double")).alias("r_pb"))
    return g.select("feature", "case_mean", "control_mean", F.try_divide(F.col("case_mean") - F.col("control_mean"), F.col("__s")).alias("smd"), "r_pb")


def cramers_v(long: DataFrame, most_levels: int = 100) -> DataFrame:
    """Chi-square and bias-corrected Cramer's V per feature; levels beyond the commonest become <OTHER_RARE> (T4). long: feature, value, target."""
    counts = long.groupBy("feature", F.coalesce("value", F.lit("<MISSING>")).alias("value")).agg(F.count("*").alias("n"), F.sum("target").alias("n1"))
    rank = F.row_number().over(W.partitionBy("feature").orderBy(F.desc("n"), "value"))
    rows = counts.withColumn("value", F.when(rank <= most_levels, F.col("value")).otherwise("<OTHER_RARE>")).groupBy("feature", "value").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    w = W.partitionBy("feature")
    t = rows.withColumn("all_n", F.sum("n").over(w)).withColumn("all_1", F.sum("n1").over(w))
    share = F.col("n1") * F.col("n1") / (F.col("n") * F.col("all_1") / F.col("all_n")) + (F.col("n") - F.col("n1")) * (F.col("n") - F.col("n1")) / (F.col("n") * (F.col("all_n") - F.col("all_1")) / F.col("all_n"))
    g = t.groupBy("feature").agg((F.sum(share) - F.max("all_n")).alias("chi2"), F.count("*").alias("k"), F.max("all_n").alias("n")).where("k >= 2")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / F.col("n") - (F.col("k") - 1) / (F.col("n") - 1))
    kc, rc = F.col("k") - (F.col("k") - 1) * (F.col("k") - 1) / (F.col("n") - 1), F.lit(2.0) - F.lit(1.0) / (F.col("n") - 1)
    return g.select("feature", F.col("k").alias("levels"), "n", "chi2", F.sqrt(F.try_divide(phi, F.least(kc, rc) - 1)).alias("cramers_v"))


def level_rates(long: DataFrame, least: int = 5) -> DataFrame:
    """Rate, smoothed rate ratio and Wilson bound per feature level."""
    total = long.groupBy("feature").agg(F.sum("target").alias("t1"), F.count("*").alias("t"))
    g = long.groupBy("feature", F.coalesce("value", F.lit("<MISSING>")).alias("value")).agg(F.count("*").alias("calls"), F.sum("target").alias("cases")).where(F.col("calls") >= least).join(F.broadcast(total), "feature")
    smooth = lambda k, n: (k + 0.5) / (n + 1)
    rest = smooth(F.col("t1") - F.col("cases"), F.col("t") - F.col("calls"))
    return g.select("feature", "value", "calls", "cases", (F.col("cases") / F.col("calls")).alias("rate"), (smooth(F.col("cases"), F.col("calls")) / rest).alias("rate_ratio"), wilson_lower(F.col("cases"), F.col("calls")).alias("wilson"))


def benjamini_hochberg(tests: DataFrame, p: str = "p") -> DataFrame:
    """tests with q: running minimum of p x m / rank from the largest p (T3, W9). Tests are one row per feature."""
    m = F.count(p).over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(F.col(p), *[c for c in tests.columns if c != p]))
    rows = tests.where(F.col(p).isNotNull()).withColumn("__r", rank).withColumn("__q", F.col(p) * m / F.col("__r"))
    return rows.withColumn("q", F.least(F.lit(1.0), F.min("__q").over(W.orderBy("__r").rowsBetween(0, W.unboundedFollowing)))).drop("__r", "__q")


def average_precision(scored: DataFrame) -> DataFrame:
    """Average precision and ROC AUC of (score, target), equal scores as one step."""
    v = scored.groupBy("score").agg(F.sum("target").alias("p"), F.count("*").alias("n"))
    total = scored.agg(F.sum("target").alias("all_p"), F.count("*").alias("all_n"))
    v = below(below(v, [], "score", "p", "__p"), [], "score", "n", "__n").crossJoin(F.broadcast(total))  # one row
    c = v.withColumn("tp", F.col("all_p") - F.col("__p")).withColumn("k", F.col("all_n") - F.col("__n"))
    auc = F.sum(((F.col("n") - F.col("p")) * (F.col("tp") - F.col("p") / 2)))
    return c.agg(F.sum(F.col("p") / F.col("all_p") * F.col("tp") / F.col("k")).alias("average_precision"), (auc / F.max("all_p") / F.max(F.col("all_n") - F.col("all_p"))).alias("roc_auc"))


def terms(docs: DataFrame, text: str, least_docs: int = 20, alpha: float = 0.5) -> DataFrame:
    """Documents with each 1- and 2-gram among cases and controls, chi-square and log odds of redacted text (T12). docs: row id, text, target."""
    tokens = F.regexp_extract_all(F.lower(redact(F.col(text))), F.lit("([a-z0-9_]{2,})"))
    t = docs.select("target", tokens.alias("t"))
    two = F.when(F.size("t") > 1, F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat(F.element_at("t", i), F.lit(" "), F.element_at("t", i + 1)))).otherwise(F.array().cast("array<string>"))
    grams = t.select("target", F.explode(F.array_distinct(F.concat("t", two))).alias("term"))
    total = docs.agg(F.sum("target").alias("n1"), F.count("*").alias("n"))
    g = grams.groupBy("term").agg(F.sum("target").alias("a"), F.count("*").alias("df")).where(F.col("df") >= least_docs).crossJoin(F.broadcast(total))
    a, df, n, n1 = (F.col(x).cast("double") for x in ("a", "df", "n", "n1"))  # chi-square is a product of five counts, beyond 64 bits for some 10 000 documents a class
    b, c, d = df - a, n1 - a, n - n1 - (df - a)
    spread = df * (n - df) * n1 * (n - n1)
    chi2 = F.when(spread == 0, float("nan")).otherwise(n * (a * d - b * c) * (a * d - b * c) / spread)  # a term of all documents, or one class alone
    return g.select("term", F.col("a").alias("case_docs"), "df", chi2.alias("chi2"), (F.log((a + alpha) / (c + alpha)) - F.log((b + alpha) / (d + alpha))).alias("log_odds"))


def quantile_bins(long: DataFrame, bins: int = 10) -> DataFrame:
    """feature, value (number of the quantile bin), target of each non-null x; equal edges collapse."""
    known = long.where("x IS NOT NULL")
    edges = known.groupBy("feature").agg(F.array_distinct(F.percentile("x", F.array(*(F.lit(i / bins) for i in range(1, bins))))).alias("__e"))
    binned = known.join(F.broadcast(edges), "feature")  # one row of at most bins - 1 numbers per feature
    return binned.select("feature", F.size(F.filter("__e", lambda e: e < F.col("x"))).cast("string").alias("value"), "target")


def mutual_information(long: DataFrame) -> DataFrame:
    """Mutual information in nats of value and target per feature, and its share of the mean entropy (T9, T10). Null values count as a level; a constant gives nmi 0."""
    cells = long.groupBy("feature", F.coalesce("value", F.lit("<MISSING>")).alias("v"), "target").agg(F.count("*").cast("double").alias("n"))
    of = lambda *by: F.sum("n").over(W.partitionBy("feature", *by))
    cells = cells.withColumns({"t": of(), "nv": of("v"), "nt": of("target")})
    # a level's or class's -p ln p is spread over its cells, so that one grouping sums all three
    h = lambda m: -F.col("n") / F.col("t") * F.log(F.col(m) / F.col("t"))
    mi = F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nv") * F.col("nt"))))
    g = cells.groupBy("feature").agg(F.max("t").cast("long").alias("n"), mi.alias("mi"), F.sum(h("nv")).alias("__hv"), F.sum(h("nt")).alias("__ht"))
    total = F.col("__hv") + F.col("__ht")
    return g.select("feature", "n", "mi", F.when(total > 0, 2 * F.col("mi") / total).otherwise(0.0).alias("nmi"))


def weighted_levels(long: DataFrame, prior_weight: float = 20.0) -> DataFrame:
    """Weighted rate, rate smoothed towards the prevalence, lift and Wilson bound of each level (A27). long: feature, value, target, weight."""
    w, k = F.sum("weight"), F.sum(F.col("weight") * F.col("target"))
    g = long.groupBy("feature", F.coalesce("value", F.lit("<MISSING>")).alias("value")).agg(F.count("*").alias("n"), F.sum("target").alias("cases"), w.alias("w"), k.alias("k"))
    prior = g.groupBy("feature").agg((F.sum("k") / F.sum("w")).alias("prior"))
    out = g.join(F.broadcast(prior), "feature")  # one row per feature
    rate = F.col("k") / F.col("w")
    return out.select("feature", "value", "n", "cases", rate.alias("rate"), ((F.col("k") + prior_weight * F.col("prior")) / (F.col("w") + prior_weight)).alias("smoothed"), F.try_divide(rate, F.col("prior")).alias("lift"), wilson_lower(F.col("cases").cast("double"), F.col("n").cast("double")).alias("wilson"))


def weighted_missingness(long: DataFrame) -> DataFrame:
    """Weighted share of missing values among cases and controls, and the difference."""
    gone = (F.col("value").isNull() | (F.trim("value") == "")).cast("double")
    share = lambda t: F.try_divide(F.sum(F.when(F.col("target") == t, F.col("weight") * gone)), F.sum(F.when(F.col("target") == t, F.col("weight"))))
    return long.groupBy("feature").agg(share(1).alias("case_missing"), share(0).alias("control_missing")).withColumn("difference", F.col("case_missing") - F.col("control_missing"))


def association_master(parts: dict[str, DataFrame], strength: str, shortlist: int = 2) -> DataFrame:
    """kind, feature, strength, rank within the kind and whether it is on the shortlist (T13). One row per feature, so the windows are small."""
    out = None
    for kind, df in parts.items():
        part = df.select(F.lit(kind).alias("kind"), "feature", F.col(strength).alias("strength"))
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy(F.desc(F.round("strength", 9)), "feature")))
    return out.withColumn("shortlisted", F.col("rank") <= shortlist)


def case_control_sample(rows: DataFrame, key: str, most_cases: int = 20_000, most_controls: int = 40_000, ratio: int = 3, seed: str = "42") -> DataFrame:
    """Cases and controls least by hash of key and seed, capped, at most ratio controls a case, with inverse-rate weights.

    The caps are the operator's purpose. Each class is a distributed top-k, so no class is sorted in one task; rows of one key tie by the key.
    """
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)))
    n = {r.target: r.n for r in rows.where("target IN (0, 1)").groupBy("target").agg(F.count("*").alias("n")).collect()}  # two numbers
    cases = min(n.get(1, 0), most_cases)
    take = {1: cases, 0: min(n.get(0, 0), most_controls, ratio * cases)}
    part = lambda t: rows.where(F.col("target") == t).withColumn("__h", h).orderBy("__h", key).limit(take[t]).drop("__h").withColumn("weight", F.lit(n.get(t, 0) / max(take[t], 1)))
    return part(1).unionByName(part(0))
