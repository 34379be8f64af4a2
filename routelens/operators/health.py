"""Model and text health: drift, distributions, confusion, detection of injected events, text divergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import quantiles

QUANTILES = ("q05", "q25", "q50", "q75", "q95", "q99")


def distribution(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, population deviation, extremes and quantiles of finite values."""
    x = F.when(~F.isnan(F.col(value).cast("double")) & (F.abs(value) < float("inf")), F.col(value).cast("double"))
    marks = [int(q[1:]) / 100 for q in QUANTILES]
    rows = rows.withColumn("__x", x)
    out = rows.groupBy(*by).agg(F.count("__x").alias("n"), F.avg("__x").alias("mean"), F.stddev_pop("__x").alias("std"), F.min("__x").alias("min"), F.max("__x").alias("max"))
    found = quantiles(rows, by, "__x", marks, "__q").withColumnsRenamed({c: f"__{i}" for i, c in enumerate(by)})
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__{i}"))
    return out.join(found, same, "left").select(*by, "n", "mean", "std", "min", "max", *(F.col("__q")[i].alias(q) for i, q in enumerate(QUANTILES)))


def psi(reference: DataFrame, current: DataFrame, value: str, by: list[str], bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability index per group: bins at the reference's distinct deciles, outer ones open; null under 2 rows a side.

    With fewer than three distinct deciles, `bins` equal bins over both ranges, and 0 if those are flat.
    """
    key = by or [F.lit(1).alias("__all")]
    names = by or ["__all"]
    side = lambda df, s: df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*key, F.col(value).cast("double").alias("x"), F.lit(s).alias("s"))
    both = side(reference, 0).unionByName(side(current, 1))
    ref = F.col("s") == 0
    deciles = quantiles(both.where(ref), names, "x", [i / bins for i in range(bins + 1)], "e").withColumn("e", F.array_distinct("e"))
    edges = both.groupBy(*names).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.when(ref, 1)).alias("nr"), F.count(F.when(~ref, 1)).alias("nc")).join(deciles, names, "left")
    equal = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / bins)
    edges = edges.withColumn("e", F.when(F.size("e") < 3, equal).otherwise(F.col("e"))).withColumn("inner", F.slice("e", 2, F.size("e") - 2))
    counts = both.join(F.broadcast(edges) if not by else edges, names).withColumn("bin", F.size(F.filter("inner", lambda b: b <= F.col("x"))))
    counts = counts.groupBy(*names, "bin").agg(F.count(F.when(ref, 1)).alias("r"), F.count(F.when(~ref, 1)).alias("c"))
    share = lambda k, n: F.greatest(F.col(k) / F.col(n), F.lit(floor))
    grid = edges.select(*names, "nr", "nc", "lo", "hi", F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("bin")).join(counts, [*names, "bin"], "left").na.fill(0, ["r", "c"])
    terms = grid.withColumn("t", (share("c", "nc") - share("r", "nr")) * F.log(share("c", "nc") / share("r", "nr")))
    return terms.groupBy(*names).agg(F.when((F.max("nr") >= 2) & (F.max("nc") >= 2), F.when(F.max("hi") == F.max("lo"), 0.0).otherwise(F.sum("t"))).alias("psi"), F.max("nr").alias("n_reference"), F.max("nc").alias("n_current")).select(*by, "psi", "n_reference", "n_current")


def confusion(rows: DataFrame, by: list[str]) -> DataFrame:
    """TP, FP, TN, FN, precision, recall, F1 and coverage of rows with truth and alert; an unscored positive is a miss."""
    truth, alert = F.col("truth"), F.coalesce("alert", F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    out = rows.groupBy(*by).agg(n(truth & alert).alias("tp"), n(~truth & alert).alias("fp"), n(~truth & ~alert & F.col("alert").isNotNull()).alias("tn"), n(truth & ~alert).alias("fn"), F.avg(F.col("alert").isNotNull().cast("double")).alias("coverage"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * p * r, p + r))


def match_episodes(episodes: DataFrame, events: DataFrame, tolerance_hours: float = 0.0) -> DataFrame:
    """The earliest episode that overlaps each event of the same entity, and the delay in hours.

    Episodes and events meet by entity and day, each in the days it touches, so an entity's whole history is never paired with itself.
    """
    s = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    days = lambda lo, hi: F.explode(F.sequence(F.floor(lo / 86_400), F.floor(hi / 86_400)))
    a = episodes.withColumn("day", days(s("episode_start"), s("episode_end"))).alias("a")
    b = events.withColumn("day", days(s("event_start"), F.greatest(s("event_start"), s("event_end") + tolerance_hours * 3600))).alias("b")
    late = s("b.event_end") + tolerance_hours * 3600
    on = (F.col("a.psap_id") == F.col("b.psap_id")) & (F.col("a.day") == F.col("b.day")) & (s("a.episode_end") >= s("b.event_start")) & (s("a.episode_start") <= late)
    hits = b.join(a, on, "left").groupBy("b.event_id", "b.psap_id", "b.event_start", "b.event_end").agg(F.min("a.episode_start").alias("detected_at"))
    return hits.select("event_id", "psap_id", "event_start", "event_end", "detected_at", F.when(F.col("detected_at").isNotNull(), F.greatest(F.lit(0.0), (s("detected_at") - s("event_start")) / 3600)).alias("delay_hours"))


def unmatched_episodes(episodes: DataFrame, events: DataFrame, tolerance_hours: float = 0.0) -> DataFrame:
    """Episodes that detect no event: false positives (J17). An event is detected by the earliest episode that overlaps it."""
    used = match_episodes(episodes, events, tolerance_hours).where("detected_at IS NOT NULL").select("psap_id", F.col("detected_at").alias("episode_start")).distinct()
    return episodes.join(used, ["psap_id", "episode_start"], "left_anti")


def classification(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and support-weighted F1 of trimmed, case-folded labels, from the confusion counts."""
    fold = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    cells = rows.groupBy(fold(actual).alias("a"), fold(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)
    of_actual = cells.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    of_predicted = cells.groupBy(F.col("p").alias("k2")).agg(F.sum("n").alias("predicted"))
    per = of_actual.join(of_predicted, F.col("k") == F.col("k2"), "left").withColumn("f1", 2 * F.col("tp") / (F.col("support") + F.coalesce("predicted", F.lit(0))))
    return per.agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def token_counts(rows: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Occurrences of `[A-Za-z0-9_]+` tokens of lower-cased text."""
    return rows.select(*by, F.explode(F.regexp_extract_all(F.lower(text), F.lit("([A-Za-z0-9_]+)"))).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))


def divergence(reference: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Jensen-Shannon divergence in bits of two count tables (key, n), and the share of current counts unseen in the reference."""
    both = reference.select(key, F.col("n").alias("r")).join(current.select(key, F.col("n").alias("c")), key, "full_outer").na.fill(0, ["r", "c"])
    sums = both.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    p, q = F.col("r") / F.col("nr"), F.col("c") / F.col("nc")
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return both.crossJoin(F.broadcast(sums)).agg(F.sum((part(p) + part(q)) / 2).alias("js_divergence"), F.sum(F.when(F.col("r") == 0, q).otherwise(0.0)).alias("unseen_rate"))


def input_health(rows: DataFrame, text: str, row_id: str, short: int = 20) -> DataFrame:
    """Rows, missing and short text and duplicate ids, in per cent."""
    t = F.trim(F.coalesce(text, F.lit("")))
    pct = lambda c: 100 * F.avg(c.cast("double"))
    return rows.agg(F.count("*").alias("tickets"), pct(t == "").alias("missing_pct"), pct((t != "") & (F.length(t) < short)).alias("short_pct"), (100 * (1 - F.count_distinct(row_id) / F.count("*"))).alias("duplicate_pct"))


def mid_rank(by: list[str], x: str) -> Column:
    """Average rank among ties."""
    return F.rank().over(W.partitionBy(*by).orderBy(x)) + (F.count("*").over(W.partitionBy(*by, x)) - 1) / 2


def worst_of(grades: DataFrame, by: list[str]) -> DataFrame:
    """FAIL over WARN over PASS; UNKNOWN never worsens."""
    rank = F.when(F.col("grade") == "FAIL", 3).when(F.col("grade") == "WARN", 2).when(F.col("grade") == "PASS", 1).otherwise(0)
    return grades.groupBy(*by).agg(F.element_at(F.array(*map(F.lit, ("UNKNOWN", "PASS", "WARN", "FAIL"))), F.max(rank) + 1).alias("overall"))
