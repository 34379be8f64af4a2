"""Exact quantiles of groups of any size: no group, and no group's distinct values, in one task.

Values are counted first, so repeated ones are one row. An approximate sketch of each group's distinct values, which is small however
large the group, cuts it into parts; prefix sums over the parts' counts tell which part holds each wanted rank, and only those parts
are sorted. The sketch decides which part is sorted, not the result. Counts and parts are written to the shared folder, as they are
read several times and must not change in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import scratch

#: Parts of a group, accuracy of their cuts, and rows that a group's cuts are joined by, so that a hot group is spread over tasks.
PARTS, ACCURACY, SALTS = 256, 10_000, 64


def quantiles(rows: DataFrame, by: list[str], value: str, marks: list[float], name: str = "quantiles") -> DataFrame:
    """by and an array with the quantile of each mark, as F.percentile has them: rank q (n - 1), between two ranks in proportion.

    Proportions are rounded as quantile_cont in SQL rounds them, so that an edge that falls on a value falls on the same side of it there. Null values don't count, and NaN is above all others. A group without values has no row. Null is a group of its own.
    """
    spark, group = rows.sparkSession, F.struct(*(F.col(c) for c in by), F.lit(0).alias("__one")).alias("g")
    at = scratch(spark, "quantiles")

    def written(df: DataFrame, stage: str) -> DataFrame:
        df.write.parquet(f"{at}/{stage}")
        return spark.read.parquet(f"{at}/{stage}")

    counts = written(rows.select(group, F.col(value).cast("double").alias("x")).where("x IS NOT NULL").groupBy("g", "x").agg(F.count("*").alias("n")), "counts")
    cuts = counts.groupBy("g").agg(F.percentile_approx("x", F.array(*(F.lit(k / PARTS) for k in range(1, PARTS))), ACCURACY).alias("cuts"))
    salted = cuts.select("g", F.array_distinct("cuts").alias("cuts"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    part = F.size(F.filter("cuts", lambda c: c < F.col("x")))
    parted = written(counts.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(salted, ["g", "salt"]).select("g", "x", "n", part.alias("part")), "parts")
    sizes = parted.groupBy("g", "part").agg(F.sum("n").alias("rows"))
    up_to = F.sum("rows").over(W.partitionBy("g").orderBy("part"))  # at most PARTS rows
    sizes = sizes.withColumns({"before": up_to - F.col("rows"), "total": F.sum("rows").over(W.partitionBy("g"))})
    rank = F.col("mark") * (F.col("total") - 1)
    asked = sizes.withColumn("m", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("mark")) for i, q in enumerate(marks))))).select("*", "m.*")
    asked = asked.withColumns({"rank": rank, "at": F.explode(F.array(F.floor(rank), F.ceil(rank)))}).where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("rows"))).distinct()
    wanted = asked.groupBy("g", "part").agg(F.min("before").alias("before"), F.collect_set(F.struct("i", "rank", "at")).alias("asked"))  # two ranks a mark
    through = F.sum("n").over(W.partitionBy("g", "part").orderBy("x")) + F.col("before")
    ranked = parted.join(wanted, ["g", "part"]).withColumn("through", through)
    mine = F.filter("asked", lambda a: (a["at"] >= F.col("through") - F.col("n")) & (a["at"] < F.col("through")))
    found = ranked.select("g", "x", F.explode(mine).alias("a")).select("g", "x", "a.*")
    ends = found.groupBy("g", "i").agg(F.min_by("x", "at").alias("low"), F.max_by("x", "at").alias("high"), F.first("rank").alias("rank"))
    share = F.col("rank") - F.floor("rank")
    between = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), F.col("low"), 1 - share, F.col("high") * share).cast("double")  # low (1 - share) isn't rounded by itself
    each = ends.select("g", "i", F.when(share == 0, F.col("low")).otherwise(between).alias("v"))
    out = each.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias(name))
    return out.select(*(F.col(f"g.{c}").alias(c) for c in by), name)
