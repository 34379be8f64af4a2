"""Exact quantiles by selection against F.percentile."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from routelens.operators import health, quantiles

MARKS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0]


def compare(rows, by):
    want = {tuple(r[c] for c in by): r.q for r in rows.groupBy(*by).agg(F.percentile("x", F.array(*map(F.lit, MARKS))).alias("q"), F.count("x").alias("n")).where("n > 0").collect()}
    got = {tuple(r[c] for c in by): r.q for r in quantiles.quantiles(rows, by, "x", MARKS, "q").collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert all(math.isclose(a, b, rel_tol=1e-12) or (a != a and b != b) for a, b in zip(got[k], want[k], strict=True)), k


def test_as_percentile(spark, monkeypatch):
    rows = [(g, k % 3, float((k * 7919) % 101) ** (1 + k % 3)) for g in ("a", None) for k in range(400)]
    rows += [("one", 0, 4.0), ("two", 0, 1.0), ("two", 0, 2.0), ("none", 0, None), ("flat", 1, 3.0), ("flat", 1, 3.0), ("nan", 2, float("nan")), ("nan", 2, 1.0), ("inf", 2, float("inf")), ("inf", 2, float("-inf")), ("zero", 1, -0.0), ("zero", 1, 0.0)]
    df = spark.createDataFrame(rows, "g string, h int, x double").repartition(5)
    compare(df, ["g", "h"])
    compare(df.where("NOT isnan(x)"), [])
    monkeypatch.setattr(quantiles, "PARTS", 3)
    compare(df, ["g"])
    assert quantiles.quantiles(df.limit(0), ["g"], "x", MARKS).count() == 0


def test_a_large_group_is_not_held_in_one_task(spark):
    """A million distinct values of one group beside a small one: no task of the last window has more than a few parts of the group."""
    n = 1_000_000
    df = spark.range(0, n, 1, 8).select(F.when(F.col("id") % 1000 == 0, "small").otherwise("hot").alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("x"))
    compare(df, ["g"])
    cuts = df.where("g = 'hot'").agg(F.percentile_approx("x", F.array(*(F.lit(k / quantiles.PARTS) for k in range(1, quantiles.PARTS))), quantiles.ACCURACY)).first()[0]
    assert max(b - a for a, b in zip([0, *cuts], [*cuts, n], strict=True)) < n / quantiles.PARTS + 4 * n / quantiles.ACCURACY


def test_bits_are_those_of_sql(spark):
    """A quantile between two equal values may differ from them by a bit, and then a bin's edge is above or below its values."""
    draw = random.Random(1)
    rows = [(g, 100 * draw.randint(0, m) / m) for g in range(40) for m in (draw.randint(1, 12) for _ in range(15 + g))]
    got = quantiles.quantiles(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", [k / 10 for k in range(11)], "q").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g INT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    assert {r.g: r.q for r in got} == dict(con.execute("SELECT g, quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FROM t GROUP BY 1").fetchall())


@pytest.mark.parametrize("by", [["g"], []])
def test_distribution_of_groups(spark, by):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", float("inf")), (None, 3.0), ("b", None)], "g string, v double")
    got = {tuple(r[c] for c in by): (r.n, r.min, r.max, r.q50) for r in health.distribution(rows, "v", by).collect()}
    assert got == ({("a",): (2, 1.0, 2.0, 1.5), (None,): (1, 3.0, 3.0, 3.0), ("b",): (0, None, None, None)} if by else {(): (3, 1.0, 3.0, 2.0)})
