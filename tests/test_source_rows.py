"""Replay sources: what stops a job, and ids over many partitions."""

import pytest
from pyspark.sql import functions as F

from routelens.operators import source_rows

NAMES = "`Hour Start UTC` string, PSAP_ID string, CALL_VOLUME_LIST string, lsr_sr string, asr_sr string, bid_sr string, csr_sr string"


def row(at, psap, volume="5", rate="90"):
    return (at, psap, volume, rate, rate, "101", "-3")


def test_rows_are_clipped_floored_and_numbered(spark):
    raw = spark.createDataFrame([row("2024-01-01 01:30:00", "7"), row("2024-01-01 00:00:00", "9.0"), row("2024-01-01T00:00:00", "7"), row("x", "7"), row("2024-01-01 02:00:00", "a"), row("2024-01-01 02:00:00", "7", "inf"), row("2024-01-01 03:00:00", "7", None)], NAMES)
    got = [(r.evaluation_row_id, r.psap_id, str(r.hour_start_utc), r.bid_sr, r.csr_sr) for r in source_rows.normalize(raw).orderBy("evaluation_row_id").collect()]
    assert got == [("BASE-0000000000", 7, "2024-01-01 00:00:00", 100.0, 0.0), ("BASE-0000000001", 9, "2024-01-01 00:00:00", 100.0, 0.0), ("BASE-0000000002", 7, "2024-01-01 01:00:00", 100.0, 0.0)]
    q = source_rows.quality(raw).first()
    assert (q.source_rows, q.window_rows, q.valid_rows, q.invalid_timestamp_rows, q.off_hour_rows, q.nonfinite_kpi_rows, q.invalid_psap_rows) == (7, 7, 3, 1, 1, 2, 1)
    assert (q.distinct_psaps, q.observed_hours, q.expected_hours, q.absent_psap_hours) == (2, 2, 4, 5)


def test_two_rows_of_an_hour_stop_the_job(spark):
    raw = spark.createDataFrame([row("2024-01-01 01:30:00", "7"), row("2024-01-01 01:00:00", "7")], NAMES)
    with pytest.raises(Exception, match="two rows of entity 7"):
        source_rows.normalize(raw).collect()


def test_a_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="call_volume"):
        source_rows.normalize(spark.createDataFrame([("2024-01-01", "1")], "EVAL_TS_UTC string, PSAP_ID string"))


def test_empty_source(spark):
    raw = spark.createDataFrame([], NAMES)
    assert source_rows.normalize(raw).collect() == [] and source_rows.quality(raw).first().source_rows == 0


def test_ids_have_no_gaps_over_many_ranges(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("a")).repartition(16)
    got = {r.a: r.n for r in source_rows.numbered(df, ["a"], "%d", "n").collect()}
    assert got == {k: str(k) for k in range(5000)}
