"""Queries over sources, contracts and canonical rows (S1-S15, P1-P14, P21-P23, J1, J3, J4), bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import canonical as C
from ..operators import source_rows
from ..sources import contracts as K
from ..sources import files, tables
from ..sources.tables import table
from . import location as L
from . import monitoring as M
from .common import tidy


def s1_time_window(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderdate", "CALL_DATE")
    return tidy(tables.time_window(o, "1995-01-01", "1995-07-01", ("CALL_BEGIN_TIME_UTC", "CALL_DATE")).select("o_orderkey", F.col("CALL_DATE").cast("date").alias("day")))


def s3_selected_columns(spark, d):
    return tidy(tables.select_existing(table(spark, d, "customer"), ["c_custkey", "no_such", "c_mktsegment", "c_nationkey"]))


def s4_junk_before_header(spark, d):
    """Suppliers in files of two shapes: other junk, another order of columns, a repeated name, rows without values, line breaks and quotes within fields."""
    at = files.scratch(spark, "junk")
    n = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.pmod(F.xxhash64("s_suppkey"), F.lit(4)).alias("file"))
    said = F.concat(F.lit('"'), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('a ""quoted""\n'), "s_name")).otherwise(F.concat("s_name", F.lit(", x"))), F.lit('"'))
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    even = F.col("file") % 2 == 0
    line = F.when(even, F.concat_ws(",", key, said, nation, F.lit("again"))).otherwise(F.concat_ws(",", nation, F.lit("-"), key, said))
    head = F.when(even, "SQL> select\nConnected.\n\nSupp Key,S_NAME,nation-key,SUPPKEY").otherwise("# run 1, 2\nNATION_KEY,NOTE,\"SuppKey\",s name")
    lines = n.select("file", line.alias("value"), F.lit(1).alias("no")).unionByName(n.select("file", head.alias("value"), F.lit(0).alias("no")).distinct()).unionByName(n.select("file", F.lit(",,").alias("value"), F.lit(2).alias("no")).distinct())
    lines.repartition("file").sortWithinPartitions("file", "no").drop("no").write.partitionBy("file").text(at)
    got = tables.read_delimited(spark, at, ["SUPP KEY", "S NAME", "NATION KEY"])
    return tidy(got.select(F.col("SUPP KEY").cast("bigint").alias("k"), F.col("S NAME").alias("name"), F.col("NATION KEY").cast("bigint").alias("nation")))


def s5_csv_rows(spark, d):
    at = files.scratch(spark, "csv")
    files.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), at)
    got = files.read_csv(spark, at, ["s_name", "absent", "s_suppkey"])
    return tidy(got)


def s6_schema_report(spark, d):
    return tidy(K.column_profile(table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment")), ["c_custkey", "c_absent"]))


def s7_file_report(spark, d):
    at = files.scratch(spark, "bundle")
    files.save_bundle({"nation": table(spark, d, "nation"), "region": table(spark, d, "region")}, at)
    return tidy(files.file_report(spark, at, ["nation", "region", "absent"]).select("name", "found", (F.col("bytes") > 0).alias("filled")))


def s8_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = tables.join_chunks(tables.split_chunks(docs, "doc_id", "text", 4000), "doc_id")
    return tidy(back.select("doc_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("md5")))


def s9_export(spark, d):
    at = files.scratch(spark, "export")
    full = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    n, none = files.write_csv(full, f"{at}/full"), files.write_csv(full.where("c_custkey < 0"), f"{at}/none")
    read = lambda name: files.read_csv(spark, f"{at}/{name}", ["c_custkey", "c_mktsegment"])
    sides = [read(name).agg(F.lit(name).alias("part"), F.lit(wrote).cast("bigint").alias("written"), F.count("*").alias("read_back"), F.lit(",".join(read(name).columns)).alias("header")) for name, wrote in (("full", n), ("none", none))]
    return sides[0].unionByName(sides[1])


def s10_manifest(spark, d):
    at = files.scratch(spark, "run")
    kept = {n: table(spark, d, n) for n in ("nation", "customer", "orders")}
    return tidy(files.save_bundle(kept, at).select("name", "n_rows", "n_columns"))


def s11_bundle(spark, d):
    at = files.scratch(spark, "run")
    files.save_bundle({"customer": table(spark, d, "customer"), "nation": table(spark, d, "nation")}, at)
    b = files.load_bundle(spark, at)
    return tidy(b["customer"].join(b["nation"], F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers")))


def s12_collected_source(spark, d):
    at = files.scratch(spark, "source")
    h = M.hourly(spark, d)
    renamed = h.select(F.col("psap_id").alias("Psap-Id"), F.date_format("hour_start_utc", "yyyy-MM-dd HH:mm:ss").alias("RUN TS UTC"), F.col("call_volume").alias("Call_Volume_List"), *(F.col(r).alias(r.upper()) for r in source_rows.RATES))
    files.write_csv(renamed, at)
    raw = files.read_csv(spark, at, renamed.columns)
    return tidy(source_rows.normalize(raw, "2024-01-05", "2024-01-20"))


def _flawed_source(spark, d):
    """Hourly rows as texts under other names, with times, figures and ids that can't be used, half hours, and rates beyond 100."""
    h = M.hourly(spark, d).withColumn("k", F.floor(F.unix_seconds(F.col("hour_start_utc").cast("timestamp")) / 3600) + F.col("psap_id"))
    p, k, at = F.col("psap_id"), F.col("k"), F.date_format("hour_start_utc", "yyyy-MM-dd HH:mm:ss")
    return h.select(
        F.when((k + p) % 31 == 0, "-1").when((k + p) % 37 != 0, p.cast("string")).alias("psap id"), F.when(k % 29 == 0, "rubbish").when(k % 17 == 0, F.regexp_replace(at, ":00:00$", ":30:00")).otherwise(at).alias("EVAL_TS_UTC"),
        F.when(k % 19 == 0, "n/a").when(k % 23 == 0, "-1").otherwise(F.col("call_volume").cast("string")).alias("CALL_VOLUME"), F.col("lsr_sr").alias("LSR_SR_LIST"), (F.col("asr_sr") + F.when(k % 5 == 0, 50).otherwise(0)).alias("ASR_SR"),
        "bid_sr", "csr_sr", F.col("call_volume").alias("ASR_CALLS"), (k % 6).alias("ASR_SUCCESS"),
    )


def c20_source_rows(spark, d):
    return tidy(source_rows.normalize(_flawed_source(spark, d), "2024-01-05", "2024-01-20"))


def c20_source_quality(spark, d):
    return tidy(source_rows.quality(_flawed_source(spark, d), "2024-01-05", "2024-01-20"))


def s14_next_columns(spark, d):
    sources = {n: table(spark, d, n) for n in ("orders", "lineitem", "customer")}
    found = K.next_columns(K.inventory(sources), ["o_orderkey", "L_PARTKEY"], "KEY|DATE").drop("type")
    filled = [K.column_profile(df, []).select(F.lit(n).alias("table"), "column", "filled", "distinct_values") for n, df in sources.items()]
    return tidy(found.join(filled[0].unionByName(filled[1]).unionByName(filled[2]), ["table", "column"]))


def s15_data_dictionary(spark, d):
    meanings = {"o_orderkey": ("call", "orders", "unique"), "o_totalprice": ("price", "orders", "skewed"), "absent": ("none", "none", "none")}
    guide = K.data_dictionary(table(spark, d, "orders"), meanings)
    filled = table(spark, d, "orders").agg(*(F.count(c).alias(c) for c in ("o_orderkey", "o_totalprice"))).unpivot([], ["o_orderkey", "o_totalprice"], "column", "filled")
    return tidy(guide.join(filled, "column"))


def p1_coalesce_existing(spark, d):
    o = table(spark, d, "orders").withColumn("a", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus"))).withColumn("b", F.when(F.col("o_orderkey") % 5 != 0, F.lit("b")))
    return tidy(o.select("o_orderkey", tables.coalesce_existing(o, ["a", "absent", "b"]).alias("value")))


def _time_texts(spark, d):
    at = F.col("o_orderdate").cast("timestamp")
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 3 == 0, F.upper(F.date_format(at, "dd-MMM-yy hh.mm.ss.SSSSSS a"))).when(k % 3 == 1, "rubbish").alias("t1"),
        F.when(k % 2 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).alias("CALL_DATE"), F.when(k % 3 == 0, F.concat(F.upper(F.date_format(at, "dd-MMM-yyyy hh.mm.ss a")), F.lit(" UTC"))).alias("t3"), F.date_format(at, "yyyy-MM-dd").alias("t4"),
    )


def p2_first_time(spark, d):
    t = _time_texts(spark, d)
    return tidy(t.select("o_orderkey", K.first_time(t, ["t1", "absent", "t3", "CALL_DATE"]).alias("call_time")))


def p3_best_time_column(spark, d):
    t = _time_texts(spark, d)
    best = K.best_time_column(t, ["t1", "CALL_DATE", "t4", "t3"])
    return tidy(t.groupBy(F.lit(best).alias("column")).agg(F.count(N.parse_utc(F.col(best))).alias("times")))


def p4_prefixed(spark, d):
    return tidy(K.prefixed(table(spark, d, "nation"), "GMLC__", ["n_nationkey"]))


def p5_aliases(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("Call-ID"), F.col("o_orderstatus").alias("SIP_SIP_METHOD"), F.col("o_custkey").alias("cell"))
    contract = {"call_id": ("callid",), "sip_method": ("SIP_METHOD", "SIP_SIP_METHOD"), "cell_id": ("cell_id", "CELL"), "esrk": ("esrk", "routing_key")}
    return tidy(K.resolve(o, contract, {"esrk": "string"}))


_TESTS = ["y", "0", None, "sim", "n", "TEST"]
_SIMS = ["0", "1", None, "no"]
_TYPES = ["voice", "load test run", None, "TESTER", "psap-sim", "contest"]


def p6_test_tags(spark, d):
    pick = lambda forms: F.element_at(F.array(*(F.lit(x).cast("string") for x in forms)), (F.col("o_orderkey") % len(forms) + 1).cast("int"))
    o = table(spark, d, "orders").select("o_orderkey", pick(_TESTS).alias("TEST_CALL"), pick(_SIMS).alias("PSAP_SIM_CALL"), pick(_TYPES).alias("CALL_TYPE"), F.when(F.col("o_orderkey") % 7 == 0, "Simulated x").alias("ENV"))
    return tidy(C.tag_tests(o).select("o_orderkey", "is_test_or_sim", "reason", "population"))


def p8_distance_band(spark, d):
    s = L.labelled(spark, d).withColumn("hits", F.element_at(F.array(*map(F.lit, ("0", "1", "false", "Y"))), (F.col("call_id") % 4 + 1).cast("int")))
    return tidy(C.distance_band(s, "d_routed", 1000.0, 60000.0, "hits").select("call_id", F.round("d_routed", 2).alias("d_routed")))


def p9_clean_calls(spark, d):
    s = L.calls(spark, d).select("call_id", (F.col("call_id") % 50 == 0).alias("is_test_or_sim"), F.when(F.col("call_id") % 3 != 0, F.col("call_id") % 40 == 1).alias("conflict"))
    return tidy(C.clean_calls(s).select("call_id"))


def p10_last_days(spark, d):
    return tidy(K.last_days(table(spark, d, "events").select("event_id", "ts"), "ts", 7))


def p11_case_target(spark, d):
    s = L.labelled(spark, d)
    got = C.case_target(s, "d_routed", 20000.0, F.when(F.col("expected").isNotNull(), F.col("expected") != F.col("routed")))
    return tidy(got.select("call_id", "target"))


_NAMES = ["GMLC_LATITUDE", "LSR_PSAP_ID", "CTID", "FEATURE_ROW_ID_2", "LATITUDE_NUM", "UNCERT_METERS_NUM", "CALL_DATE", "SIP_STATUS", "GMLC_DR_CNT", "CELL_ID", "X_MISROUTE_Y"]
_ROLES = ["LABEL_OR_GEOMETRY_LEAKAGE", "LABEL_OR_GEOMETRY_LEAKAGE", "TECHNICAL_JOIN_KEY", "TECHNICAL_JOIN_KEY", "LABEL_OR_GEOMETRY_LEAKAGE", "DERIVED_DUPLICATE", "RAW_TIME_KEY", "POST_ROUTING_CONSEQUENCE", "POST_ROUTING_CONSEQUENCE", "PREDICTOR_CANDIDATE", "LABEL_OR_GEOMETRY_LEAKAGE"]


def p12_feature_roles(spark, d):
    named = table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("o_orderkey") % len(_NAMES) + 1).cast("int")).alias("feature"), "o_totalprice")
    return tidy(named.groupBy("feature").agg(F.count("*").alias("n"), F.max("o_totalprice").cast("double").alias("most")).withColumn("role", K.role(F.col("feature"))))


def p14_feature_types(spark, d):
    o = table(spark, d, "orders")
    f = o.select(
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("UNCERT_X"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("7")).otherwise("x").alias("RANGE_Y"), F.col("o_orderstatus").alias("STATUS"),
        F.lit("one").alias("CONSTANT"), F.col("o_custkey").alias("PSAP_ID"), F.col("o_orderdate").cast("string").alias("CALL_DATE"),
    )
    return tidy(K.feature_types(f))


def p21_scored_rows(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    rows = e.select(
        "event_id", F.concat(F.col("user_id").cast("string"), F.when(k % 2 == 0, ".0").otherwise("")).alias("PSAP_ID"), F.col("ts").cast("timestamp_ntz").alias("Hour Start UTC"), F.when(k % 11 != 0, (k % 13).cast("string")).otherwise("n/a").alias("ANOMALY_SCORE"),
        (k % 5).alias("raw_threshold"), F.when(k % 3 == 0, "alert").when(k % 3 == 1, "NO").alias("is_anomaly"), F.when(k % 4 != 0, k % 4 == 1).alias("hard_sanity_pass"), F.lit("PASS").alias("third_level_pass"),
    )
    return tidy(C.scored_rows(rows))


def p22_event_truth(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    rows = e.select(
        F.concat(F.lit("E"), k.cast("string")).alias("injection_id"), (F.col("user_id")).alias("PSAP_ID"), F.col("ts").cast("timestamp_ntz").alias("EVENT_START"), F.when(k % 3 == 0, F.col("ts").cast("timestamp_ntz") + F.expr("INTERVAL 5 HOURS")).alias("end_time"),
        F.when(k % 2 == 0, "2").alias("duration"), F.element_at(F.array(*map(F.lit, ("detect", "benign", "odd"))), (k % 3 + 1).cast("int")).alias("EXPECTED"), F.element_at(F.array(*map(F.lit, ("slow burn", "Flapping"))), (k % 2 + 1).cast("int")).alias("fault_type"),
        F.element_at(F.array(*map(F.lit, ("mild", "2.5", "odd"))), (k % 3 + 1).cast("int")).alias("severity"), F.when(k % 5 == 0, "4").alias("tolerance_hours"),
    )
    return tidy(C.event_truth(rows, 1.0).drop("volume_stratum"))


def p23_row_truth(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    rows = e.select(k.alias("event_id"), F.col("user_id").alias("psap_id"), F.col("ts").cast("timestamp_ntz").alias("timestamp"), F.when(k % 3 == 0, "FAULT").when(k % 3 == 1, "control").alias("expected_behavior"), F.when(k % 7 != 0, k % 2 == 0).alias("is_active"), (k % 5 != 0).alias("has_numeric_change"))
    return tidy(C.row_truth(rows))


def j1_membership(spark, d):
    """A value profile with Y/N membership in two targets."""
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 9 == 0, F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey")).cast("string").alias("raw"))
    g = o.groupBy(N.normalize_id(F.col("raw")).alias("value")).agg(F.min("raw").alias("example"), F.count("*").alias("n"))
    known = table(spark, d, "customer").select(N.normalize_id(F.col("c_custkey")).alias("customer")).distinct()
    big = table(spark, d, "supplier").select(N.normalize_id(F.col("s_suppkey")).alias("supplier")).distinct()
    out = g.join(known, F.col("value") == F.col("customer"), "left").join(big, F.col("value") == F.col("supplier"), "left")
    flag = lambda c: F.when(F.col(c).isNotNull(), "Y").otherwise("N")
    return tidy(out.select("value", "example", "n", flag("customer").alias("in_customer"), flag("supplier").alias("in_supplier")))


def j3_enrichment(spark, d):
    """Orders with aggregates of two sources, one row each."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k1")).agg(F.count("*").alias("ims_rows"), F.sum("l_quantity").alias("ims_quantity"))
    parts = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k2")).agg(F.count_distinct("l_partkey").alias("raw_parts"))
    return tidy(o.join(lines, F.col("o_orderkey") == F.col("k1"), "left").join(parts, F.col("o_orderkey") == F.col("k2"), "left").drop("k1", "k2"))


def j4_semi_prefilter(spark, d):
    """Lines whose order is wanted, before any aggregation of the big source."""
    wanted = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    return tidy(li.join(wanted, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")))


_P = lambda values, key="o_orderkey": f"list_extract([{', '.join('NULL' if v is None else repr(v) for v in values)}], ({key} % {len(values)} + 1)::INTEGER)"

_FLAWED = """q AS (SELECT *, (epoch(hour_start_utc) // 3600 + psap_id)::BIGINT AS k FROM h),
  w AS (SELECT *, CASE WHEN (k + psap_id) % 31 = 0 THEN -1 WHEN (k + psap_id) % 37 <> 0 THEN psap_id END AS p, k % 29 <> 0 AS timed, CASE WHEN k % 19 = 0 THEN NULL WHEN k % 23 = 0 THEN -1 ELSE call_volume END AS v, asr_sr + CASE WHEN k % 5 = 0 THEN 50 ELSE 0 END AS a FROM q),
  x AS (SELECT *, timed AND hour_start_utc >= TIMESTAMP '2024-01-05' AND hour_start_utc < TIMESTAMP '2024-01-20' AS inside FROM w), r AS (SELECT *, inside AND p >= 0 AND v >= 0 AS usable FROM x)"""

QUERIES = {
    "s1_time_window": (s1_time_window, "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1995-07-01'"),
    "s3_selected_columns": (s3_selected_columns, "SELECT c_custkey, c_mktsegment, c_nationkey::BIGINT AS c_nationkey FROM customer"),
    "s4_junk_before_header": (s4_junk_before_header, """SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'a "quoted"' || chr(10) || s_name ELSE s_name || ', x' END AS name, s_nationkey::BIGINT AS nation FROM supplier"""),
    "s5_csv_rows": (s5_csv_rows, "SELECT s_name, s_suppkey::VARCHAR AS s_suppkey FROM supplier"),
    "s6_schema_report": (s6_schema_report, """SELECT 'c_custkey' AS "column", true AS present, true AS required, count(c_custkey) AS filled, count(DISTINCT c_custkey) AS distinct_values FROM customer UNION ALL SELECT 'c_nationkey', true, false, count(c_nationkey), count(DISTINCT c_nationkey) FROM customer
        UNION ALL SELECT 'c_mktsegment', true, false, count(c_mktsegment), count(DISTINCT c_mktsegment) FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'c_absent', false, true, 0, 0"""),
    "s7_file_report": (s7_file_report, "SELECT * FROM (VALUES ('nation', true, true), ('region', true, true), ('absent', false, NULL)) t(name, found, filled)"),
    "s8_chunks": (s8_chunks, "SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n, md5(coalesce(text, '')) AS md5 FROM documents"),
    "s9_export": (s9_export, "SELECT 'full' AS part, count(*) AS written, count(*) AS read_back, 'c_custkey,c_mktsegment' AS header FROM customer UNION ALL SELECT 'none', 0, 0, 'c_custkey,c_mktsegment'"),
    "s10_manifest": (s10_manifest, "SELECT 'nation' AS name, count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE nation)) AS n_columns FROM nation UNION ALL SELECT 'customer', count(*), (SELECT count(*) FROM (DESCRIBE customer)) FROM customer UNION ALL SELECT 'orders', count(*), (SELECT count(*) FROM (DESCRIBE orders)) FROM orders"),
    "s11_bundle": (s11_bundle, "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "s12_collected_source": (s12_collected_source, f"WITH {M.H} SELECT 'BASE-' || lpad((row_number() OVER (ORDER BY hour_start_utc, psap_id) - 1)::VARCHAR, 10, '0') AS evaluation_row_id, psap_id, hour_start_utc, call_volume, round(lsr_sr, 6) AS lsr_sr, round(asr_sr, 6) AS asr_sr, round(bid_sr, 6) AS bid_sr, round(csr_sr, 6) AS csr_sr FROM h WHERE hour_start_utc >= TIMESTAMP '2024-01-05' AND hour_start_utc < TIMESTAMP '2024-01-20'"),
    "c20_source_rows": (c20_source_rows, f"""WITH {M.H}, {_FLAWED} SELECT 'BASE-' || lpad((row_number() OVER (ORDER BY hour_start_utc, p) - 1)::VARCHAR, 10, '0') AS evaluation_row_id, p AS psap_id, hour_start_utc, v AS call_volume, round(lsr_sr, 6) AS lsr_sr, round(least(a, 100.0::DOUBLE), 6) AS asr_sr, round(bid_sr, 6) AS bid_sr, round(csr_sr, 6) AS csr_sr FROM r WHERE usable"""),
    "c20_source_quality": (c20_source_quality, f"""WITH {M.H}, {_FLAWED}, c AS (SELECT count(*) AS source_rows, count(*) FILTER (inside) AS window_rows, count(*) FILTER (usable) AS valid_rows, count(*) FILTER (NOT timed) AS invalid_timestamp_rows, count(*) FILTER (timed AND k % 17 = 0) AS off_hour_rows,
        count(*) FILTER (inside AND v IS NULL) AS nonfinite_kpi_rows, count(*) FILTER (inside AND (p IS NULL OR p = -1)) AS invalid_psap_rows, count(*) FILTER (inside AND v < 0) AS negative_volume_rows, count(*) FILTER (inside AND a > 100) AS clipped_rate_rows,
        count(DISTINCT p) FILTER (usable) AS distinct_psaps, count(DISTINCT hour_start_utc) FILTER (usable) AS observed_hours, 360 AS expected_hours, 0 AS lsr_success_over_calls, count(*) FILTER (usable AND k % 6 > call_volume) AS asr_success_over_calls, 0 AS bid_success_over_calls, 0 AS csr_success_over_calls FROM r)
        SELECT *, expected_hours - observed_hours AS missing_hours, distinct_psaps * expected_hours AS planned_psap_hours, greatest(0, distinct_psaps * expected_hours - valid_rows) AS absent_psap_hours FROM c"""),
    "s14_next_columns": (s14_next_columns, """WITH v AS (SELECT 'orders' AS t, c, count(v) AS filled, count(DISTINCT v) AS distinct_values FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM orders) ON COLUMNS(*) INTO NAME c VALUE v) GROUP BY c UNION ALL SELECT 'lineitem' AS t, c, count(v) AS filled, count(DISTINCT v) AS distinct_values FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM lineitem) ON COLUMNS(*) INTO NAME c VALUE v) GROUP BY c UNION ALL SELECT 'customer' AS t, c, count(v) AS filled, count(DISTINCT v) AS distinct_values FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM customer) ON COLUMNS(*) INTO NAME c VALUE v) GROUP BY c)
        SELECT DISTINCT table_name AS "table", column_name AS "column", ordinal_position::BIGINT AS position, filled, distinct_values FROM information_schema.columns JOIN v ON t = table_name AND c = column_name
        WHERE regexp_matches(upper(column_name), 'KEY|DATE') AND upper(column_name) NOT IN ('O_ORDERKEY', 'L_PARTKEY')"""),
    "s15_data_dictionary": (s15_data_dictionary, "SELECT 'o_orderkey' AS \"column\", 'call' AS meaning, 'orders' AS source, 'unique' AS caution, count(o_orderkey) AS filled FROM orders UNION ALL SELECT 'o_totalprice', 'price', 'orders', 'skewed', count(o_totalprice) FROM orders"),
    "p1_coalesce_existing": (p1_coalesce_existing, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 5 <> 0 THEN 'b' END AS value FROM orders"),
    "p2_first_time": (p2_first_time, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 THEN o_orderdate::TIMESTAMP END AS call_time FROM orders"),
    "p3_best_time_column": (p3_best_time_column, "SELECT 't4' AS \"column\", count(*) AS times FROM orders"),
    "p4_prefixed": (p4_prefixed, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS GMLC__n_name, n_regionkey::BIGINT AS GMLC__n_regionkey FROM nation"),
    "p5_aliases": (p5_aliases, "SELECT o_orderkey AS call_id, o_orderstatus AS sip_method, o_custkey AS cell_id, NULL::VARCHAR AS esrk FROM orders"),
    "p6_test_tags": (p6_test_tags, f"""WITH r AS (SELECT o_orderkey, {_P([True, False, False, True, False, True])} AS t, {_P([False, True, False, False])} AS s, CASE WHEN {_P([False, True, False, False, True, False])} THEN 'CALL_TYPE' WHEN o_orderkey % 7 = 0 THEN 'ENV' END AS x FROM orders)
        SELECT o_orderkey, t OR s OR x IS NOT NULL AS is_test_or_sim, CASE WHEN t AND s THEN 'TEST_CALL+PSAP_SIM_CALL' WHEN t THEN 'TEST_CALL' WHEN s THEN 'PSAP_SIM_CALL' WHEN x IS NOT NULL THEN 'CONTROLLED_TEXT:' || x ELSE 'NONE' END AS reason,
        CASE WHEN t AND s THEN 'TEST_AND_SIM' WHEN t THEN 'TEST' WHEN s THEN 'PSAP_SIM' WHEN x IS NOT NULL THEN 'POSSIBLE_TEST_SIM' ELSE 'STANDARD_OR_UNSPECIFIED' END AS population FROM r"""),
    "p8_distance_band": (p8_distance_band, f"WITH {L.LABELS} SELECT call_id, round(d_routed, 2) AS d_routed FROM l WHERE d_routed BETWEEN 1000 AND 60000 AND call_id % 4 IN (0, 2)"),
    "p9_clean_calls": (p9_clean_calls, "SELECT o_orderkey AS call_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 50 <> 0 AND NOT (o_orderkey % 3 <> 0 AND o_orderkey % 40 = 1)"),
    "p10_last_days": (p10_last_days, "SELECT event_id, ts::TIMESTAMP AS ts FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) + INTERVAL 1 DAY - INTERVAL 7 DAY FROM events)"),
    "p11_case_target": (p11_case_target, f"WITH {L.LABELS} SELECT call_id, CASE WHEN d_routed > 20000 AND expected <> routed THEN 1 ELSE 0 END::BIGINT AS target FROM l WHERE d_routed >= 0 AND (d_routed <= 20000 OR expected IS NOT NULL)"),
    "p12_feature_roles": (p12_feature_roles, f"SELECT {_P(_NAMES)} AS feature, count(*) AS n, max(o_totalprice)::DOUBLE AS most, min({_P(_ROLES)}) AS role FROM orders GROUP BY 1"),
    "p14_feature_types": (p14_feature_types, """SELECT 'UNCERT_X' AS feature, 'PREDICTOR_CANDIDATE' AS role, round(avg(CASE WHEN o_orderkey % 3 <> 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS numeric_share, count(DISTINCT o_custkey) FILTER (o_orderkey % 3 <> 0) AS "values", CASE WHEN avg(CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END) >= 0.5 THEN 'numeric' ELSE 'categorical' END AS type FROM orders
        UNION ALL SELECT 'RANGE_Y', 'PREDICTOR_CANDIDATE', round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END), 6), 2, CASE WHEN avg(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) >= 0.5 THEN 'numeric' ELSE 'categorical' END FROM orders
        UNION ALL SELECT 'STATUS', 'PREDICTOR_CANDIDATE', 0, count(DISTINCT o_orderstatus), 'categorical' FROM orders UNION ALL SELECT 'CONSTANT', 'PREDICTOR_CANDIDATE', 0, 1, NULL"""),
    "p21_scored_rows": (p21_scored_rows, """WITH r AS (SELECT event_id AS k, user_id, ts, CASE WHEN event_id % 11 <> 0 THEN event_id % 13 END::DOUBLE AS s, (event_id % 5)::DOUBLE AS t FROM events)
        SELECT user_id::VARCHAR AS psap, ts::TIMESTAMP AS timestamp, k::VARCHAR AS event, s AS score, t AS threshold, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS explicit_alert, CASE WHEN t > 0 THEN round(s / t, 6) END AS ratio,
        CASE WHEN t > 0 THEN s > t END AS raw_alert, CASE WHEN t > 0 THEN s > t END AND CASE WHEN k % 4 <> 0 THEN k % 4 = 1 END AS sanity_alert FROM r"""),
    "p22_event_truth": (p22_event_truth, """SELECT 'E' || event_id AS event_id, user_id::VARCHAR AS psap, ts::TIMESTAMP AS start, ts::TIMESTAMP + CASE WHEN event_id % 3 = 0 THEN INTERVAL 5 HOUR WHEN event_id % 2 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS "end",
        CASE event_id % 3 WHEN 0 THEN 'DETECT' WHEN 1 THEN 'NO_INCREASE' END AS expected, CASE WHEN event_id % 2 = 0 THEN 'SLOW_BURN' ELSE 'FLAPPING' END AS pattern, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.5 END::DOUBLE AS severity, CASE WHEN event_id % 5 = 0 THEN 4 ELSE 1 END::DOUBLE AS tolerance_hours FROM events"""),
    "p23_row_truth": (p23_row_truth, """SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS psap, ts::TIMESTAMP AS timestamp, event_id % 3 = 0 AND event_id % 7 <> 0 AND event_id % 2 = 0 AND event_id % 5 <> 0 AS should_detect, event_id % 7 <> 0 AND event_id % 2 = 0 AS is_active, event_id % 5 <> 0 AS has_numeric_change FROM events"""),
    "j1_membership": (j1_membership, """SELECT value, min(raw) AS example, count(*) AS n, CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey::VARCHAR = value) THEN 'Y' ELSE 'N' END AS in_customer, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey::VARCHAR = value) THEN 'Y' ELSE 'N' END AS in_supplier
        FROM (SELECT raw, raw AS value FROM (SELECT CASE WHEN o_orderkey % 9 = 0 THEN o_custkey + 1000000 ELSE o_custkey END::VARCHAR AS raw FROM orders)) GROUP BY value"""),
    "j3_enrichment": (j3_enrichment, "SELECT o_orderkey, o_custkey, n AS ims_rows, round(q::DOUBLE, 6) AS ims_quantity, p AS raw_parts FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) a ON a.l_orderkey = o_orderkey LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON b.l_orderkey = o_orderkey"),
    "j4_semi_prefilter": (j4_semi_prefilter, "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity)::DOUBLE, 6) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1"),
}
