"""Reconciliation and streaming on the driver tables against deliberately damaged copies of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepframe.operators import reconcile as rc
from stepframe.plans.catalog import query, table
from stepframe.sizing import scratch_path
from stepframe.streaming.batches import read_reports, reconcile_stream
from stepframe.streaming.running import group_reports, reconcile_running

# Orders as a faulty job would write them: some prices off, some rows lost, some rows twice under a new key.
_DAMAGED = """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN o_totalprice + 1 WHEN o_orderpriority = '2-HIGH' THEN o_totalprice + 0.0000001 ELSE o_totalprice END AS o_totalprice
FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'F')
UNION ALL SELECT o_orderkey + 1000000000000, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O'"""
_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def orders_and_damaged(spark, d):
    o = table(spark, d, "orders")
    c, p, s = F.col, F.col("o_orderpriority"), F.col("o_orderstatus")
    price = F.when((p == "1-URGENT") & (s == "P"), c("o_totalprice") + 1).when(p == "2-HIGH", c("o_totalprice") + 0.0000001).otherwise(c("o_totalprice"))
    kept = o.filter(~((p == "5-LOW") & (s == "F"))).select(
        "o_orderkey", "o_custkey", F.when((p == "3-MEDIUM") & (s == "O"), "X").otherwise(s).alias("o_orderstatus"), price.alias("o_totalprice"))
    doubled = o.filter((p == "4-NOT SPECIFIED") & (s == "O")).select((c("o_orderkey") + 1000000000000).alias("o_orderkey"), "o_custkey", "o_orderstatus", "o_totalprice")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), kept.unionByName(doubled)


@query("rc_1_schema_parity", """
SELECT 1 AS seq, 'schema_parity' AS name, 'fail' AS status, 'missing=[''c_mktsegment''], extra=[''segment'']' AS detail, count(*) AS n_rows FROM customer
UNION ALL SELECT 2, 'schema_parity', 'fail', 'c_acctbal: ref=numeric, actual=object', count(*) FROM customer
UNION ALL SELECT 3, 'schema_parity', 'pass', NULL, count(*) FROM customer""")
def rc_1(spark, d):
    c = table(spark, d, "customer")
    variants = [c.withColumnRenamed("c_mktsegment", "segment"), c.withColumn("c_acctbal", F.col("c_acctbal").cast("string")), c.select(*reversed(c.columns)).withColumn("c_nationkey", F.col("c_nationkey").cast("double"))]
    found = None
    for i, variant in enumerate(variants, 1):
        row = rc.reconcile(c, variant).filter("name = 'schema_parity'").withColumn("seq", F.lit(i)).join(F.broadcast(variant.agg(F.count("*").alias("n_rows"))))
        found = row if found is None else found.unionByName(row)
    return found


@query("rc_1_schema_columns", """
SELECT * FROM (VALUES ('c_acctbal', 'numeric', 'object', 'class_mismatch'), ('c_custkey', 'numeric', 'numeric', 'pass'), ('c_mktsegment', 'object', NULL, 'missing'),
  ('c_name', 'object', 'object', 'pass'), ('c_nationkey', 'numeric', 'numeric', 'pass'), ('segment', NULL, 'object', 'extra')) t("column", ref_class, actual_class, status)""")
def rc_1b(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return rc.schema_comparison(c, c.withColumnRenamed("c_mktsegment", "segment").withColumn("c_acctbal", F.col("c_acctbal").cast("string")))


@query("rc_2_row_count", f"""
WITH a AS ({_DAMAGED}) SELECT 'row_count' AS name, CASE WHEN r.n = x.n THEN 'pass' ELSE 'fail' END AS status,
  CASE WHEN r.n <> x.n THEN 'ref=' || r.n || ', actual=' || x.n END AS detail FROM (SELECT count(*) AS n FROM orders) r, (SELECT count(*) AS n FROM a) x""")
def rc_2(spark, d):
    return rc.reconcile(*orders_and_damaged(spark, d)).filter("name = 'row_count'").select("name", "status", "detail")


_LINES_ACTUAL = """
SELECT l_quantity, CASE WHEN l_returnflag = 'R' THEN l_extendedprice * 1.01 ELSE l_extendedprice END AS l_extendedprice,
  CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN NULL ELSE l_discount END AS l_discount FROM lineitem"""
_MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


def lines_and_actual(spark, d):
    line = table(spark, d, "lineitem")
    actual = line.select("l_quantity", F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") * 1.01).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
                         F.when(~((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A")), F.col("l_discount")).alias("l_discount"))
    return line.select(*_MEASURES, "l_tax"), actual


def _parity_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", round(r.s, 2) AS ref_sum, round(a.s, 2) AS actual_sum, round(abs(r.s - a.s) / abs(r.s), 8) AS rel_diff, r.n AS ref_count, a.n AS actual_count,
  round(r.s / r.n, 6) AS ref_avg, round(a.s / a.n, 6) AS actual_avg, CASE WHEN abs(r.s - a.s) / abs(r.s) > 0.001 THEN 'fail' ELSE 'pass' END AS sum_status,
  CASE WHEN r.n <> a.n THEN 'fail' ELSE 'pass' END AS count_status, CASE WHEN abs(r.s / r.n - a.s / a.n) / abs(r.s / r.n) > 0.001 THEN 'fail' ELSE 'pass' END AS avg_status
  FROM (SELECT sum({column}) AS s, count({column}) AS n FROM lineitem) r, (SELECT sum({column}) AS s, count({column}) AS n FROM act) a"""


_PARITY = f"WITH act AS ({_LINES_ACTUAL}) " + " UNION ALL ".join(_parity_sql(c) for c in _MEASURES)


def _rounded_parity(spark, d):
    found = rc.aggregate_comparison(*lines_and_actual(spark, d))
    digits = {"ref_sum": 2, "actual_sum": 2, "rel_diff": 8, "ref_avg": 6, "actual_avg": 6}
    return found.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("rc_3_aggregate_parity", f"""
SELECT "column", ref_sum, actual_sum, rel_diff, sum_status FROM ({_PARITY}) UNION ALL SELECT 'l_tax', NULL, NULL, NULL, 'missing' FROM (SELECT count(*) FROM lineitem)""")
def rc_3(spark, d):
    return _rounded_parity(spark, d).select("column", "ref_sum", "actual_sum", "rel_diff", "sum_status")


# Sums of whole numbers, so that both engines print them alike.
def _whole_numbers(spark, d):
    return [df.select("o_orderkey", "o_custkey", "o_orderstatus") for df in orders_and_damaged(spark, d)]


def _detail_sql(column: str, ref: str, actual: str) -> str:
    return f"""CASE WHEN abs({ref} - {actual}) / abs({ref}) > 0.001 THEN '{column}: ref_sum=' || printf('%.4f', {ref}) || ', actual_sum=' || printf('%.4f', {actual})
      || ', rel_diff=' || printf('%.6f', abs({ref} - {actual}) / abs({ref})) END"""


_WHOLE_SUMS = f"""a AS ({_DAMAGED}), r AS (SELECT sum(CAST(o_orderkey AS DOUBLE)) AS k, sum(CAST(o_custkey AS DOUBLE)) AS c, count(*) AS n FROM orders),
  x AS (SELECT sum(CAST(o_orderkey AS DOUBLE)) AS k, sum(CAST(o_custkey AS DOUBLE)) AS c, count(*) AS n FROM a)"""


@query("rc_4_report", f"""
WITH {_WHOLE_SUMS}, d AS (SELECT CASE WHEN r.n <> x.n THEN 'ref=' || r.n || ', actual=' || x.n END AS rows, nullif(concat_ws('; ', {_detail_sql('o_orderkey', 'r.k', 'x.k')}, {_detail_sql('o_custkey', 'r.c', 'x.c')}), '') AS sums FROM r, x)
SELECT 1 AS seq, 'schema_parity' AS name, 'pass' AS status, NULL AS detail FROM d
UNION ALL SELECT 2, 'row_count', CASE WHEN rows IS NULL THEN 'pass' ELSE 'fail' END, rows FROM d
UNION ALL SELECT 3, 'aggregate_parity', CASE WHEN sums IS NULL THEN 'pass' ELSE 'fail' END, sums FROM d""")
def rc_4(spark, d):
    return rc.reconcile(*_whole_numbers(spark, d))


@query("rc_4_full_report", f"""
WITH {_WHOLE_SUMS}, r1 AS ({_ORDERS}), a1 AS ({_DAMAGED}),
  k AS (SELECT CASE WHEN a1.o_orderkey IS NULL THEN 'missing' WHEN r1.o_orderkey IS NULL THEN 'extra' ELSE 'changed' END AS difference, count(*) AS n FROM r1 FULL JOIN a1 ON r1.o_orderkey = a1.o_orderkey
    WHERE a1.o_orderkey IS NULL OR r1.o_orderkey IS NULL OR r1.o_custkey <> a1.o_custkey OR r1.o_orderstatus <> a1.o_orderstatus GROUP BY 1),
  f AS (SELECT r1.o_orderkey, r1.o_orderstatus AS s FROM r1 JOIN a1 ON r1.o_orderkey = a1.o_orderkey WHERE r1.o_orderstatus <> a1.o_orderstatus ORDER BY 1 LIMIT 3)
SELECT 4 AS seq, 'count_parity' AS name, CASE WHEN r.n = x.n THEN 'pass' ELSE 'fail' END AS status,
  CASE WHEN r.n <> x.n THEN 'o_custkey: ref_count=' || r.n || ', actual_count=' || x.n || '; o_orderkey: ref_count=' || r.n || ', actual_count=' || x.n END AS detail FROM r, x
UNION ALL SELECT 6, 'row_hash', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, string_agg(difference || '=' || n, '; ' ORDER BY difference) FROM k
UNION ALL SELECT 8, 'sample', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, string_agg('o_orderstatus at ' || o_orderkey || ': ref=' || s || ', actual=X', '; ' ORDER BY o_orderkey) FROM f""")
def rc_4c(spark, d):
    """The rows whose details hold whole numbers only; the others are compared in tests."""
    return rc.full_report(*_whole_numbers(spark, d), "o_orderkey", unique_keys=True).filter("seq IN (4, 6, 8)")


@query("rc_4_execution", """
SELECT 'broken' AS run, 'execution' AS name, 'fail' AS status, true AS tells_the_error, NULL AS n FROM (SELECT 1)
UNION ALL SELECT 'whole', 'schema_parity', 'pass', false, NULL UNION ALL SELECT 'whole', 'row_count', 'pass', false, NULL UNION ALL SELECT 'whole', 'aggregate_parity', 'pass', false, NULL""")
def rc_4b(spark, d):
    """A job that fails in its tasks becomes one failed check; a good one three passed ones; none without a reference."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    broken = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") >= 0, F.raise_error(F.lit("price is gone"))).otherwise(0).cast("double"))
    runs = {"broken": rc.run_checks(spark, lambda: o, lambda: broken), "whole": rc.run_checks(spark, lambda: o, lambda: o), "none": rc.run_checks(spark, None, lambda: o)}
    found = None
    for run, checks in runs.items():
        rows = checks.select(F.lit(run).alias("run"), "name", "status", F.coalesce(F.length("detail") > 20, F.lit(False)).alias("tells_the_error"), F.lit(None).cast("int").alias("n"))
        found = rows if found is None else found.unionByName(rows)
    return found


def _several_reports(spark, d):
    """Check rows of four reports: equal tables, lost rows, renamed column, retyped and scaled column."""
    ref, damaged = orders_and_damaged(spark, d)
    actuals = {"same": ref, "damaged": damaged, "renamed": ref.withColumnRenamed("o_custkey", "customer"),
               "retyped": ref.withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn("o_totalprice", F.col("o_totalprice") * 2)}
    checks = None
    for name, actual in actuals.items():
        found = rc.reconcile(ref, actual).withColumn("report", F.lit(name))
        checks = found if checks is None else checks.unionByName(found)
    return checks


@query("rc_5_summary", f"""
WITH {_WHOLE_SUMS}, d AS (SELECT CASE WHEN r.n <> x.n THEN 'ref=' || r.n || ', actual=' || x.n END AS rows,
    nullif(concat_ws('; ', {_detail_sql('o_orderkey', 'r.k', 'x.k')}, {_detail_sql('o_custkey', 'r.c', 'x.c')}), '') AS sums, {_detail_sql('o_orderkey', 'r.k', '(2 * r.k)')} AS twice FROM r, x)
SELECT 'same' AS report, 3 AS total, 3 AS passed, 0 AS failed, true AS all_passed, true AS row_count_match, true AS column_match, '3/3 checks passed' AS diff_summary FROM d
UNION ALL SELECT 'damaged', 3, 1 + (rows IS NULL)::INT + (sums IS NULL)::INT, (rows IS NOT NULL)::INT + (sums IS NOT NULL)::INT, rows IS NULL AND sums IS NULL, rows IS NULL, true, concat_ws('; ', rows, sums) FROM d
UNION ALL SELECT 'renamed', 3, 1, 2, false, true, false, 'missing=[''o_custkey''], extra=[''customer'']; o_custkey: missing in actual' FROM d
UNION ALL SELECT 'retyped', 3, 1, 2, false, true, false, 'o_custkey: ref=numeric, actual=object; ' || twice || '; o_custkey: missing in actual' FROM d""")
def rc_5(spark, d):
    ref, damaged = _whole_numbers(spark, d)
    actuals = {"same": ref, "damaged": damaged, "renamed": ref.withColumnRenamed("o_custkey", "customer"),
               "retyped": ref.withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn("o_orderkey", F.col("o_orderkey") * 2)}
    checks = None
    for name, actual in actuals.items():
        found = rc.reconcile(ref, actual).withColumn("report", F.lit(name))
        checks = found if checks is None else checks.unionByName(found)
    return rc.summarize_checks(checks, "report")


@query("rc_6_count_avg_parity", f"""SELECT "column", ref_count, actual_count, ref_avg, actual_avg, count_status, avg_status FROM ({_PARITY})""")
def rc_6(spark, d):
    found = _rounded_parity(spark, d).filter("sum_status <> 'missing'")
    return found.select("column", "ref_count", "actual_count", "ref_avg", "actual_avg", "count_status", "avg_status")


@query("rc_7_hash_diff", f"""
WITH r AS ({_ORDERS}), a AS ({_DAMAGED})
SELECT coalesce(r.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'missing' WHEN r.o_orderkey IS NULL THEN 'extra' ELSE 'changed' END AS difference
FROM r FULL JOIN a ON r.o_orderkey = a.o_orderkey
WHERE a.o_orderkey IS NULL OR r.o_orderkey IS NULL OR r.o_custkey <> a.o_custkey OR r.o_orderstatus <> a.o_orderstatus OR r.o_totalprice <> a.o_totalprice""")
def rc_7(spark, d):
    return rc.hash_diff(*orders_and_damaged(spark, d), "o_orderkey", unique_keys=True)


# Every 997th order: a comment-like column, a price, a date or a copy goes wrong in some of its lines.
_LINES_OFF = """
SELECT * REPLACE (CASE WHEN l_orderkey % 997 = 1 AND l_linenumber = 1 THEN 'Z' ELSE l_returnflag END AS l_returnflag,
    CASE WHEN l_orderkey % 997 = 2 THEN l_extendedprice + 0.01 ELSE l_extendedprice END AS l_extendedprice,
    CASE WHEN l_orderkey % 997 = 3 THEN NULL ELSE l_shipdate END AS l_shipdate, CASE WHEN l_orderkey % 997 = 4 THEN l_suppkey + 1 ELSE l_suppkey END AS l_suppkey)
  FROM lineitem WHERE l_orderkey % 997 <> 5 UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 997 = 6"""


@query("rc_8_multiset_diff", f"""
WITH b AS (SELECT *, 1 AS r, 0 AS a FROM lineitem UNION ALL SELECT *, 0, 1 FROM ({_LINES_OFF}))
SELECT * EXCLUDE (r, a), sum(r)::BIGINT AS ref_copies, sum(a)::BIGINT AS actual_copies FROM b GROUP BY ALL HAVING sum(r) <> sum(a)""")
def rc_8(spark, d):
    line = table(spark, d, "lineitem")
    which = F.col("l_orderkey") % 997
    off = line.filter(which != 5).withColumns({
        "l_returnflag": F.when((which == 1) & (F.col("l_linenumber") == 1), "Z").otherwise(F.col("l_returnflag")),
        "l_extendedprice": F.when(which == 2, F.col("l_extendedprice") + 0.01).otherwise(F.col("l_extendedprice")),
        "l_shipdate": F.when(which != 3, F.col("l_shipdate")), "l_suppkey": F.when(which == 4, F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey"))})
    return rc.multiset_diff(line, off.unionByName(line.filter(which == 6)))


def _quantile_sql(p: float) -> str:
    return f"""SELECT 'o_totalprice' AS "column", {p}::DOUBLE AS p, round(r, 4) AS ref_value, round(a, 4) AS actual_value, CASE WHEN abs(r - a) / abs(r) > 0.001 THEN 'fail' ELSE 'pass' END AS status
  FROM (SELECT quantile_cont(o_totalprice, {p}) AS r, quantile_cont(CASE WHEN o_totalprice > 400000 THEN o_totalprice * 1.05 ELSE o_totalprice END, {p}) AS a FROM orders)"""


@query("rc_9_distribution", " UNION ALL ".join(_quantile_sql(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)))
def rc_9(spark, d):
    o = table(spark, d, "orders").select("o_totalprice")
    price = F.col("o_totalprice")
    found = rc.distribution_comparison(o, o.select(F.when(price > 400000, price * 1.05).otherwise(price).alias("o_totalprice")))
    return found.withColumns({c: F.round(c, 4) for c in ("ref_value", "actual_value")})


_RECORDS = f"""
WITH r AS ({_ORDERS}), a AS ({_DAMAGED}), j AS (SELECT r.o_orderkey, r.o_orderstatus AS rs, a.o_orderstatus AS xs, r.o_totalprice AS rp, a.o_totalprice AS xp FROM r JOIN a ON r.o_orderkey = a.o_orderkey)
SELECT o_orderkey, 'o_orderstatus' AS "column", rs AS ref_value, xs AS actual_value, CAST(NULL AS DOUBLE) AS delta FROM j WHERE rs <> xs
UNION ALL SELECT o_orderkey, 'o_totalprice', CAST(round(rp, 2) AS VARCHAR), CAST(round(xp, 2) AS VARCHAR), round(xp - rp, 4) FROM j WHERE abs(xp - rp) > 0.001"""


def _records(spark, d):
    found = rc.record_diff(*orders_and_damaged(spark, d), "o_orderkey", atol=0.001, unique_keys=True)
    number = F.col("column") == "o_totalprice"
    tidy = {c: F.when(number, F.round(F.col(c).try_cast("double"), 2).cast("string")).otherwise(F.col(c)) for c in ("ref_value", "actual_value")}
    return found.withColumns(tidy | {"delta": F.round("delta", 4)})


@query("rc_10_record_diff", _RECORDS)
def rc_10(spark, d):
    return _records(spark, d)


@query("rc_11_one_sided_keys", f"""
WITH a AS ({_DAMAGED}) SELECT o_orderkey, 'ref_only' AS side FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)
UNION ALL SELECT o_orderkey, 'actual_only' FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def rc_11(spark, d):
    return rc.one_sided_keys(*orders_and_damaged(spark, d), "o_orderkey")


@query("rc_12_mismatch_sample", f"""
SELECT "column", o_orderkey, ref_value, actual_value, delta FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY o_orderkey) AS rn FROM ({_RECORDS})) WHERE rn <= 5""")
def rc_12(spark, d):
    return rc.mismatch_sample(_records(spark, d), "o_orderkey", 5)


@query("rc_12_mismatch_counts", f"""SELECT "column", count(*) AS mismatches, max(abs(delta)) AS largest_delta FROM ({_RECORDS}) GROUP BY "column" """)
def rc_12b(spark, d):
    return rc.mismatch_counts(_records(spark, d))


@query("rc_13_classify_failures", f"""
WITH a AS ({_DAMAGED}), n AS (SELECT (SELECT count(*) FROM orders) AS r, (SELECT count(*) FROM a) AS x), f AS (
  SELECT 'damaged' AS report, 'row_count' AS name, 'row count mismatch' AS pattern FROM n WHERE r <> x UNION ALL SELECT 'damaged', 'aggregate_parity', 'column value mismatch' FROM n
  UNION ALL SELECT 'renamed', 'schema_parity', 'column name mismatch' FROM n UNION ALL SELECT 'renamed', 'aggregate_parity', 'column value mismatch' FROM n
  UNION ALL SELECT 'retyped', 'schema_parity', 'type mismatch' FROM n UNION ALL SELECT 'retyped', 'aggregate_parity', 'column value mismatch' FROM n)
SELECT f.*, CASE pattern WHEN 'row count mismatch' THEN 'rows lost or doubled by a join, a condition left out, or rows written once too few or too often'
  WHEN 'column value mismatch' THEN 'a running value that starts wrong, a branch that takes other rows, or rounding'
  WHEN 'column name mismatch' THEN 'names in another case, or the list of columns to keep or drop was not followed'
  ELSE 'numbers held as text or the reverse, or dates counted from another day' END AS probable_cause FROM f""")
def rc_13(spark, d):
    return rc.classify_failures(_several_reports(spark, d)).select("report", "name", "pattern", "probable_cause")


@query("rc_14_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def rc_14(spark, d):
    return rc.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey l_linenumber")


@query("ss_1_reconcile_batches", """
WITH s AS (SELECT sum(value) AS r, sum(CASE WHEN event_type = 'error' THEN value * 2 ELSE value END) AS a FROM events)
SELECT n.name, CASE WHEN n.name = 'aggregate_parity' AND abs(s.r - s.a) / abs(s.r) > 0.001 THEN 'fail' ELSE 'pass' END AS status, 4 AS n_batches
FROM s, (VALUES ('schema_parity'), ('row_count'), ('aggregate_parity')) AS n(name)""")
def ss_1(spark, d):
    events = table(spark, d, "events")
    arrived, reports, progress = (scratch_path(spark, label) for label in ("arrived", "reports", "progress"))
    events.repartitionByRange(4, "event_id").write.parquet(arrived)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(arrived)

    def wrong(batch):
        return batch.withColumn("value", F.when(F.col("event_type") == "error", F.col("value") * 2).otherwise(F.col("value")))

    def reference(batch):
        return events.join(batch.select("event_id"), "event_id", "left_semi").select(*events.columns)

    reconcile_stream(stream, reference, reports, progress, transform=wrong)
    return read_reports(spark, reports).groupBy("name", "status").agg(F.count_distinct("batch_id").alias("n_batches"))


@query("ss_1_running_groups", """
WITH a AS (SELECT * REPLACE (CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderkey % 10 = 0))
SELECT r.o_orderpriority, CASE WHEN x.n < r.n THEN 'open' WHEN abs(r.s - x.s) / r.s > 0.001 THEN 'fail' ELSE 'pass' END AS status, r.n AS ref_rows, x.n AS actual_rows
FROM (SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) r JOIN (SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS s FROM a GROUP BY 1) x USING (o_orderpriority)""")
def ss_1b(spark, d):
    """Each priority's orders arrive in four batches; some prices are off, some orders never come."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    sent = orders.filter(~((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderkey") % 10 == 0))).withColumn("o_totalprice", F.when(urgent, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")))
    arrived, reports, progress = (scratch_path(spark, label) for label in ("arrived", "reports", "progress"))
    sent.repartitionByRange(4, "o_orderkey").write.parquet(arrived)
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(arrived)
    reconcile_running(stream, orders, "o_orderpriority", reports, progress)
    return group_reports(spark, reports, orders, "o_orderpriority").select("o_orderpriority", "status", "ref_rows", "actual_rows")
