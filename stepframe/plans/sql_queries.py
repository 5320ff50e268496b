"""SQL steps, combining, sorting, reshaping, summaries, matrices and functions on the driver tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from stepframe.functions import dates, values
from stepframe.operators import combine, matrix, ordered, step, summaries
from stepframe.operators.sql import Datasets, recurse, run_sql
from stepframe.plans.catalog import query, table


@query("sq_1_run_sql", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def sq_1(spark, d):
    return run_sql(spark, """
        SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM lines WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""", {"lines": table(spark, d, "lineitem")})


@query("sq_2_create_table", """
WITH rich AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 5000)
SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM rich GROUP BY c_nationkey""")
def sq_2(spark, d):
    data = Datasets(spark, customer=table(spark, d, "customer"))
    data.create_table("Work.Rich", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
    return data.sql("SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM work_rich GROUP BY c_nationkey")


@query("sq_3_inner_join", """
SELECT o_orderkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey""")
def sq_3(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice")


@query("sq_4_left_join", """
SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def sq_4(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("sq_5_right_join", """
SELECT s_name, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation ON s_nationkey = n_nationkey""")
def sq_5(spark, d):
    s, n = table(spark, d, "supplier").filter("s_acctbal > 5000"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "right").select("s_name", "n_name")


@query("sq_6_full_join", """
WITH c AS (SELECT c_custkey AS custkey, c_name FROM customer WHERE c_acctbal > 2000),
     o AS (SELECT o_custkey AS custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT custkey, c_name, o_orderkey FROM c FULL JOIN o USING (custkey)""")
def sq_6(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 2000").select(F.col("c_custkey").alias("custkey"), "c_name")
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey"), "o_orderkey")
    return combine.full_join(c, o, "custkey")


@query("sq_7_join_chain", """
SELECT r_name, n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def sq_7(spark, d):
    frames = {t: table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region")}
    return run_sql(spark, """
        SELECT r_name, n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY r_name, n_name""", frames)


@query("sq_8_group_by", """
SELECT c_mktsegment, count(*) AS headcount, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS average FROM customer GROUP BY c_mktsegment""")
def sq_8(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(
        F.count("*").alias("headcount"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.round(F.avg("c_acctbal"), 4).alias("average"))


@query("sq_9_where", """
SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O' GROUP BY o_orderpriority""")
def sq_9(spark, d):
    picked = table(spark, d, "orders").filter("o_totalprice > 200000 AND o_orderstatus = 'O'")
    return picked.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("sq_10_having", """
SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey HAVING count(*) >= 12""")
def sq_10(spark, d):
    spent = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return spent.filter("n >= 12")


@query("sq_11_order_by", """
SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (ORDER BY n_regionkey DESC, n_name) AS place FROM nation""")
def sq_11(spark, d):
    n = table(spark, d, "nation")
    ranked = ordered.positions(n, "DESCENDING n_regionkey n_name", "place")
    return ranked.orderBy(F.desc("n_regionkey"), "n_name")


@query("sq_12_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def sq_12(spark, d):
    return table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("sq_13_case_when", """
SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'now' WHEN o_totalprice > 300000 THEN 'soon' ELSE 'later' END AS speed, count(*) AS n
FROM orders GROUP BY 1""")
def sq_13(spark, d):
    speed = step.choose([(F.col("o_orderpriority") == "1-URGENT", "now"), (F.col("o_totalprice") > 300000, "soon")], "later")
    return table(spark, d, "orders").groupBy(speed.alias("speed")).agg(F.count("*").alias("n"))


@query("sq_14_partition_sum", """
SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS customer_total FROM orders""")
def sq_14(spark, d):
    rows = combine.with_group_statistics(table(spark, d, "orders"), "o_custkey", customer_total=F.round(F.sum("o_totalprice"), 2))
    return rows.select("o_orderkey", "o_custkey", "customer_total")


@query("sq_15_top_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def sq_15(spark, d):
    return run_sql(spark, """
        SELECT o_custkey, o_orderkey, o_totalprice, CAST(rn AS BIGINT) AS rn FROM (
          SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders_in) WHERE rn <= 3""",
                   {"orders_in": table(spark, d, "orders")})


@query("sq_15_row_number", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth_order FROM orders""")
def sq_15b(spark, d):
    numbered = ordered.row_numbers(table(spark, d, "orders"), "o_custkey", "o_orderdate o_orderkey", "nth_order")
    return numbered.select("o_orderkey", "nth_order")


@query("sq_16_cte", """
WITH net AS (SELECT l_suppkey, l_extendedprice * (1 - l_discount) AS v FROM lineitem), per AS (SELECT l_suppkey, sum(v) AS revenue FROM net GROUP BY l_suppkey),
  mean AS (SELECT avg(revenue) AS m FROM per)
SELECT l_suppkey, round(revenue, 2) AS revenue FROM per, mean WHERE revenue > m""")
def sq_16(spark, d):
    return run_sql(spark, """
        WITH net AS (SELECT l_suppkey, l_extendedprice * (1 - l_discount) AS v FROM lines),
             per AS (SELECT l_suppkey, sum(v) AS revenue FROM net GROUP BY l_suppkey)
        SELECT l_suppkey, round(revenue, 2) AS revenue FROM per WHERE revenue > (SELECT avg(revenue) FROM per)""", {"lines": table(spark, d, "lineitem")})


@query("sq_17_recursive", """
WITH RECURSIVE tree AS (SELECT p_partkey, 0 AS level FROM part WHERE p_partkey = 0
  UNION ALL SELECT p.p_partkey, t.level + 1 FROM part p JOIN tree t ON p.p_partkey // 3 = t.p_partkey AND p.p_partkey <> t.p_partkey)
SELECT p_partkey, level FROM tree""")
def sq_17(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.expr("p_partkey div 3").alias("parent"))

    def children(above):
        return part.join(above.select(F.col("p_partkey").alias("parent")), "parent").filter("p_partkey <> parent").select("p_partkey")

    return recurse(part.filter("p_partkey = 0").select("p_partkey"), children)


@query("sq_18_insert_select", """
SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_totalprice * 2, 'X' FROM orders WHERE o_orderstatus = 'P'""")
def sq_18(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    data = Datasets(spark, done=o.filter("o_orderstatus = 'F'"))
    return data.insert_into("done", o.filter("o_orderstatus = 'P'").withColumns({"o_totalprice": F.col("o_totalprice") * 2, "o_orderstatus": F.lit("X")}))


@query("sq_19_calculated", """
SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice * l_discount, 4) AS saved, round(l_extendedprice * l_discount * (1 + l_tax), 6) AS saved_gross FROM lineitem""")
def sq_19(spark, d):
    return run_sql(spark, """
        SELECT l_orderkey, l_partkey, l_linenumber, round(cut, 4) AS saved, round(cut * (1 + l_tax), 6) AS saved_gross
        FROM (SELECT *, l_extendedprice * l_discount AS cut FROM lines)""", {"lines": table(spark, d, "lineitem")})


@query("sq_20_remerge", """
SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_suppkey), 8) AS share FROM lineitem""")
def sq_20(spark, d):
    rows = combine.with_group_statistics(table(spark, d, "lineitem"), "l_suppkey", whole=F.sum("l_extendedprice"))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", F.round(F.try_divide("l_extendedprice", "whole"), 8).alias("share"))


@query("sq_21_predicates", """
SELECT p_partkey, p_name, p_type, p_size FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_name LIKE '%ring%' AND NOT (p_size BETWEEN 10 AND 20) OR p_size = 50""")
def sq_21(spark, d):
    c = F.col
    picked = (c("p_type").isin("ECONOMY", "PROMO") & c("p_name").like("%ring%") & ~c("p_size").between(10, 20)) | (c("p_size") == 50)
    return table(spark, d, "part").filter(picked).select("p_partkey", "p_name", "p_type", "p_size")


@query("sq_22_union", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def sq_22(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return c.union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("cb_1_concatenate", """
SELECT c_name AS name, c_nationkey AS nationkey, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS BIGINT) AS suppkey FROM customer
UNION ALL SELECT s_name, s_nationkey, s_acctbal, NULL, s_suppkey FROM supplier""")
def cb_1(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("suppkey"))
    return combine.concatenate(c, s)


@query("cb_2_match_merge", """
WITH a AS (SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS amount FROM customer WHERE c_mktsegment <> 'BUILDING'),
     b AS (SELECT o_custkey AS custkey, o_orderkey, o_totalprice AS amount FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT custkey, a.name, CASE WHEN b.o_orderkey IS NOT NULL THEN b.amount ELSE a.amount END AS amount, o_orderkey FROM a FULL JOIN b USING (custkey)""")
def cb_2(spark, d):
    a = table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))
    b = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("custkey"), "o_orderkey", F.col("o_totalprice").alias("amount"))
    return combine.match_merge(a, b, "custkey")


@query("cb_2_match_merge_missing", """
WITH a AS (SELECT CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_custkey END AS custkey, max(c_name) AS name FROM customer GROUP BY 1),
     b AS (SELECT CASE WHEN o_custkey % 89 = 0 THEN NULL ELSE o_custkey END AS custkey, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT coalesce(a.custkey, b.custkey) AS custkey, name, n_orders FROM a FULL JOIN b ON a.custkey IS NOT DISTINCT FROM b.custkey""")
def cb_2_missing(spark, d):
    key = lambda c, n: F.when(F.col(c) % n != 0, F.col(c)).alias("custkey")
    a = table(spark, d, "customer").groupBy(key("c_custkey", 97)).agg(F.max("c_name").alias("name"))
    b = table(spark, d, "orders").groupBy(key("o_custkey", 89)).agg(F.count("*").alias("n_orders"))
    return combine.match_merge(a, b, "custkey")


@query("cb_3_merge_audit", """
WITH c AS (SELECT c_custkey AS k, count(*) AS l FROM customer WHERE c_acctbal > 0 GROUP BY 1), o AS (SELECT o_custkey AS k, count(*) AS r FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT CASE WHEN c.k IS NULL THEN 'right_only' WHEN o.k IS NULL THEN 'left_only' ELSE 'matched' END AS presence, count(*) AS keys,
  CAST(coalesce(sum(l), 0) AS BIGINT) AS left_rows, CAST(coalesce(sum(r), 0) AS BIGINT) AS right_rows FROM c FULL JOIN o ON c.k = o.k GROUP BY 1""")
def cb_3(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    o = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return combine.merge_audit(c, o, "k")


@query("st_1_sort", """
SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders""")
def st_1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    by = "o_orderpriority DESCENDING o_totalprice o_orderkey"
    return step.sort(ordered.positions(o, by, "place"), by)


@query("st_2_sort_out", """
SELECT 'out' AS dataset, p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS place FROM part
UNION ALL SELECT 'in place', p_partkey, row_number() OVER (ORDER BY p_brand, p_partkey) FROM part""")
def st_2(spark, d):
    data = Datasets(spark, part=table(spark, d, "part"))
    data.sort("part", "DESCENDING p_size p_partkey", out="Work.By_Size")
    data.sort("part", "p_brand p_partkey")
    a = ordered.positions(data["work.by_size"], "DESCENDING p_size p_partkey", "place").select(F.lit("out").alias("dataset"), "p_partkey", "place")
    return a.unionByName(ordered.positions(data["part"], "p_brand p_partkey", "place").select(F.lit("in place").alias("dataset"), "p_partkey", "place"))


@query("tr_1_wide_to_long", """
SELECT l_orderkey, l_partkey, l_linenumber, u.n AS _name_, CASE u.n WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount ELSE l_tax END AS col1
FROM lineitem, (VALUES ('l_quantity'), ('l_discount'), ('l_tax')) AS u(n)""")
def tr_1(spark, d):
    return summaries.transpose_long(table(spark, d, "lineitem"), "l_orderkey l_partkey l_linenumber", "l_quantity l_discount l_tax")


@query("tr_2_long_to_wide", """
SELECT o_custkey, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS status_F, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS status_O,
  round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS status_P FROM orders GROUP BY o_custkey""")
def tr_2(spark, d):
    return summaries.transpose_wide(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_totalprice", ["F", "O", "P"], lambda c: F.round(F.sum(c), 2), "status_")


@query("pm_1_means_class", """
SELECT l_returnflag, l_linestatus, count(l_quantity) AS n_l_quantity, round(avg(l_quantity), 6) AS mean_l_quantity, round(stddev_samp(l_quantity), 6) AS std_l_quantity,
  min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, median(l_quantity) AS median_l_quantity,
  count(l_extendedprice) AS n_l_extendedprice, round(avg(l_extendedprice), 4) AS mean_l_extendedprice, round(stddev_samp(l_extendedprice), 4) AS std_l_extendedprice,
  min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice, round(median(l_extendedprice), 4) AS median_l_extendedprice
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def pm_1(spark, d):
    m = summaries.means(table(spark, d, "lineitem"), "l_quantity l_extendedprice", "l_returnflag l_linestatus", ["n", "mean", "std", "min", "max", "median"])
    digits = {"mean_l_quantity": 6, "std_l_quantity": 6, "mean_l_extendedprice": 4, "std_l_extendedprice": 4, "median_l_extendedprice": 4}
    return m.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("pm_2_means_overall", """
SELECT 'c_acctbal' AS variable, count(c_acctbal) AS n, count(*) - count(c_acctbal) AS nmiss, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std,
  min(c_acctbal) AS min, max(c_acctbal) AS max, round(median(c_acctbal), 4) AS median FROM customer
UNION ALL SELECT 'c_nationkey', count(c_nationkey), count(*) - count(c_nationkey), round(avg(c_nationkey), 4), round(stddev_samp(c_nationkey), 4),
  min(c_nationkey), max(c_nationkey), round(median(c_nationkey), 4) FROM customer""")
def pm_2(spark, d):
    m = summaries.means(table(spark, d, "customer"), "c_acctbal c_nationkey", (), ["n", "nmiss", "mean", "std", "min", "max", "median"])
    return m.withColumns({c: F.round(c, 4) for c in ("mean", "std", "median")})


@query("pm_3_output_names", """
SELECT l_linenumber, round(sum(l_tax), 2) AS sum_l_tax, round(avg(l_discount), 6) AS mean_l_discount, round(avg(l_tax), 6) AS mean_l_tax, round(sum(l_discount), 2) AS sum_l_discount
FROM lineitem GROUP BY l_linenumber""")
def pm_3(spark, d):
    m = summaries.means(table(spark, d, "lineitem"), "l_tax l_discount", "l_linenumber", ["sum", "mean"])
    return m.withColumns({c: F.round(c, 2 if c.startswith("sum") else 6) for c in m.columns if c != "l_linenumber"})


@query("pm_4_n_nmiss", """
SELECT c_mktsegment, count(o_totalprice) AS n_o_totalprice, count(*) - count(o_totalprice) AS nmiss_o_totalprice
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def pm_4(spark, d):
    o = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return summaries.means(table(spark, d, "customer").join(o, "c_custkey", "left"), "o_totalprice", "c_mktsegment", ["n", "nmiss"])


@query("pm_1_quantiles", """
SELECT l_returnflag, 'l_quantity' AS variable, 0.05 AS p, round(quantile_cont(l_quantity, 0.05), 4) AS quantile FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_quantity', 0.5, round(quantile_cont(l_quantity, 0.5), 4) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_quantity', 0.99, round(quantile_cont(l_quantity, 0.99), 4) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_extendedprice', 0.05, round(quantile_cont(l_extendedprice, 0.05), 4) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_extendedprice', 0.5, round(quantile_cont(l_extendedprice, 0.5), 4) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_extendedprice', 0.99, round(quantile_cont(l_extendedprice, 0.99), 4) FROM lineitem GROUP BY 1""")
def pm_1b(spark, d):
    q = summaries.quantiles(table(spark, d, "lineitem"), "l_returnflag", "l_quantity l_extendedprice", [0.05, 0.5, 0.99])
    return q.withColumn("quantile", F.round("quantile", 4))


@query("pf_1_one_way", """
WITH f AS (SELECT p_type, count(*) AS frequency FROM part GROUP BY p_type)
SELECT p_type, frequency, round(100.0 * frequency / sum(frequency) OVER (), 6) AS percent, CAST(sum(frequency) OVER (ORDER BY p_type) AS BIGINT) AS cum_frequency,
  round(100.0 * sum(frequency) OVER (ORDER BY p_type) / sum(frequency) OVER (), 6) AS cum_percent FROM f""")
def pf_1(spark, d):
    f = summaries.frequencies(table(spark, d, "part"), "p_type")
    return f.withColumns({c: F.round(c, 6) for c in ("percent", "cum_percent")})


@query("pf_2_crosstab", """
WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS frequency FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, o_orderpriority, frequency, round(100.0 * frequency / sum(frequency) OVER (), 6) AS percent,
  round(100.0 * frequency / sum(frequency) OVER (PARTITION BY o_orderstatus), 6) AS row_percent, round(100.0 * frequency / sum(frequency) OVER (PARTITION BY o_orderpriority), 6) AS col_percent FROM c""")
def pf_2(spark, d):
    t = summaries.crosstab(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return t.withColumns({c: F.round(c, 6) for c in ("percent", "row_percent", "col_percent")})


@query("pf_2_crosstab_wide", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority""")
def pf_2b(spark, d):
    return summaries.crosstab_wide(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("pf_3_chi_square", """
WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(n) AS rn FROM c GROUP BY a), k AS (SELECT b, sum(n) AS kn FROM c GROUP BY b),
  t AS (SELECT sum(n) AS n FROM c),
  s AS (SELECT CAST(any_value(t.n) AS BIGINT) AS n, sum((coalesce(c.n, 0) - rn * kn / t.n) * (coalesce(c.n, 0) - rn * kn / t.n) / (rn * kn / t.n)) AS x,
    (count(DISTINCT r.a) - 1) * (count(DISTINCT k.b) - 1) AS freedom FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b)
SELECT n, freedom, round(x, 6) AS statistic,
  round(exp(-x / 2) * (SELECT sum(power(s2.x / 2, i) / factorial(CAST(i AS INTEGER))) FROM s s2, range(0, 4) AS g(i)), 6) AS p_value FROM s""")
def pf_3(spark, d):
    t = summaries.chi_square(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return t.withColumns({"statistic": F.round("statistic", 6), "p_value": F.round("p_value", 6)})


@query("im_1_bind_columns", """
SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal >= 7500 THEN 3 WHEN c_acctbal >= 5000 THEN 2 ELSE 1 END AS tier FROM customer""")
def im_1(spark, d):
    c = table(spark, d, "customer")
    balance = matrix.read_vector(c, "c_custkey", "c_acctbal")
    tier = balance.select("c_custkey", matrix.tiers(F.col("c_acctbal"), [(7500, 3), (5000, 2)], 1).alias("tier"))
    return matrix.bind_columns("c_custkey", balance, tier)


@query("im_2_tiers", """
SELECT tier, count(*) AS n FROM (SELECT CASE WHEN c_acctbal / 10000 >= 0.75 THEN 3 WHEN c_acctbal / 10000 >= 0.5 THEN 2 ELSE 1 END AS tier FROM customer) GROUP BY tier""")
def im_2(spark, d):
    score = F.col("c_acctbal") / 10000
    return table(spark, d, "customer").groupBy(matrix.tiers(score, [(0.75, 3), (0.5, 2)], 1).alias("tier")).agg(F.count("*").alias("n"))


@query("im_3_constants", "SELECT count(*) AS n, CAST(sum(1.5) AS DOUBLE) AS total FROM customer")
def im_3(spark, d):
    c = table(spark, d, "customer")
    ones = matrix.constant_vector(c, "c_custkey", 1.5, "one").agg(F.sum("one").alias("total"))
    return matrix.n_rows(c).join(F.broadcast(ones))


@query("im_4_z_scores", """
SELECT l_orderkey, l_partkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) AS z_l_quantity FROM lineitem""")
def im_4(spark, d):
    z = matrix.z_scores(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"), "l_quantity")
    return z.select("l_orderkey", "l_partkey", "l_linenumber", F.round("z_l_quantity", 6).alias("z_l_quantity"))


_CELLS = "SELECT vec_id AS i, CAST(u.j - 1 AS INTEGER) AS j, CAST(embedding[u.j] AS DOUBLE) AS v, label FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(j)"


@query("im_5_multiply", f"""
WITH a AS ({_CELLS}), b AS (SELECT j AS i, label AS j, avg(v) AS v FROM a GROUP BY j, label)
SELECT a.i, b.j, round(sum(a.v * b.v), 5) AS v FROM a JOIN b ON a.j = b.i GROUP BY a.i, b.j""")
def im_5(spark, d):
    e = table(spark, d, "embeddings")
    a = matrix.to_long(e, "vec_id", "embedding")
    labelled = e.select("label", F.posexplode("embedding").alias("i", "x"))
    b = labelled.groupBy("i", F.col("label").alias("j")).agg(F.avg(F.col("x").cast("double")).alias("v"))
    return matrix.multiply(a, b).withColumn("v", F.round("v", 5))


@query("im_6_transpose", f"WITH a AS ({_CELLS}) SELECT j AS i, i AS j, v FROM a")
def im_6(spark, d):
    return matrix.transpose(matrix.to_long(table(spark, d, "embeddings"), "vec_id", "embedding"))


@query("im_7_gram", f"WITH a AS ({_CELLS}) SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 5) AS v FROM a JOIN a b ON a.i = b.i GROUP BY a.j, b.j")
def im_7(spark, d):
    return matrix.gram(table(spark, d, "embeddings"), "embedding").withColumn("v", F.round("v", 5))


@query("im_7_covariance", f"WITH a AS ({_CELLS}) SELECT a.j AS i, b.j AS j, round(covar_samp(a.v, b.v), 7) AS v FROM a JOIN a b ON a.i = b.i GROUP BY a.j, b.j")
def im_7b(spark, d):
    return matrix.covariance(table(spark, d, "embeddings"), "embedding").withColumn("v", F.round("v", 7))


@query("im_7_correlation", f"WITH a AS ({_CELLS}) SELECT a.j AS i, b.j AS j, round(corr(a.v, b.v), 6) AS v FROM a JOIN a b ON a.i = b.i GROUP BY a.j, b.j")
def im_7c(spark, d):
    return matrix.correlation(table(spark, d, "embeddings"), "embedding").withColumn("v", F.round("v", 6))


@query("fc_1_sql_function", """
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_discount > 0 AND l_discount < 1 THEN round(ln(l_discount / (1 - l_discount)), 6) END AS logit FROM lineitem""")
def fc_1(spark, d):
    values.define_function(spark, "fcmp_logit", {"x": "double"}, "double", "CASE WHEN x > 0 AND x < 1 THEN ln(x / (1 - x)) END")
    return run_sql(spark, "SELECT l_orderkey, l_partkey, l_linenumber, round(fcmp_logit(l_discount), 6) AS logit FROM lines", {"lines": table(spark, d, "lineitem")})


@query("fc_2_batch_function", """
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_quantity <= 10 THEN l_quantity ELSE 10 + (l_quantity - 10) * 0.5 END AS weight FROM lineitem""")
def fc_2(spark, d):
    def tapered(quantity: pd.Series) -> pd.Series:
        return quantity.where(quantity <= 10, 10 + (quantity - 10) * 0.5)

    weigh = values.batch_function(tapered)
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", weigh("l_quantity").alias("weight"))


@query("fn_1_trim_concat", "SELECT c_custkey, trim('  ' || c_name || ' ') || ' ' || trim(c_mktsegment) AS full_name FROM customer")
def fn_1(spark, d):
    padded = F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))
    return table(spark, d, "customer").select("c_custkey", values.joined_name(padded, F.col("c_mktsegment")).alias("full_name"))


@query("fn_2_arithmetic", """
SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice * 1.2 - l_quantity + 3, 4) AS a, CASE WHEN l_tax <> 0 THEN round(l_discount / l_tax, 6) END AS b FROM lineitem""")
def fn_2(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.round(c("l_extendedprice") * 1.2 - c("l_quantity") + 3, 4).alias("a"),
                                              F.round(values.divide(c("l_discount"), c("l_tax")), 6).alias("b"))


@query("fn_3_log", """
SELECT l_orderkey, l_partkey, l_linenumber, round(ln(l_extendedprice), 6) AS log_price, CASE WHEN l_tax > 0 THEN round(ln(l_tax / (1 - l_tax)), 6) END AS logit_tax FROM lineitem""")
def fn_3(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.round(values.log(c("l_extendedprice")), 6).alias("log_price"), F.round(values.logit(c("l_tax")), 6).alias("logit_tax"))


@query("fn_4_sas_date", """
SELECT o_orderkey, datediff('day', DATE '1960-01-01', CAST(o_orderdate AS DATE)) AS day_number, CAST(o_orderdate AS DATE) AS back FROM orders""")
def fn_4(spark, d):
    number = dates.to_sas_date(F.col("o_orderdate").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", number.cast("long").alias("day_number"), dates.from_sas_date(number).alias("back"))


@query("fn_5_intnx", """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS x FROM orders)
SELECT o_orderkey, CAST(date_trunc('month', x) + INTERVAL 2 MONTH AS DATE) AS month_begin, CAST(date_trunc('month', x) + INTERVAL 2 MONTH - INTERVAL 1 DAY AS DATE) AS next_month_end,
  CAST(date_trunc('quarter', x) - INTERVAL 3 MONTH AS DATE) AS qtr_back, CAST(date_trunc('year', x) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS year_end,
  CAST(x + INTERVAL 1 MONTH AS DATE) AS month_same, CAST(x - CAST(dayofweek(x) AS INTEGER) + 7 AS DATE) AS next_sunday FROM o""")
def fn_5(spark, d):
    x = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", dates.intnx("month", x, 2).alias("month_begin"), dates.intnx("month", x, 1, "end").alias("next_month_end"), dates.intnx("qtr", x, -1).alias("qtr_back"),
        dates.intnx("year", x, 0, "end").alias("year_end"), dates.intnx("month", x, 1, "same").alias("month_same"), dates.intnx("week", x, 1).alias("next_sunday"))


@query("fn_6_intck", """
SELECT l_orderkey, l_partkey, l_linenumber, datediff('day', o_orderdate, l_shipdate) AS days, datediff('month', o_orderdate, l_shipdate) AS months,
  datediff('quarter', o_orderdate, l_shipdate) AS quarters, datediff('year', o_orderdate, l_shipdate) AS years,
  ((CAST(l_shipdate AS DATE) - CAST(dayofweek(l_shipdate) AS INTEGER)) - (CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER))) // 7 AS weeks
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def fn_6(spark, d):
    line, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    a, b = F.col("o_orderdate"), F.col("l_shipdate")
    named = {"days": "day", "months": "month", "quarters": "qtr", "years": "year", "weeks": "week"}
    return line.join(o, line.l_orderkey == o.o_orderkey).select("l_orderkey", "l_partkey", "l_linenumber", *[dates.intck(u, a, b).cast("long").alias(n) for n, u in named.items()])


@query("fn_7_date_literal", "SELECT o_orderkey, upper(strftime(o_orderdate, '%d%b%Y')) AS written, CAST(o_orderdate AS DATE) AS read_back FROM orders")
def fn_7(spark, d):
    written = dates.write_date(F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", written.alias("written"), dates.date_literal(written).alias("read_back"))


@query("fn_8_missing", """
SELECT c_custkey, CASE WHEN o.k IS NULL THEN 1 ELSE 0 END AS no_order, coalesce(o.n, 0) AS n_orders FROM customer LEFT JOIN
  (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1) o ON c_custkey = o.k""")
def fn_8(spark, d):
    o = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", values.missing(F.col("n")).alias("no_order"), F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("fn_9_read_number", "SELECT o_orderkey, round(o_totalprice, 2) AS price, CAST(NULL AS DOUBLE) AS no_number FROM orders")
def fn_9b(spark, d):
    """Prices printed with separators and read again; what is no number is missing."""
    shown = table(spark, d, "orders").select("o_orderkey", values.picture(F.col("o_totalprice")).alias("text"), "o_orderstatus")
    return shown.select("o_orderkey", values.read_number(F.col("text")).alias("price"), values.read_number(F.concat(F.lit("no. "), "o_orderstatus")).alias("no_number"))


@query("fn_9_value_labels", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE 'Other' END AS status, n_name AS nation,
  CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'large' END AS size_label, format('{:t,}', CAST(floor(o_totalprice) AS BIGINT)) AS shown
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""".replace("{:t,}", "{:,}"))
def fn_9(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = values.label_by_table(o.join(c, o.o_custkey == c.c_custkey), "c_nationkey", table(spark, d, "nation"), "n_nationkey", "n_name", "nation")
    return rows.select("o_orderkey", values.value_labels(F.col("o_orderstatus"), {"F": "Filled", "O": "Open"}, "Other").alias("status"), "nation",
                       step.band("o_totalprice", [None, 100000, 300000, None], ["small", "medium", "large"]).alias("size_label"),
                       values.picture(F.floor("o_totalprice"), 0).alias("shown"))
