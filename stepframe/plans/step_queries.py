"""Sources and sinks, DATA-step operators and order-dependent operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepframe.operators import ordered, step
from stepframe.operators.reconcile import reconcile, report_as_json
from stepframe.operators.sql import run_sql, with_scalar
from stepframe.plans.catalog import query, table
from stepframe.sizing import ordinal, scratch_path
from stepframe.sources import files, manifest

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("io_1_read_csv", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def io_1(spark, d):
    path = scratch_path(spark, "csv")
    table(spark, d, "customer").write.option("header", True).csv(path)
    return files.read_csv(spark, path)


@query("io_2_write_parquet", "SELECT * FROM orders")
def io_2(spark, d):
    path = scratch_path(spark, "parquet")
    files.write_parquet(table(spark, d, "orders"), path, ["o_orderstatus"])
    return files.read_parquet(spark, path)


@query("io_3_proc_import", """
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, CAST(NULL AS VARCHAR) AS _corrupt_record FROM part""")
def io_3(spark, d):
    part, path = table(spark, d, "part"), scratch_path(spark, "import")
    part.write.option("header", True).option("sep", "|").csv(path)
    return files.proc_import(spark, path, "csv", part.schema, delimiter="|")


@query("io_4_proc_export", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def io_4(spark, d):
    part, path = table(spark, d, "part"), scratch_path(spark, "export")
    files.proc_export(part, path, "tab", replace=True)
    return spark.read.schema(part.schema).option("header", True).option("sep", "\t").csv(path)


@query("io_5_datalines", """
SELECT c_custkey AS id, c_name AS name, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment, c_acctbal AS balance
FROM customer""")
def io_5(spark, d):
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))
    line = F.concat(F.col("c_custkey"), F.lit(',"'), F.col("c_name"), F.lit('",'), segment, F.lit(","), F.col("c_acctbal"))
    return files.read_records(table(spark, d, "customer").select(line.alias("line")), "line", "id long, name string, segment string, balance double")


@query("io_6_named_frames", """
SELECT r.r_name, count(*) AS n_nations FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name""")
def io_6(spark, d):
    return run_sql(spark, "SELECT r.r_name, count(*) AS n_nations FROM n JOIN r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
                   {"n": table(spark, d, "nation"), "r": table(spark, d, "region")})


@query("io_7_choose_reference", """
SELECT 'both' AS given, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'csv', c_mktsegment, count(*), round(sum(c_acctbal), 2) FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment UNION ALL SELECT 'none', NULL, 0, NULL""")
def io_7(spark, d):
    """The typed file wins where both are given, though the CSV beside it holds other rows."""
    csv, typed = scratch_path(spark, "reference"), f"{d}/customer.parquet"
    table(spark, d, "customer").filter("c_acctbal > 0").write.option("header", True).csv(csv)
    found = None
    for given, chosen in {"both": files.choose_reference(spark, typed, csv, CUSTOMER), "csv": files.choose_reference(spark, csv=csv, schema=CUSTOMER)}.items():
        rows = chosen.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")).select(F.lit(given).alias("given"), "c_mktsegment", "n", "balance")
        found = rows if found is None else found.unionByName(rows)
    nothing = files.choose_reference(spark) is None
    return found.unionByName(spark.createDataFrame([("none" if nothing else "something", None, 0, None)], found.schema))


@query("io_8_report_json", """
SELECT '{"checks":[{"name":"schema_parity","status":"pass"},{"name":"row_count","status":"fail","detail":"ref=' || count(*) || ', actual='
  || count(*) FILTER (o_orderstatus <> 'P') || '"},{"name":"aggregate_parity","status":"pass"}]}' AS report FROM orders""")
def io_8(spark, d):
    orders = table(spark, d, "orders").select("o_orderstatus", "o_orderdate")
    path = scratch_path(spark, "report")
    files.write_report(reconcile(orders, orders.filter("o_orderstatus <> 'P'")), path)
    checks = spark.read.schema("seq int, name string, status string, detail string").json(path)
    return report_as_json(checks)


_PATHS = """
SELECT page_id, CASE WHEN url LIKE '%://m.%' THEN '__MACOSX/' WHEN url LIKE '%/fr/%' THEN '/proj\\' WHEN url LIKE '%/es/%' THEN 'a/../' ELSE 'src/' END
  || regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')
  || CASE WHEN url LIKE '%#top' THEN '.CSV' WHEN url LIKE '%?%' THEN '.pdf' WHEN url LIKE '%.org/%' THEN '/._x.sas' WHEN url LIKE '%.net/%' THEN '' ELSE '.sas' END AS path
FROM pages"""


@query("io_9_manifest", f"""
WITH p AS ({_PATHS}), n AS (SELECT page_id, path, ltrim(replace(path, '\\', '/'), '/') AS norm_path FROM p),
     e AS (SELECT *, regexp_extract(norm_path, '[^/]*$') AS name FROM n),
     x AS (SELECT *, lower(regexp_extract(ltrim(name, '.'), '[.][^.]*$')) AS extension FROM e)
SELECT page_id, norm_path, extension,
  CASE WHEN name = '' OR name LIKE '.\\_%' ESCAPE '\\' OR starts_with(norm_path, '__MACOSX/') OR list_contains(string_split(norm_path, '/'), '..') THEN 'ignored'
       WHEN extension IN ('.sas', '.sas7bdat', '.csv', '.log', '.xlsx', '.xls') THEN 'accepted' ELSE 'rejected' END AS status,
  CASE WHEN name = '' THEN 'directory' WHEN name LIKE '.\\_%' ESCAPE '\\' OR starts_with(norm_path, '__MACOSX/') THEN 'resource fork'
       WHEN list_contains(string_split(norm_path, '/'), '..') THEN 'path escapes the upload'
       WHEN extension NOT IN ('.sas', '.sas7bdat', '.csv', '.log', '.xlsx', '.xls')
       THEN 'Unsupported file type: ' || CASE WHEN extension = '' THEN '(none)' ELSE extension END END AS reason
FROM x""")
def io_9(spark, d):
    listing = run_sql(spark, _PATHS.replace("\\", "\\\\"), {"pages": table(spark, d, "pages")})
    return manifest.classify(listing).drop("path")


@query("ds_1_set_copy", "SELECT * FROM region")
def ds_1(spark, d):
    return step.copy(table(spark, d, "region"))


@query("ds_2_keep", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def ds_2(spark, d):
    return step.keep(table(spark, d, "customer"), "c_custkey c_name c_acctbal")


@query("ds_3_drop", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def ds_3(spark, d):
    return step.drop(table(spark, d, "customer"), "c_name c_mktsegment")


@query("ds_4_where", """
SELECT l_orderkey, l_linenumber, l_shipdate, l_discount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_discount > 0.05""")
def ds_4(spark, d):
    kept = step.where(table(spark, d, "lineitem"), "l_shipdate >= TIMESTAMP_NTZ '1997-01-01 00:00:00' AND l_discount > 0.05D")
    return step.keep(kept, "l_orderkey l_linenumber l_shipdate l_discount")


@query("ds_5_subsetting_if", """
SELECT o_orderkey, o_totalprice * 0.19 AS duty FROM orders WHERE o_totalprice * 0.19 > 20000 AND o_orderstatus <> 'F'""")
def ds_5(spark, d):
    taxed = step.assign(table(spark, d, "orders"), duty=F.col("o_totalprice") * 0.19)
    return step.keep(step.subsetting_if(taxed, (F.col("duty") > 20000) & (F.col("o_orderstatus") != "F")), "o_orderkey duty")


@query("ds_6_assignment", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge
FROM lineitem""")
def ds_6(spark, d):
    lines = step.assign(table(spark, d, "lineitem"), raw_net=F.col("l_extendedprice") * (1 - F.col("l_discount")), raw_charge=F.col("raw_net") * (1 + F.col("l_tax")))
    return lines.select("l_orderkey", "l_linenumber", F.round("raw_net", 4).alias("net"), F.round("raw_charge", 6).alias("charge"))


@query("ds_7_if_then_else", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band,
  CASE WHEN nullif(c_mktsegment, 'BUILDING') = 'MACHINERY' THEN 'heavy' ELSE 'other' END AS industry FROM customer""")
def ds_7(spark, d):
    c = F.col("c_acctbal")
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return table(spark, d, "customer").select("c_custkey", step.choose([(c < 0, "debt"), (c < 5000, "mid")], "high").alias("band"),
                                              step.choose([(segment == "MACHINERY", "heavy")], "other").alias("industry"))


@query("ds_8_banding", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 0 AND o_totalprice < 100000 THEN 'LOW' WHEN o_totalprice >= 100000 AND o_totalprice < 300000 THEN 'MID'
  WHEN o_totalprice >= 300000 THEN 'HIGH' END AS price_band FROM orders""")
def ds_8(spark, d):
    return table(spark, d, "orders").select("o_orderkey", step.band("o_totalprice", [0, 100000, 300000, None], ["LOW", "MID", "HIGH"]).alias("price_band"))


@query("ds_9_flag", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN nullif(l_discount, 0) >= 0.05 THEN 1 ELSE 0 END AS discounted,
  CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS bulk FROM lineitem""")
def ds_9(spark, d):
    some = F.nullif(F.col("l_discount"), F.lit(0.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", step.flag(some >= 0.05).alias("discounted"), step.flag(F.col("l_quantity") > 25).alias("bulk"))


@query("ds_10_select_when", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 WHEN o_orderpriority = '3-MEDIUM' THEN 2 ELSE 3 END AS lane FROM orders""")
def ds_10(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", step.choose([(p.isin("1-URGENT", "2-HIGH"), 1), (p == "3-MEDIUM", 2)], 3).alias("lane"))


@query("ds_11_rename", "SELECT n_nationkey AS nation_id, n_name AS nation, n_regionkey FROM nation")
def ds_11(spark, d):
    return step.rename(table(spark, d, "nation"), {"n_nationkey": "nation_id", "n_name": "nation"})


@query("ds_12_array", """
SELECT l_orderkey, l_partkey, l_linenumber, round(l_quantity * 1.5, 4) AS l_quantity, round(l_extendedprice * 1.5, 4) AS l_extendedprice,
  round(l_discount * 1.5, 4) AS l_discount, round(l_tax * 1.5, 4) AS l_tax FROM lineitem""")
def ds_12(spark, d):
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    scaled = step.over_array(table(spark, d, "lineitem"), measures, lambda c: F.round(c * 1.5, 4))
    return step.keep(scaled, ["l_orderkey", "l_partkey", "l_linenumber", *measures])


@query("ds_13_output_loop", """
SELECT l_orderkey, l_partkey, l_linenumber, i AS part_no, round(l_extendedprice / l_linenumber, 6) AS instalment
FROM lineitem, unnest(range(1, l_linenumber + 1)) AS u(i)""")
def ds_13(spark, d):
    rows = step.output_each(table(spark, d, "lineitem"), "part_no", 1, F.col("l_linenumber"))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", "part_no", F.round(F.col("l_extendedprice") / F.col("l_linenumber"), 6).alias("instalment"))


def _outputs():
    return {"open": F.col("o_orderstatus") == "O", "big": F.col("o_totalprice") > 250000, "urgent": F.col("o_orderpriority") == "1-URGENT"}


@query("ds_14_multi_output", """
SELECT 'open' AS output, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'big', o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000
UNION ALL SELECT 'urgent', o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'""")
def ds_14(spark, d):
    return step.tag_outputs(table(spark, d, "orders"), _outputs()).select("output", "o_orderkey", "o_totalprice")


@query("ds_14_written_outputs", """
SELECT 'open' AS output, count(*) AS n, min(o_orderkey) AS least FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'big', count(*), min(o_orderkey) FROM orders WHERE o_totalprice > 250000 UNION ALL SELECT 'urgent', count(*), min(o_orderkey) FROM orders WHERE o_orderpriority = '1-URGENT'""")
def ds_14b(spark, d):
    outputs = step.write_outputs(table(spark, d, "orders"), _outputs(), scratch_path(spark, "outputs"))
    counts = [df.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least")).select(F.lit(name).alias("output"), "n", "least") for name, df in outputs.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("ds_14_filtered_outputs", """
SELECT 'open' AS output, count(*) AS n FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'big', count(*) FROM orders WHERE o_totalprice > 250000""")
def ds_14c(spark, d):
    outputs = step.split_outputs(table(spark, d, "orders"), {"open": F.col("o_orderstatus") == "O", "big": F.col("o_totalprice") > 250000})
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("output"), "n") for name, df in outputs.items()]
    return counts[0].unionByName(counts[1])


@query("ds_16_metadata", """
SELECT 0 AS position, 'c_custkey' AS name, 'bigint' AS type, '' AS facts, count(c_custkey) AS n FROM customer UNION ALL SELECT 1, 'c_name', 'string', 'length=25', count(c_name) FROM customer
UNION ALL SELECT 2, 'c_acctbal', 'double', 'format=COMMA12.2; label=Balance', count(c_acctbal) FROM customer""")
def ds_16(spark, d):
    """The facts stay with their columns through a filter, a rename and back."""
    kept = step.keep(table(spark, d, "customer"), "c_custkey c_name c_acctbal")
    described = step.with_metadata(kept, {"c_acctbal": {"format": "COMMA12.2", "label": "Balance"}, "c_name": {"length": 25}})
    described = described.filter(F.col("c_custkey").isNotNull()).withColumnRenamed("c_name", "x").withColumnRenamed("x", "c_name")
    counts = described.agg(*[F.count(c).alias(c) for c in described.columns]).unpivot([], list(described.columns), "name", "n")
    entries = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return step.metadata_table(described).join(counts, "name").select("position", "name", "type", F.array_join(entries, "; ").alias("facts"), "n")


@query("ds_17_scalar_from_data", """
SELECT o_orderkey, o_totalprice, round(t.threshold, 4) AS threshold FROM orders, (SELECT avg(o_totalprice) AS threshold FROM orders) t
WHERE o_totalprice > t.threshold""")
def ds_17(spark, d):
    orders = table(spark, d, "orders")
    above = with_scalar(orders, "threshold", orders, F.avg("o_totalprice")).filter("o_totalprice > threshold")
    return above.select("o_orderkey", "o_totalprice", F.round("threshold", 4).alias("threshold"))


@query("ds_18_parameters", """
SELECT c_mktsegment AS level, count(*) AS n, round(max(c_acctbal), 2) AS top FROM customer WHERE c_acctbal > 100 GROUP BY c_mktsegment""")
def ds_18(spark, d):
    return run_sql(spark, """SELECT IDENTIFIER(:group_by) AS level, count(*) AS n, round(max(c_acctbal), 2) AS top
                             FROM cust WHERE c_acctbal > :cutoff GROUP BY IDENTIFIER(:group_by)""",
                   {"cust": table(spark, d, "customer")}, group_by="c_mktsegment", cutoff=100)


@query("od_1_first_last", """
SELECT event_id,
  CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id) = 1 THEN 1 ELSE 0 END AS first_user_id,
  CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC, ts DESC, event_id DESC) = 1 THEN 1 ELSE 0 END AS last_user_id,
  CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS first_event_type,
  CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1 THEN 1 ELSE 0 END AS last_event_type
FROM events""")
def od_1(spark, d):
    flagged = ordered.first_last_flags(table(spark, d, "events"), "user_id event_type", "ts event_id")
    return flagged.select("event_id", "first_user_id", "last_user_id", "first_event_type", "last_event_type")


@query("od_2_first_last_row", """
SELECT 'first' AS pick, o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1
UNION ALL
SELECT 'last', o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def od_2(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    first = ordered.first_of_group(orders, "o_custkey", "o_orderdate o_orderkey").withColumn("pick", F.lit("first"))
    last = ordered.last_of_group(orders, "o_custkey", "o_orderdate o_orderkey").withColumn("pick", F.lit("last"))
    return first.unionByName(last)


@query("od_3_running_total", """
SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS running FROM events""")
def od_3(spark, d):
    rows = ordered.retain(table(spark, d, "events"), "user_id", "ts event_id", {"running": ordered.total("value")})
    return rows.select("event_id", "user_id", F.round("running", 2).alias("running"))


@query("od_4_carry_forward", """
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""")
def od_4(spark, d):
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    rows = ordered.retain(table(spark, d, "events"), "user_id", "ts event_id", {"last_purchase": ordered.latest(bought)})
    return rows.select("event_id", "user_id", "last_purchase")


@query("od_5_running_extremes", """
SELECT event_id, min(value) OVER w AS low, max(value) OVER w AS high, count(*) OVER w AS n,
  count(CASE WHEN event_type = 'error' THEN 1 END) OVER w AS n_errors
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def od_5(spark, d):
    rows = ordered.retain(table(spark, d, "events"), "user_id", "ts event_id", {
        "low": ordered.lowest("value"), "high": ordered.highest("value"), "n": ordered.counter(),
        "n_errors": ordered.counter(F.when(F.col("event_type") == "error", 1))})
    return rows.select("event_id", "low", "high", "n", "n_errors")


@query("od_6_sequence_id", """
WITH c AS (SELECT event_id, user_id, ts, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type
  THEN 0 ELSE 1 END AS change FROM events)
SELECT event_id, user_id, CAST(sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM c""")
def od_6(spark, d):
    return ordered.sequence_ids(table(spark, d, "events"), "user_id", "ts event_id", "event_type", "run_id").select("event_id", "user_id", "run_id")


@query("od_7_capped_balance", """
WITH RECURSIVE n AS (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN -value * 4 ELSE value END AS amount,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  walk AS (SELECT event_id, user_id, rn, least(500.0, greatest(0.0, amount)) AS balance FROM n WHERE rn = 1
    UNION ALL SELECT n.event_id, n.user_id, n.rn, least(500.0, greatest(0.0, walk.balance + n.amount)) FROM walk JOIN n ON n.user_id = walk.user_id AND n.rn = walk.rn + 1)
SELECT event_id, user_id, round(balance, 4) AS balance FROM walk""")
def od_7(spark, d):
    amount = F.when(F.col("event_type") == "purchase", -F.col("value") * 4).otherwise(F.col("value"))
    events = table(spark, d, "events").select("event_id", "user_id", "ts", amount.alias("amount"))
    return ordered.capped_balance(events, "user_id", "ts event_id", "amount", 0.0, 500.0).select("event_id", "user_id", F.round("balance", 4).alias("balance"))


@query("od_8_lag", """
SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0 AS gap_seconds, lag(value, 2) OVER w AS value_2_back
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def od_8(spark, d):
    events = table(spark, d, "events")
    rows = ordered.lag(events, "user_id", "ts event_id", {"before": ("ts", 1), "value_2_back": ("value", 2)})
    kind = events.schema["ts"].dataType
    gap = (ordinal(F.col("ts"), kind) - ordinal(F.col("before"), kind)) / 1000000.0
    return rows.select("event_id", gap.alias("gap_seconds"), "value_2_back")
