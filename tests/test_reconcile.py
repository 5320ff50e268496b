"""Keyed and keyless differences, classification and streaming."""

import pytest
from pyspark.sql import functions as F

from stepframe.operators import reconcile as rc
from stepframe.plans import catalog
from stepframe.semantics import StepError
from stepframe.sizing import scratch_path
from stepframe.streaming.batches import read_reports, reconcile_stream


@pytest.fixture(scope="module")
def pair(spark):
    ref = spark.createDataFrame([(1, 10.0, "a"), (2, 20.0, "b"), (3, None, "c"), (4, 40.0, None), (5, float("nan"), "e"), (None, 1.0, "n")], "k int, v double, s string")
    actual = spark.createDataFrame([(1, 10.0, "a"), (2, 20.5, "B"), (3, 30.0, "c"), (4, 40.0, None), (5, None, "e"), (6, 60.0, "f"), (None, 2.0, "n")], "k int, v double, s string")
    return ref, actual


def test_hash_diff(pair):
    assert {(r.k, r.difference) for r in rc.hash_diff(*pair, "k").collect()} == {(2, "changed"), (3, "changed"), (6, "extra"), (None, "changed")}
    assert {(r.k, r.difference) for r in rc.hash_diff(pair[1], pair[0], "k").collect()} == {(2, "changed"), (3, "changed"), (6, "missing"), (None, "changed")}


def test_nulls_in_different_places_differ(spark):
    a, b = spark.createDataFrame([(1, "x", None)], "k int, p string, q string"), spark.createDataFrame([(1, None, "x")], "k int, p string, q string")
    assert rc.hash_diff(a, b, "k").count() == 1


def test_large_integers_keep_their_digits(spark):
    a, b = spark.createDataFrame([(1, 2**53)], "k int, v long"), spark.createDataFrame([(1, 2**53 + 1)], "k int, v long")
    assert rc.hash_diff(a, b, "k").count() == 1
    assert [(r.ref_value, r.actual_value, r.delta) for r in rc.record_diff(a, b, "k").collect()] == [("9007199254740992", "9007199254740993", 1.0)]
    assert rc.hash_diff(a, a.withColumn("v", F.col("v").cast("decimal(20,0)")), "k").count() == 0


def test_integer_and_double_columns_compare(spark):
    a, b = spark.createDataFrame([(1, 5)], "k int, v int"), spark.createDataFrame([(1, 5.0)], "k int, v double")
    assert rc.hash_diff(a, b, "k").count() == 0 and rc.record_diff(a, b, "k").count() == 0


def test_record_diff(pair):
    got = {(r.k, r.column): (r.ref_value, r.actual_value, r.delta) for r in rc.record_diff(*pair, "k").collect()}
    assert got == {(2, "v"): ("20.0", "20.5", 0.5), (2, "s"): ("b", "B", None), (3, "v"): (None, "30.0", None), (None, "v"): ("1.0", "2.0", 1.0)}


@pytest.mark.parametrize(("options", "columns"), [({"atol": 0.5}, {"s"}), ({"atol": 0.4}, {"s", "v"}), ({"rtol": 0.025}, {"s"}), ({"rtol": 0.02}, {"s", "v"})])
def test_tolerances(pair, options, columns):
    assert {r.column for r in rc.record_diff(*pair, "k", **options).filter("k = 2").collect()} == columns


def test_repeated_keys_fail(spark, pair):
    twice = pair[0].unionByName(pair[0].filter("k = 1"))
    assert [tuple(r) for r in rc.duplicate_keys(twice, "k").collect()] == [(1, 2)]
    assert ("duplicate",) in {(r.difference,) for r in rc.hash_diff(twice, pair[1], "k").collect()}
    with pytest.raises(Exception, match="repeated key"):
        rc.record_diff(twice, pair[1], "k").collect()
    assert rc.record_diff(twice, pair[1], "k", allow_duplicates=True).count() == 4


def test_one_sided_keys(pair):
    assert [tuple(r) for r in rc.one_sided_keys(*pair, "k").collect()] == [(6, "actual_only")]


def test_multiset_diff(spark):
    a, b = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "s string"), spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "s string")
    assert sorted(tuple(r) for r in rc.multiset_diff(a, b).collect()) == [("x", 2, 1), ("y", 1, 2)]
    with pytest.raises(StepError, match="different columns"):
        rc.multiset_diff(a, b.withColumnRenamed("s", "t"))


def test_counts_and_samples(pair):
    differences = rc.record_diff(*pair, "k")
    assert {r.column: (r.mismatches, r.largest_delta) for r in rc.mismatch_counts(differences).collect()} == {"v": (3, 1.0), "s": (1, None)}
    assert rc.mismatch_sample(differences, "k", 1).count() == 2


def test_count_and_average_parity(spark):
    ref, actual = spark.createDataFrame([(2.0,), (4.0,)], "v double"), spark.createDataFrame([(6.0,), (None,)], "v double")
    row = rc.aggregate_comparison(ref, actual).first()
    assert (row.sum_status, row.count_status, row.avg_status) == ("pass", "fail", "fail")


def test_unknown_keys_fail(pair):
    with pytest.raises(StepError, match="unknown key"):
        rc.hash_diff(*pair, "nope")


def test_schema_comparison(pair):
    ref, actual = pair
    got = {r.column: r.status for r in rc.schema_comparison(ref, actual.drop("s").withColumn("v", F.lit("x")).withColumn("w", F.lit(1))).collect()}
    assert got == {"k": "pass", "s": "missing", "v": "class_mismatch", "w": "extra"}


def test_distribution(spark):
    ref = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    found = {r.p: (r.ref_value, r.status) for r in rc.distribution_comparison(ref, ref.select(F.when(F.col("v") > 900, F.col("v") * 2).otherwise(F.col("v")).alias("v"))).collect()}
    assert found == {0.05: (50.0, "pass"), 0.25: (250.0, "pass"), 0.5: (500.0, "pass"), 0.75: (750.0, "pass"), 0.95: (950.0, "fail")}


def test_classification(spark):
    checks = spark.createDataFrame([(1, "schema_parity", "fail", "missing=['a'], extra=[]"), (2, "row_count", "fail", "ref=1, actual=2"), (3, "aggregate_parity", "fail", "x"), (4, "schema_parity", "fail", "a: ref=numeric, actual=object"), (5, "row_count", "pass", None)], rc.CHECKS)
    assert {r.seq: r.pattern for r in rc.classify_failures(checks).collect()} == {1: "column name mismatch", 2: "row count mismatch", 3: "column value mismatch", 4: "type mismatch"}


def test_report_json(pair):
    text = rc.report_as_json(rc.reconcile(pair[0], pair[0])).first().report
    assert text == '{"checks":[{"name":"schema_parity","status":"pass"},{"name":"row_count","status":"pass"},{"name":"aggregate_parity","status":"pass"}]}'


def test_stream_goes_on_and_never_repeats(spark):
    folder, reports, progress = (scratch_path(spark, x) for x in ("in", "rep", "cp"))
    source = spark.range(100).select("id", (F.col("id") * 1.0).alias("v"))

    def run():
        stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        reconcile_stream(stream, lambda batch: source.join(batch.select("id"), "id", "left_semi"), reports, progress)
        return read_reports(spark, reports)

    source.filter("id < 50").coalesce(1).write.mode("append").parquet(folder)
    assert run().count() == 3
    assert run().count() == 3
    source.filter("id >= 50").coalesce(1).write.mode("append").parquet(folder)
    found = run()
    assert found.count() == 6 and found.filter("status <> 'pass'").count() == 0
    assert {r.batch_id for r in found.collect()} == {0, 1}


def test_decimals_keep_all_digits(spark):

    def pair(left, left_type, right, right_type):
        return [spark.createDataFrame([(1, v)], "k int, v string").withColumn("v", F.col("v").cast(t)) for v, t in ((left, left_type), (right, right_type))]

    for args in (("9007199254740993", "long", "9007199254740992", "decimal(20,0)"), ("12345678901234567.891", "decimal(20,3)", "12345678901234567.8922", "decimal(21,4)"),
                 ("1234567890123456789012345678901234567", "decimal(38,0)", "1.5", "decimal(38,30)")):
        assert [r.difference for r in rc.hash_diff(*pair(*args), "k").collect()] == ["changed"]
        assert rc.record_diff(*pair(*args), "k").count() == 1
    same = pair("2.50", "decimal(38,2)", "2.5", "decimal(38,30)")
    assert rc.hash_diff(*same, "k").count() == 0 and rc.record_diff(*same, "k").count() == 0


def test_digests_open_only_what_differs(spark):
    ref = spark.range(20_000).selectExpr("id AS k", "id * 3 AS v", "CAST(id AS STRING) AS t").repartition(6)
    same = ref.repartition(3).withColumn("k", F.col("k").cast("int"))
    assert rc.hash_diff(ref, same, "k", unique_keys=True).count() == 0
    changed = ref.withColumn("v", F.when(F.col("k") == 777, 1).otherwise(F.col("v"))).where("k <> 5").unionByName(spark.sql("SELECT 99999L AS k, 1L AS v, 'x' AS t"))
    got = {(r.k, r.difference) for r in rc.hash_diff(ref, changed, "k", unique_keys=True).collect()}
    assert got == {(777, "changed"), (5, "missing"), (99999, "extra")} == {(r.k, r.difference) for r in rc.hash_diff(ref, changed, "k").collect()}
    assert {(r.k, r.side) for r in rc.one_sided_keys(ref, changed, "k").collect()} == {(5, "ref_only"), (99999, "actual_only")}
    assert [(r.k, r.column, r.actual_value) for r in rc.record_diff(ref, changed, "k", unique_keys=True).collect()] == [(777, "v", "1")]
    everything = ref.withColumn("v", F.col("v") + 1)
    assert rc.hash_diff(ref, everything, "k", unique_keys=True).count() == 20_000


def test_equal_tables_shuffle_no_rows(spark):
    from stepframe.operators.digests import differing_ranges

    hashed = spark.range(50_000).selectExpr("xxhash64(id) AS __k", "xxhash64(id, 1) AS __r")
    bits, ranges = differing_ranges(hashed, hashed.repartition(3))
    assert (bits, ranges.count()) == (9, 0)
    off = hashed.withColumn("__r", F.when(F.col("__k") % 25_000 == 0, F.lit(0).cast("long")).otherwise(F.col("__r")))
    bits, ranges = differing_ranges(hashed, off)
    assert bits == 18 and 1 <= ranges.count() <= 20


@pytest.mark.parametrize("sizes", [(2**11, 2**14), (16, 2**11), (16,)])
def test_multiset_differences_are_peeled(spark, sizes):
    ref = spark.range(3000).selectExpr("id % 1000 AS a", "IF(id % 1000 = 4, NULL, CAST(id % 1000 AS STRING)) AS b", "CAST(IF(id % 1000 = 9, 'NaN', '1.5') AS DOUBLE) AS c").repartition(5)
    actual = ref.where("a <> 7").withColumn("b", F.when(F.col("a") % 20 == 3, "off").otherwise(F.col("b"))).unionByName(ref.where("a = 11").limit(1)).repartition(3)
    got = {(r.a, r.b, str(r.c)): (r.ref_copies, r.actual_copies) for r in rc.multiset_diff(ref, actual, sizes=sizes).collect()}
    want = {(7, "7", "1.5"): (3, 0), (11, "11", "1.5"): (3, 4)}
    for a in range(3, 1000, 20):
        want |= {(a, str(a), "1.5"): (3, 0), (a, "off", "1.5"): (0, 3)}
    assert got == want
    assert rc.multiset_diff(ref, ref.repartition(2), sizes=sizes).count() == 0


def test_peeling_gets_stuck_when_cells_are_too_few(spark):
    from stepframe.operators.digests import differing_hashes

    none = spark.range(0).selectExpr("xxhash64(id) AS __h")
    many = spark.range(500).selectExpr("xxhash64(id) AS __h")
    assert differing_hashes(many, none, sizes=(16,)) is None
    found = differing_hashes(many.unionByName(many), none, sizes=(16, 1024))
    assert len(found) == 500 and set(found.values()) == {2}
    assert differing_hashes(none, none) == {}


def test_full_report(spark):
    ref = spark.createDataFrame([(i, float(i), "t") for i in range(100)], "k int, v double, t string")
    same = {r.name: (r.status, r.detail) for r in rc.full_report(ref, ref, "k").collect()}
    assert list(same) == ["schema_parity", "row_count", "aggregate_parity", "count_parity", "mean_parity", "row_hash", "distribution", "sample"]
    assert set(same.values()) == {("pass", None)}
    off = ref.withColumn("v", F.when(F.col("k") >= 90, F.col("v") * 2).when(F.col("k") != 3, F.col("v"))).where("k <> 50")
    got = {r.name: (r.status, r.detail) for r in rc.full_report(ref, off, "k", per_column=2).collect()}
    assert got["row_hash"] == ("fail", "changed=11; missing=1")
    assert got["count_parity"] == ("fail", "k: ref_count=100, actual_count=99; v: ref_count=100, actual_count=98")
    assert got["mean_parity"][0] == "fail" and got["mean_parity"][1].startswith("v: ref_mean=49.5000") or "v: ref_mean=49.5000" in got["mean_parity"][1]
    assert "v p95: ref=94.0500" in got["distribution"][1]
    assert got["sample"] == ("fail", "v at 3: ref=3.0, actual=; v at 90: ref=90.0, actual=180.0") or "v at 90: ref=90.0, actual=180.0" in got["sample"][1]


def test_groups_are_judged_as_their_rows_arrive(spark):
    import os

    from stepframe.streaming.running import group_reports, reconcile_running

    folder, reports, progress = (scratch_path(spark, x) for x in ("in", "rep", "cp"))
    reference = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("c", None), (None, 7.0), ("never", 1.0)], "g string, v double")

    def send(*rows):
        spark.createDataFrame(list(rows), "g string, v double").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(reference.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        reconcile_running(stream, reference, "g", reports, progress)
        return {r.g: (r.status, r.actual_rows, r.detail) for r in group_reports(spark, reports, reference, "g").collect()}

    first = send(("a", 1.0), ("b", 6.0), (None, 7.0), ("x", 1.0))
    assert first == {"a": ("open", 1, None), "b": ("fail", 1, "v: ref_sum=5.0000, actual_sum=6.0000"), None: ("pass", 1, None), "x": ("unexpected", 1, None),
                     "c": ("missing", 0, None), "never": ("missing", 0, None)}
    # A late row completes its group, another is one too many.
    second = send(("a", 2.0), ("b", 5.0), ("c", None))
    want = first | {"a": ("pass", 2, None), "b": ("fail", 2, "ref=1, actual=2"), "c": ("pass", 1, None)}
    assert second == want
    # The driver was lost before the batch was noted as done: it is run again.
    commits = f"{progress.removeprefix('file:')}/commits"
    last = max(int(x) for x in os.listdir(commits) if x.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    assert send(("never", 1.0)) == want | {"never": ("pass", 1, None)}


def test_sums_of_whole_numbers_do_not_depend_on_the_order_of_rows(spark):
    numbers = [10**17 + 7, *[1] * 40, 10**17 + 9, *[3] * 40]
    texts = set()
    for order in (numbers, numbers[::-1], sorted(numbers)):
        actual = spark.createDataFrame([(n,) for n in order], "v long").coalesce(1)
        texts.add(rc.reconcile(spark.createDataFrame([(5,)], "v long"), actual).filter("seq = 3").first()["detail"])
    # The nearest double of 200000000000000176, with all its digits.
    assert {t.split(", ")[1] for t in texts} == {"actual_sum=200000000000000192.0000"} and len(texts) == 1


def test_sums_past_a_long_and_of_decimals(spark):
    ref = spark.createDataFrame([(2**62, None)] * 4, "v long, d decimal(10,2)").withColumn("d", F.lit("0.10").cast("decimal(10,2)"))
    got = {r.column: r.ref_sum for r in rc.aggregate_comparison(ref, ref).collect()}
    assert got == {"v": 2.0**64, "d": 0.4}


def test_schema_parity_counts_the_rows_of_each_variant(spark):
    catalog.load_all()
    folder = "/root/testdata/sf0.001"
    rows = catalog.QUERIES["rc_1_schema_parity"](spark, folder).collect()
    n = spark.read.parquet(f"{folder}/customer.parquet").count()
    assert [(r.seq, r.status, r.n_rows) for r in sorted(rows)] == [(1, "fail", n), (2, "fail", n), (3, "pass", n)]
