"""Golden data of the step programs and the ways a result can be wrong."""

import pytest
from pyspark.sql import functions as F

from stepframe.operators import reconcile as rc
from stepframe.operators.matrix import bind_columns, read_vector, tiers
from stepframe.operators.sql import Datasets
from stepframe.operators.step import assign
from stepframe.plans.basic_etl import classified, department_summary
from stepframe.sources.files import read_records

# The golden input and outputs.
EMPLOYEES = [
    (1, "Alice", "Smith", "Engineering", 95000), (2, "Bob", "Jones", "Engineering", 72000), (3, "Carol", "White", "Marketing", 45000),
    (4, "David", "Brown", "Marketing", 38000), (5, "Eve", "Davis", "Engineering", 120000), (6, "Frank", "Miller", "HR", 52000),
    (7, "Grace", "Wilson", "HR", 48000), (8, "Henry", "Moore", "Marketing", 61000),
]
SUMMARY = [("Engineering", 3, 287000, 95666.666666666672, 28700.0), ("HR", 2, 100000, 50000.0, 10000.0), ("Marketing", 3, 144000, 48000.0, 14400.0)]
BY_SALARY = [5, 1, 2, 8, 6, 7, 3, 4]


@pytest.fixture(scope="module")
def employees(spark):
    return spark.createDataFrame(EMPLOYEES, "emp_id long, first_name string, last_name string, department string, salary long")


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(SUMMARY, "department string, headcount long, total_salary long, avg_salary double, total_bonus double")


def statuses(report):
    return {r.name: (r.status, r.detail) for r in report.collect()}


def test_department_summary_passes_all_checks(employees, golden):
    assert [s for s, _ in statuses(rc.reconcile(golden, department_summary(employees))).values()] == ["pass"] * 3


def test_bands_and_names(employees):
    rows = {r.emp_id: r for r in classified(employees).collect()}
    assert (rows[4].salary_band, rows[3].salary_band, rows[5].salary_band) == ("LOW", "MID", "HIGH")
    assert rows[1].full_name == "Alice Smith" and rows[1].annual_bonus == 9500.0


def test_two_sorts_keep_the_golden_order(employees):
    data = Datasets(employees.sparkSession, employees_work=assign(employees, annual_bonus=F.col("salary") * 0.10))
    data.sort("employees_work", "department salary", out="employees_by_dept")
    data.sort("employees_by_dept", "DESCENDING salary")
    assert [r.emp_id for r in data["employees_by_dept"].collect()] == BY_SALARY


def test_risk_tiers(spark):
    lines = spark.createDataFrame([("1001,35,5,0.72",), ("1002,28,2,0.55",), ("1003,42,10,0.88",), ("1004,23,1,0.31",), ("1005,,3,",)], "line string")
    scored = read_records(lines, "line", "employee_id double, age double, tenure double, score double")
    tiered = scored.select("employee_id", tiers(F.col("score"), [(0.75, 3), (0.50, 2)], 1).alias("risk_tier"))
    result = bind_columns("employee_id", read_vector(scored, "employee_id", "age"), tiered)
    assert {r.employee_id: (r.age, r.risk_tier) for r in result.collect()} == {1001: (35, 2), 1002: (28, 2), 1003: (42, 3), 1004: (23, 1), 1005: (None, 1)}


def test_extra_column_fails_schema(golden):
    status, detail = statuses(rc.reconcile(golden, golden.withColumn("extra_col", F.lit(0))))["schema_parity"]
    assert status == "fail" and detail == "missing=[], extra=['extra_col']"


def test_extra_row_fails_row_count(spark, golden):
    more = golden.unionByName(spark.createDataFrame([("X", 1, 1, 1.0, 0.1)], golden.schema))
    assert statuses(rc.reconcile(golden, more))["row_count"] == ("fail", "ref=3, actual=4")


def test_doubled_sum_fails_aggregates(golden):
    status, detail = statuses(rc.reconcile(golden, golden.withColumn("total_salary", F.col("total_salary") * 2)))["aggregate_parity"]
    assert status == "fail" and detail == "total_salary: ref_sum=531000.0000, actual_sum=1062000.0000, rel_diff=1.000000"


def test_class_mismatch(spark):
    ref, actual = spark.createDataFrame([(1.0,), (2.0,)], "amount double"), spark.createDataFrame([("1.0",), ("2.0",)], "amount string")
    assert statuses(rc.reconcile(ref, actual))["schema_parity"] == ("fail", "amount: ref=numeric, actual=object")


def test_booleans_and_integers_are_numeric(spark):
    ref, actual = spark.createDataFrame([(True,)], "x boolean"), spark.createDataFrame([(1,)], "x int")
    assert {s for s, _ in statuses(rc.reconcile(ref, actual)).values()} == {"pass"}


def test_no_numeric_columns_pass(spark):
    text = spark.createDataFrame([("A",), ("B",)], "dept string")
    assert statuses(rc.reconcile(text, text))["aggregate_parity"] == ("pass", None)


def test_zero_reference_needs_zero(spark):
    ref, actual = spark.createDataFrame([(0.0,), (0.0,)], "val double"), spark.createDataFrame([(1.0,), (2.0,)], "val double")
    assert statuses(rc.reconcile(ref, actual))["aggregate_parity"] == ("fail", "val: ref=0, actual=3.0")
    assert statuses(rc.reconcile(ref, ref))["aggregate_parity"] == ("pass", None)


def test_missing_column(spark):
    ref, actual = spark.createDataFrame([(1.0,)], "val double"), spark.createDataFrame([(1.0,)], "other double")
    assert statuses(rc.reconcile(ref, actual))["aggregate_parity"] == ("fail", "val: missing in actual")


@pytest.mark.parametrize(("factor", "status"), [(1.001, "pass"), (1.0011, "fail"), (0.9989, "fail")])
def test_tolerance_is_strict(spark, factor, status):
    ref, actual = spark.createDataFrame([(1000.0,)], "v double"), spark.createDataFrame([(1000.0 * factor,)], "v double")
    assert statuses(rc.reconcile(ref, actual))["aggregate_parity"][0] == status


def test_nan_and_null_add_nothing(spark):
    ref = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    actual = spark.createDataFrame([(1.0,), (None,), (None,)], "v double")
    assert {s for s, _ in statuses(rc.reconcile(ref, actual)).values()} == {"pass"}
    empty = spark.createDataFrame([(None,)], "v double")
    assert {s for s, _ in statuses(rc.reconcile(empty, empty)).values()} == {"pass"}


def test_no_reference_gives_no_checks_and_passes(spark, golden):
    report = rc.run_checks(spark, None, lambda: golden)
    assert report.count() == 0
    row = rc.summarize_checks(report).first()
    assert row.all_passed and row.row_count_match and row.column_match and row.diff_summary == "no checks run"


@pytest.mark.parametrize("build", [
    lambda g: g.select("no_such_column"), lambda g: 42, lambda g: g.withColumn("total_bonus", F.raise_error(F.lit("broken step")).cast("double"))])
def test_execution_failures_become_one_check(spark, golden, build):
    rows = rc.run_checks(spark, lambda: golden, lambda: build(golden)).collect()
    assert [(r.name, r.status) for r in rows] == [("execution", "fail")] and len(rows[0].detail) <= 300


def test_summary_joins_details(golden):
    row = rc.summarize_checks(rc.reconcile(golden, golden.filter("headcount > 2"))).first()
    assert (row.total, row.passed, row.failed, row.all_passed, row.row_count_match, row.column_match) == (3, 1, 2, False, False, True)
    assert row.diff_summary.startswith("ref=3, actual=2; headcount: ref_sum=8.0000, actual_sum=6.0000")
    assert rc.summarize_checks(rc.reconcile(golden, golden)).first().diff_summary == "3/3 checks passed"
