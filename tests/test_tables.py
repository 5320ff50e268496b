"""Steps, combining, summaries, matrices and functions on small tables."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepframe.functions import dates, values
from stepframe.operators import combine, matrix, step, summaries
from stepframe.operators.sql import Datasets, recurse, run_sql, scalar
from stepframe.semantics import StepError, by_keys, from_sas_date, is_missing, nan_to_null, normalize_names, to_sas_date


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_names(spark):
    assert normalize_names(spark.createDataFrame([(1, 2)], ["Emp.ID", "Salary"])).columns == ["emp_id", "salary"]
    with pytest.raises(StepError, match="collide"):
        normalize_names(spark.createDataFrame([(1, 2)], "`A.b` int, a_b int"))


def test_unknown_columns_fail_loudly(spark):
    df = spark.range(3)
    for call in (lambda: step.keep(df, "nope"), lambda: step.drop(df, "nope"), lambda: step.rename(df, {"nope": "x"}), lambda: step.sort(df, "nope"),
                 lambda: summaries.means(df, "nope"), lambda: step.with_metadata(df, {"nope": {}})):
        with pytest.raises(StepError, match="nope"):
            call()


def test_by_clause():
    assert [(k.name, k.descending) for k in by_keys("a DESCENDING b c descending d ASCENDING e")] == [("a", False), ("b", True), ("c", False), ("d", True), ("e", False)]


def test_sort_positions_of_missing(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "a int")
    order = lambda **o: [r.a for r in step.sort(df, o.pop("by", "a"), **o).collect()]
    assert order() == [None, 1, 2] and order(na_position="last") == [1, 2, None]
    assert order(by="DESCENDING a") == [2, 1, None] and order(by="DESCENDING a", na_position="first") == [None, 2, 1]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(is_missing(df, "x")).collect()] == [False, True, True]
    assert [r[0] for r in nan_to_null(df).collect()] == [1.0, None, None]


def test_conditions_fall_through_when_missing(spark):
    df = spark.createDataFrame([(1,), (None,), (9,)], "x int")
    chosen = df.select(step.choose([(F.col("x") > 5, "big")], "rest").alias("c"), step.flag(F.col("x") > 5).alias("f"), step.band("x", [0, 5, None], ["lo", "hi"]).alias("b"))
    assert [tuple(r) for r in chosen.collect()] == [("rest", 0, "lo"), ("rest", 0, None), ("big", 1, "hi")]


def test_band_edges_are_half_open(spark):
    df = spark.createDataFrame([(39999,), (40000,), (79999,), (80000,)], "x int")
    assert [r[0] for r in df.select(step.band("x", [0, 40000, 80000, None], ["LOW", "MID", "HIGH"])).collect()] == ["LOW", "MID", "MID", "HIGH"]


def test_outputs(spark):
    df = spark.createDataFrame([(1, 2), (2, 0)], "id int, n int")
    assert [tuple(r) for r in step.output_each(df, "i", 1, F.col("n")).orderBy("i").collect()] == [(1, 2, 1), (1, 2, 2)]
    rows = step.output_rows(df, [{"k": F.lit("a"), "v": F.col("n")}, {"k": F.lit("b"), "v": F.col("n") * 2}])
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 2, "a", 2), (1, 2, "b", 4), (2, 0, "a", 0), (2, 0, "b", 0)]
    split = step.split_outputs(df, {"all": F.lit(True), "some": F.col("n") > 0})
    assert (split["all"].count(), split["some"].count()) == (2, 1)


def test_metadata_is_kept(spark):
    df = step.with_metadata(spark.range(1), {"id": {"format": "Z5.", "length": 8}})
    df = step.with_metadata(df, {"id": {"label": "Key"}})
    assert df.schema["id"].metadata == {"format": "Z5.", "length": 8, "label": "Key"}
    assert step.metadata_table(df).first().metadata["label"] == "Key"


def test_assignments_see_earlier_ones(spark):
    assert step.assign(spark.range(1), a=F.lit(2), b=F.col("a") * 3).first().b == 6


def test_match_merge(spark):
    a = spark.createDataFrame([(1, "a1", 10), (2, "a2", 20), (None, "a0", 0)], "k int, name string, amount int")
    b = spark.createDataFrame([(2, 200, "x"), (2, 201, "y"), (3, None, "z"), (None, 5, "n")], "k int, amount int, tag string")
    rows = lambda **o: sorted((tuple(r) for r in combine.match_merge(a, b, "k", **o).collect()), key=str)
    assert rows() == sorted([(1, "a1", 10, None), (2, "a2", 200, "x"), (2, "a2", 201, "y"), (3, None, None, "z"), (None, "a0", 5, "n")], key=str)
    assert (2, "a2", 20, "x") in rows(overlap="left") and (3, None, None, "z") in rows(overlap="left")
    assert combine.match_merge(a, b, "k", "suffix").columns == ["k", "name", "amount_left", "amount_right", "tag"]
    assert rows() == sorted(set(rows()), key=str)
    with pytest.raises(StepError, match="both sides repeat"):
        combine.match_merge(b, b, "k")
    assert combine.match_merge(b, b, "k", many_to_many=True).count() == 6
    with pytest.raises(StepError, match="overlap"):
        combine.match_merge(a, b, "k", "both")


def test_missing_by_values_match(spark):
    a, b = spark.createDataFrame([(None, "x"), (1, "y")], "k int, v string"), spark.createDataFrame([(None, 5), (2, 6)], "k int, w int")
    for unique in (False, True):
        got = {(r.k, r.v, r.w) for r in combine.match_merge(a, b, "k", unique=unique).collect()}
        assert got == {(None, "x", 5), (1, "y", None), (2, None, 6)}


def test_merge_audit(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (None,)], "k int")
    got = {r.presence: (r["keys"], r.left_rows, r.right_rows) for r in combine.merge_audit(a, b, "k").collect()}
    assert got == {"matched": (2, 2, 2), "left_only": (1, 2, 0), "right_only": (1, 0, 1)}


def test_group_statistics_keep_missing_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 5)], "g string, x int")
    assert sorted((str(r.g), r.x, r.t) for r in combine.with_group_statistics(df, "g", t=F.sum("x")).collect()) == [("None", 5, 5), ("a", 1, 4), ("a", 3, 4)]


def test_concatenate_and_append(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, n string"), spark.createDataFrame([(2, 3.0)], "id int, v double")
    assert [tuple(r) for r in combine.concatenate(a, b).orderBy("id").collect()] == [(1, "x", None), (2, None, 3.0)]
    with pytest.raises(Exception, match="(?i)column"):
        combine.append(a, b)


def test_sql_names_and_parameters(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "x long, y long")
    assert run_sql(spark, "SELECT * FROM t WHERE x > 1", {"t": t}).count() == 2
    assert run_sql(spark, "SELECT max(IDENTIFIER(:c)) AS m FROM t WHERE x < :limit", {"t": t}, c="y", limit=3).first().m == 20
    with pytest.raises(TypeError, match="must be a DataFrame"):
        run_sql(spark, "SELECT 1", {"t": [1]})
    data = Datasets(spark, t=t)
    data.create_table("Work.Two", "SELECT x FROM t WHERE x = :v", v=2)
    assert "work.two" in data and data["WORK.TWO"].first().x == 2
    with pytest.raises(StepError, match="unknown dataset"):
        data["nope"]
    with pytest.raises(TypeError):
        data["bad"] = 3
    assert scalar(t, F.avg("y")) == 20


def test_recursion(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "a int, b int")
    step_on = lambda above: edges.join(above.withColumnRenamed("n", "a"), "a").select(F.col("b").alias("n"))
    rows = recurse(spark.createDataFrame([(1,)], "n int"), step_on).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0), (2, 1), (3, 1), (3, 2)]
    ring = spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")
    with pytest.raises(StepError, match="circle"):
        recurse(spark.createDataFrame([(1,)], "n int"), lambda above: ring.join(above.withColumnRenamed("n", "a"), "a").select(F.col("b").alias("n")))
    sql = run_sql(spark, "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT b FROM r JOIN e ON e.a = r.n) SELECT n FROM r", {"e": edges})
    assert sorted(r.n for r in sql.collect()) == [1, 2, 3, 3]


def test_exact_quantiles_of_large_tables(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.8 else rng.choice(["a", None]), rng.choice([rng.gauss(0, 1), 1e9 * rng.random(), 7.0]), rng.randrange(5)) for _ in range(6000)]
    df = spark.createDataFrame(data, "g string, x double, y int").repartition(6)
    ps = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r.g, r.variable, r.p): r.quantile for r in summaries.quantiles(df, "g", "x y", ps).collect()}
    for g in ("hot", "a", None):
        for i, v in ((1, "x"), (2, "y")):
            column = [r[i] for r in data if r[0] == g]
            for p in ps:
                assert got[(g, v, p)] == pytest.approx(float(np.quantile(column, p)), rel=1e-12)
    assert len(got) == 30


def test_quantiles_of_uneven_values(spark):
    rng = random.Random(8)
    columns = {
        "constant": [7.0] * 3000,
        "outlier": [1e300, -1e300, *[rng.random() for _ in range(2998)]],
        "scales": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(3000)],
        "close": [1.0 + k * 2**-52 for k in range(3000)],
        "infinite": [float("inf")] * 1000 + [float("-inf")] * 900 + [rng.random() for _ in range(1100)],
        "tiny": [0.0, 5e-324, 1e-323, -5e-324] * 750,
        "widest": [1.7e308, -1.7e308, 1e308, 0.0] * 750,
    }
    ps = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(7)
    got = {(r.variable, r.p): r.quantile for r in summaries.quantiles(df, (), list(columns), ps).collect()}
    for name, values in columns.items():
        values = sorted(values)
        for p in ps:
            at = (len(values) - 1) * p
            low, high = values[math.floor(at)], values[math.ceil(at)]
            want = low if low == high else low + (high - low) * (at - math.floor(at))
            assert got[name, p] == want or got[name, p] == pytest.approx(want, rel=1e-12), (name, p)
    assert summaries.quantiles(df.limit(0), (), "constant", ps).count() == 0


def test_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("a", float("nan")), ("b", 5.0), (None, 9.0)], "g string, x double")
    got = {r.g: r for r in summaries.means(df, "x", "g").collect()}
    assert set(got) == {"a", "b"}
    a = got["a"]
    assert (a.n_x, a.nmiss_x, a.sum_x, a.mean_x, a.min_x, a.max_x, a.median_x) == (2, 2, 3.0, 1.5, 1.0, 2.0, 1.5)
    assert a.std_x == pytest.approx(statistics.stdev([1.0, 2.0])) and got["b"].std_x is None
    assert {r.g for r in summaries.means(df, "x", "g", missing=True).collect()} == {"a", "b", None}
    overall = summaries.means(df, "x").first()
    assert (overall.variable, overall.n, overall.nmiss, overall.median) == ("x", 4, 2, 3.5)


def test_frequencies(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string")
    assert [(r.v, r.frequency, r.cum_frequency) for r in summaries.frequencies(df, "v").orderBy("v").collect()] == [("a", 1, 1), ("b", 2, 3)]
    assert summaries.frequencies(df, "v", missing=True).orderBy("cum_frequency").first().percent == 25.0


@pytest.mark.parametrize(("table", "statistic", "p"), [([[10, 20], [20, 10]], 20 / 3, 0.009823274507519235), ([[1, 2, 3], [3, 2, 1]], 2.0, 0.36787944117144233), ([[5, 0], [0, 7]], 12.0, 0.0005320055051392501)])
def test_chi_square(spark, table, statistic, p):
    rows = [(f"r{i}", f"c{j}") for i, line in enumerate(table) for j, n in enumerate(line) for _ in range(n)]
    found = summaries.chi_square(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert found.statistic == pytest.approx(statistic) and found.p_value == pytest.approx(p, rel=1e-9)


def test_transpose_round_trip(spark):
    wide = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, None)], "id int, a double, b double")
    long = summaries.transpose_long(wide, "id", "a b")
    assert long.columns == ["id", "_name_", "col1"] and long.count() == 4
    assert sorted(tuple(r) for r in summaries.transpose_wide(long, "id", "_name_", "col1", ["a", "b"]).collect()) == sorted(tuple(r) for r in wide.collect())


def test_matrix_operators(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(a)], "id int, v array<double>").repartition(3)

    def dense(long, shape):
        out = np.zeros(shape)
        for r in long.collect():
            out[r.i, r.j] = r.v
        return out

    assert np.allclose(dense(matrix.gram(df, "v"), (5, 5)), a.T @ a)
    assert np.allclose(dense(matrix.covariance(df, "v"), (5, 5)), np.cov(a.T))
    assert np.allclose(dense(matrix.correlation(df, "v"), (5, 5)), np.corrcoef(a.T))
    long = matrix.to_long(df, "id", "v")
    assert np.allclose(dense(matrix.multiply(matrix.transpose(long), long), (5, 5)), a.T @ a)
    z = matrix.z_scores(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double"), "x")
    assert sorted(r.z_x for r in z.collect()) == [-1.0, 0.0, 1.0]


def test_dates(spark):
    assert str(one(spark, from_sas_date(F.lit(0)))) == "1960-01-01" and one(spark, to_sas_date(F.lit("1960-01-31").cast("date"))) == 30
    assert str(one(spark, dates.date_literal(F.lit("01JAN2023")))) == "2023-01-01" and one(spark, dates.date_literal(F.lit("31FEB2023"))) is None
    assert one(spark, dates.write_date(F.lit("2023-01-01").cast("date"))) == "01JAN2023"


@pytest.mark.parametrize(("unit", "day", "n", "align", "want"), [
    ("month", "2023-01-31", 1, "begin", "2023-02-01"), ("month", "2023-01-31", 1, "same", "2023-02-28"), ("month", "2023-03-15", -1, "end", "2023-02-28"), ("qtr", "2023-05-10", 0, "begin", "2023-04-01"),
    ("qtr", "2023-12-31", 1, "end", "2024-03-31"), ("semiyear", "2023-05-10", 1, "begin", "2023-07-01"), ("year", "2023-05-10", -1, "begin", "2022-01-01"), ("year", "2024-02-29", 1, "same", "2025-02-28"),
    ("week", "2023-01-01", 0, "begin", "2023-01-01"), ("week", "2023-01-07", 0, "begin", "2023-01-01"), ("week", "2023-01-07", 1, "end", "2023-01-14"), ("week", "2023-01-05", 1, "same", "2023-01-12"), ("day", "2023-01-31", 1, "begin", "2023-02-01")])
def test_intnx(spark, unit, day, n, align, want):
    assert str(one(spark, dates.intnx(unit, F.lit(day).cast("date"), n, align))) == want


@pytest.mark.parametrize(("unit", "a", "b", "want"), [
    ("month", "2023-01-31", "2023-02-01", 1), ("month", "2023-02-01", "2023-02-28", 0), ("year", "2022-12-31", "2023-01-01", 1), ("qtr", "2023-04-01", "2022-12-31", -2), ("week", "2023-01-07", "2023-01-08", 1),
    ("week", "2023-01-08", "2023-01-01", -1), ("day", "2023-01-01", "2023-01-31", 30), ("semiyear", "2023-06-30", "2023-07-01", 1)])
def test_intck(spark, unit, a, b, want):
    assert one(spark, dates.intck(unit, F.lit(a).cast("date"), F.lit(b).cast("date"))) == want


def test_unknown_interval():
    with pytest.raises(StepError, match="interval"):
        dates.intnx("fortnight", F.lit(None), 1)


def test_scalar_functions(spark):
    assert one(spark, values.divide(F.lit(1), F.lit(0))) is None
    assert one(spark, values.log(F.lit(-1.0))) is None and one(spark, values.logit(F.lit(0.5))) == 0.0
    assert one(spark, values.logit(F.lit(0.9))) == pytest.approx(math.log(9)) and one(spark, values.logit(F.lit(1.0))) is None
    assert one(spark, values.joined_name(F.lit(" Ann "), F.lit("Lee "))) == "Ann Lee" and one(spark, values.joined_name(F.lit("Ann"), F.lit(None))) is None
    assert one(spark, values.missing(F.lit(float("nan")), floating=True)) == 1
    assert one(spark, values.picture(F.lit(1234567.891), 2, "$")) == "$1,234,567.89" and one(spark, values.read_number(F.lit("1,234.50"))) == 1234.5 and one(spark, values.read_number(F.lit("abc"))) is None
    labels = {1: "one", 2: "two"}
    assert [one(spark, values.value_labels(F.lit(x), labels)) for x in (1, 3)] == ["one", "3"] and one(spark, values.value_labels(F.lit(3), labels, "other")) == "other"
    assert one(spark, values.value_labels(F.lit(None).cast("int"), labels, "other")) is None


def test_function_names_are_checked(spark):
    with pytest.raises(StepError, match="not a name"):
        values.define_function(spark, "x; DROP", {}, "int", "1")


def test_products_on_a_grid(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(60, 40)), rng.normal(size=(40, 25))
    a[rng.random(a.shape) < 0.6], b[rng.random(b.shape) < 0.6] = 0, 0
    # One inner index that all rows and columns have.
    a[:, 3], b[3] = 2.0, -1.0
    frames = [spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i long, j int, v double") for m in (a, b)]
    frames[1] = frames[1].withColumn("i", F.col("i").cast("int"))
    for block in (512, 7):
        got = {(r.i, r.j): r.v for r in matrix.multiply(*frames, block=block).collect()}
        assert set(got) == {(i, j) for i in range(60) for j in range(25)} and all(got[i, j] == pytest.approx((a @ b)[i, j]) for i, j in got)
    odd = spark.createDataFrame([(1, 0, None), (2, 0, float("inf")), (3, 1, 1.0), (None, 1, 4.0), (5, 9, 1.0)], "i long, j int, v double")
    other = spark.createDataFrame([(0, 0, 2.0), (0, 1, None), (1, 0, 3.0), (None, 1, 1.0)], "i int, j int, v double")
    got = {(r.i, r.j): r.v for r in matrix.multiply(odd, other).collect()}
    assert got == {(1, 0): None, (1, 1): None, (2, 0): float("inf"), (2, 1): None, (3, 0): 3.0, (None, 0): 12.0}
    assert matrix.multiply(odd.limit(0), other).count() == 0


@pytest.mark.parametrize("width", [1, 2, 9, 400])
def test_gram_in_two_steps(spark, width):
    rows = np.random.default_rng(width).normal(size=(70, width)) + 3
    df = spark.createDataFrame([(r.tolist(),) for r in rows], "x array<double>").repartition(9)
    got = np.full((width, width), np.nan)
    for r in matrix.gram(df, "x", centred=True).collect():
        got[r.i, r.j] = r.v
    centred = rows - rows.mean(axis=0)
    assert np.allclose(got, centred.T @ centred, atol=1e-8)
