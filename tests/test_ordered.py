"""Scans over ranges against brute force, with a hot group, missing keys and repeated order values."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stepframe.operators import ordered
from stepframe.ranges import plan_ranges
from stepframe.semantics import Key, StepError, by_keys


def rows(n=600, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        group = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        at = None if rng.random() < 0.03 else rng.randrange(200)
        out.append((i, group, at, None if rng.random() < 0.2 else round(rng.uniform(-9, 9), 2), rng.choice("xyz")))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "id long, grp string, at int, v double, kind string").repartition(5)


def brute(descending=False):
    """Rows of each group in Spark's order of (at, id): NULL first ascending, last descending."""
    groups = {}
    for r in rows():
        groups.setdefault(r[1], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[2] is not None, r[2] or 0, 0))
        if descending:
            g.sort(key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        else:
            g.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    return groups


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("ranges", [1, 24, 300])
def test_retain(table, descending, ranges):
    order = "DESCENDING at id" if descending else "at id"
    found = ordered.retain(table, "grp", order, {
        "total": ordered.total("v"), "n": ordered.counter(), "n_v": ordered.counter("v"), "low": ordered.lowest("v"), "high": ordered.highest("v"), "last": ordered.latest("v")},
        ranges=ranges)
    got = {r.id: r for r in found.collect()}
    assert len(got) == 600
    for g in brute(descending).values():
        values, last = [], None
        for i, r in enumerate(g, 1):
            if r[3] is not None:
                values.append(r[3])
                last = r[3]
            x = got[r[0]]
            assert x.total == pytest.approx(sum(values)) and (x.n, x.n_v) == (i, len(values)) and x["last"] == last
            assert (x.low, x.high) == ((min(values), max(values)) if values else (None, None))


def test_latest_with_a_descending_text_key(table):
    order = "DESCENDING at DESCENDING kind id"
    whole = ordered.retain(table, "grp", order, {"last": ordered.latest("v"), "n": ordered.counter()}, ranges=1)
    sliced = ordered.retain(table, "grp", order, {"last": ordered.latest("v"), "n": ordered.counter()}, ranges=24)
    assert sorted((r.id, r["last"] or 0, r.n) for r in whole.collect()) == sorted((r.id, r["last"] or 0, r.n) for r in sliced.collect())


@pytest.mark.parametrize("ranges", [1, 24, 300])
def test_lag_reaches_over_slices(table, ranges):
    got = {r.id: r for r in ordered.lag(table, "grp", "at id", {"one": ("v", 1), "four": ("id", 4)}, ranges=ranges).collect()}
    for g in brute().values():
        for i, r in enumerate(g):
            assert got[r[0]].one == (g[i - 1][3] if i >= 1 else None)
            assert got[r[0]].four == (g[i - 4][0] if i >= 4 else None)


@pytest.mark.parametrize("ranges", [1, 24, 300])
def test_sequence_ids(table, ranges):
    got = {r.id: r.sequence_id for r in ordered.sequence_ids(table, "grp", "at id", "kind", ranges=ranges).collect()}
    for g in brute().values():
        n = 0
        for i, r in enumerate(g):
            n += i == 0 or g[i - 1][4] != r[4]
            assert got[r[0]] == n


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("ranges", [1, 24, 300])
def test_capped_balance(table, ranges, descending):
    order = "DESCENDING at id" if descending else "at id"
    got = {r.id: r.balance for r in ordered.capped_balance(table, "grp", order, "v", 0.0, 20.0, start=5.0, ranges=ranges).collect()}
    for g in brute(descending).values():
        balance = 5.0
        for r in g:
            balance = min(20.0, max(0.0, balance + (r[3] or 0.0)))
            assert got[r[0]] == pytest.approx(balance)


def test_first_last_flags_with_missing_groups(table):
    got = {r.id: r for r in ordered.first_last_flags(table, "grp kind", "at id").collect()}
    for g in brute().values():
        by_kind = {}
        for r in g:
            by_kind.setdefault(r[4], []).append(r[0])
        kinds = sorted(by_kind)
        for k, ids in by_kind.items():
            assert [i for i in ids if got[i].first_kind] == [ids[0]] and [i for i in ids if got[i].last_kind] == [ids[-1]]
        in_order = [i for k in kinds for i in by_kind[k]]
        assert [i for i in in_order if got[i].first_grp] == [in_order[0]] and [i for i in in_order if got[i].last_grp] == [in_order[-1]]


def test_without_by_the_whole_table_is_one_group(table):
    got = {r.id: r.n for r in ordered.row_numbers(table, [], "at id", "n", ranges=15).collect()}
    want = sorted(rows(), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    assert [got[r[0]] for r in want] == list(range(1, 601))


@pytest.mark.parametrize("ranges", [1, 12])
def test_positions_and_totals(table, ranges):
    got = {r.id: r for r in ordered.positions(table, "kind DESCENDING id", "place", totals={"sum_v": "v"}, ranges=ranges).collect()}
    running = 0.0
    for i, r in enumerate(sorted(rows(), key=lambda r: (r[4], -r[0])), 1):
        running += r[3] or 0.0
        assert got[r[0]].place == i and got[r[0]].sum_v == pytest.approx(running)


def _largest_cell(df, by, order, count):
    ranges = plan_ranges(df, by, by_keys(order), count=count)
    return ranges.number(df, "s").groupBy(*by, "s").count().agg(F.max("count")).first()[0]


def test_hot_group_is_cut(table):
    assert _largest_cell(table, ["grp"], "at id", 24) < 60 and table.filter("grp = 'hot'").count() > 200


@pytest.mark.parametrize("order", ["kind id", "DESCENDING kind id", "DESCENDING kind DESCENDING id"])
def test_a_text_key_leads(table, order):
    whole, cut = (ordered.retain(table, "grp", order, {"t": ordered.total("v"), "n": ordered.counter()}, ranges=n).collect() for n in (1, 40))
    assert {r.id: (r.n, pytest.approx(r.t)) for r in whole} == {r.id: (r.n, r.t) for r in cut}
    assert _largest_cell(table, ["grp"], order, 24) < 60


@pytest.mark.parametrize("key", ["CAST(7 AS INT)", "'same'", "CAST(NULL AS DATE)"])
def test_one_order_value_is_cut_too(spark, key):
    df = spark.range(900).selectExpr("id", f"{key} AS at", "1 AS one").repartition(4)
    assert _largest_cell(df, [], "at", 12) < 200
    got = ordered.retain(df, [], "at", {"n": ordered.counter(), "t": ordered.total("one")}, ranges=12).collect()
    assert sorted(r.n for r in got) == list(range(1, 901)) and all(r.n == r.t for r in got)
    assert sum(r.p is None for r in ordered.lag(df, [], "at", {"p": ("id", 1)}, ranges=12).collect()) == 1


def test_a_far_outlier_and_decimal_keys(spark):
    df = spark.range(400).selectExpr("id", "CAST(IF(id = 399, 99999999999999999999.99, id / 100) AS DECIMAL(30, 2)) AS at").repartition(4)
    assert _largest_cell(df, [], "at id", 16) < 60
    assert {r.id: r.n for r in ordered.row_numbers(df, [], "at id", "n", ranges=16).collect()} == {i: i + 1 for i in range(400)}
    assert {r.id: r.n for r in ordered.row_numbers(df, [], "DESCENDING at DESCENDING id", "n", ranges=16).collect()} == {i: 400 - i for i in range(400)}


@pytest.mark.parametrize("na_position", ["first", "last"])
def test_missing_keys_go_where_asked(table, na_position):
    got = {r.id: r.place for r in ordered.positions(table, "at id", "place", na_position=na_position, ranges=30).collect()}
    last = na_position == "last"
    want = sorted(rows(), key=lambda r: ((r[2] is None) == last, r[2] or 0, r[0]))
    assert [got[r[0]] for r in want] == list(range(1, 601))


def test_empty_tables(table):
    none = table.limit(0)
    assert ordered.retain(none, "grp", "at id", {"t": ordered.total("v")}).count() == 0
    assert ordered.lag(none, "grp", "at id", {"p": ("v", 2)}).count() == 0
    assert ordered.sequence_ids(none, [], "at id", "kind").count() == 0
    assert ordered.capped_balance(none, "grp", "at id", "v", 0.0, 1.0).count() == 0
    assert ordered.positions(none, "at id").count() == 0


def test_one_shuffle_of_the_rows_whatever_the_size(table):
    ranges = plan_ranges(table, ["grp"], by_keys("at id"), count=20)
    frame = ordered.retain(table, "grp", "at id", {"t": ordered.total("v")}, ranges=ranges)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    # The rows once, by (grp, range); the summaries of groups across borders twice.
    assert plan.count("Exchange hashpartitioning(grp") == 3 and "SortMergeJoin" not in plan


def test_local_timestamps_slice_in_order(spark):
    stamps = spark.sql("SELECT id, timestamp_ntz'2024-03-10 00:00:00' + make_dt_interval(0, 0, id * 7) AS at FROM range(300)")
    got = ordered.row_numbers(stamps, [], "at", "n", ranges=15).collect()
    assert all(r.n == r.id + 1 for r in got)


@pytest.mark.parametrize("order", ["x id", "DESCENDING x id"])
def test_infinities_and_nan_keep_their_place(spark, order):
    values = [float("nan"), float("inf"), float("-inf"), None, *[i / 7 for i in range(-40, 40)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values * 2)], "id int, x double").repartition(4)
    whole, sliced = (ordered.row_numbers(df, [], order, "n", ranges=n).collect() for n in (1, 20))
    assert sorted((r.id, r.n) for r in whole) == sorted((r.id, r.n) for r in sliced)


def test_order_is_demanded(table):
    with pytest.raises(StepError, match="order"):
        ordered.retain(table, "grp", [], {"t": ordered.total("v")})
    with pytest.raises(StepError, match="unknown order key"):
        ordered.lag(table, "grp", "nothing", {"x": ("v", 1)})


def test_group_limits_come_before_the_shuffle(table):
    plan = ordered.first_of_group(table, "grp", "at id")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan.split("== Physical Plan ==")[1]


def test_written_tables_can_be_cleared(spark):
    import os

    from stepframe.sizing import _session_folder, clear_scratch, cut_lineage

    assert cut_lineage(spark.range(5)).count() == 5
    folder = _session_folder(spark).removeprefix("file:")
    assert os.path.isdir(folder)
    clear_scratch(spark)
    assert not os.path.exists(folder)


def test_totals_of_narrow_types_and_many_slices(spark):
    rows = [(1, i, 2_000_000_000 if i % 2 else 100) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, o int, x int").withColumn("d", (F.col("x") / 30000).cast("decimal(7,2)"))
    for source, one, other in (("x", 2_000_000_000, 100), ("d", Decimal("66666.67"), Decimal("0.00"))):
        got = {r.o: r.s for r in ordered.retain(df, "g", "o", {"s": ordered.total(source)}, ranges=6).collect()}
        want, sums = 0, {}
        for _, o, _ in rows:
            want += one if o % 2 else other
            sums[o] = want
        assert got == sums


def test_descending_decimals_keep_their_digits(spark):
    df = spark.createDataFrame([(1, Decimal("12345678901234567890.01")), (1, Decimal("12345678901234567890.02"))], "g int, o decimal(30,2)")
    got = {str(r.o)[-2:]: (r.first_g, r.last_g) for r in ordered.first_last_flags(df, "g", [Key("o", True)]).collect()}
    assert got == {"02": (1, 0), "01": (0, 1)}
