"""PROC MEANS / SUMMARY, exact quantiles at any size, PROC FREQ and PROC TRANSPOSE."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.operators.combine import with_group_statistics
from stepframe.operators.ordered import positions
from stepframe.semantics import StepError, is_missing, names_of, require_columns
from stepframe.sizing import cut_lineage

# Cells that a bracket is counted in, each round.
_CELLS = 8192

STATISTICS = ("n", "nmiss", "sum", "mean", "std", "min", "max", "median")


def _long(df: DataFrame, by: Sequence[str], variables: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")).alias("value"))
                      for v in variables])
    return df.select(*by, F.inline(pairs)).filter(F.col("value").isNotNull())


def _cell(round_number: int) -> Column:
    """The cell of a value in its bracket: of equal width by turns on the values and on their logarithms, so that neither a
    far outlier nor a cluster takes many rounds. Grows with the value; infinities have cells of their own."""
    def scaled(x: Column) -> Column:
        # Halved, so that no difference of two finite values is infinite.
        return x / 2 if round_number % 2 == 0 else F.signum(x) * F.log1p(F.abs(x) * 1e150)

    value, low, high = F.col("value"), scaled(F.col("finite_low")), scaled(F.col("finite_high"))
    place = F.when(high > low, F.floor((scaled(value) - low) / (high - low) * _CELLS)).otherwise(0)
    return F.when(value == float("-inf"), -1).when(value == float("inf"), _CELLS + 1).otherwise(place)


def _ends() -> list[Column]:
    finite = F.when(F.abs("value") < float("inf"), F.col("value"))
    return [F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.min(finite).alias("finite_low"), F.max(finite).alias("finite_high")]


def quantiles(df: DataFrame, by: str | Sequence[str], variables: str | Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per (group, variable, p).

    Selection by counting. The ranks of all groups and variables lie in brackets (the smallest and largest value they can be);
    a round counts each bracket's values in cells, in one map-side combined pass over all rows, and goes on with the cells
    that hold a rank, until a bracket has one distinct value. No group is gathered or sorted; the brackets (at most two for each
    group, variable and p) are broadcast if they are small.
    """
    by, variables = names_of(by), names_of(variables)
    require_columns(df, [*by, *variables])
    long = _long(df, by, variables).toDF(*(group := [f"__g{i}" for i in range(len(by))]), "variable", "value")
    group.append("variable")
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    spans = cut_lineage(long.groupBy(*group).agg(*_ends()))
    at = F.transform(wanted, lambda p: (F.col("n") - 1) * p)
    ranks = F.array_distinct(F.concat(F.transform(at, lambda r: F.floor(r)), F.transform(at, lambda r: F.ceil(r))))
    bracket = ["low", "high", "finite_low", "finite_high"]
    open_ones = spans.select(*group, *bracket, F.transform(ranks, lambda r: F.struct(r.alias("rank"), r.alias("rest"))).alias("ranks"))
    found, round_number = [], 0
    while True:
        seen = Observation()
        state = cut_lineage(open_ones.observe(seen, F.count_if(F.col("low") < F.col("high")).alias("open")))
        found.append(state.where(F.col("low") == F.col("high")).select(*group, F.col("low").alias("value"), "ranks"))
        if not seen.get["open"]:
            break
        wide = state.where(F.col("low") < F.col("high")).select(*[F.col(c).alias(f"__t{c}") for c in group], *bracket, "ranks")
        hits = long.join(wide, [*[F.col(c).eqNullSafe(F.col(f"__t{c}")) for c in group], F.col("value").between(F.col("low"), F.col("high"))])
        cells = hits.groupBy(*group, *[F.col(c).alias(f"__{c}") for c in bracket], "ranks", _cell(round_number).alias("cell")).agg(*_ends())
        # A bracket has 8194 cells at most.
        before = Window.partitionBy(*group, "__low").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        placed = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        inside = F.filter("ranks", lambda r: (r["rest"] >= F.col("before")) & (r["rest"] < F.col("before") + F.col("n")))
        kept = F.transform(inside, lambda r: F.struct(r["rank"].alias("rank"), (r["rest"] - F.col("before")).alias("rest")))
        open_ones = placed.select(*group, *bracket, kept.alias("ranks")).where(F.size("ranks") > 0)
        round_number += 1
    values = reduce(DataFrame.unionByName, found).select(*[F.col(c).alias(f"__v{c}") for c in group], F.explode("ranks.rank").alias("rank"), "value")
    values = values.groupBy(*[f"__v{c}" for c in group]).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at_rank"))
    joined = spans.select(*group, "n").join(values, [F.col(c).eqNullSafe(F.col(f"__v{c}")) for c in group])
    each = joined.select(*group, "at_rank", F.explode(F.transform(wanted, lambda p: F.struct(p.alias("p"), ((F.col("n") - 1) * p).alias("at")))).alias("x"))
    low, high = F.col("at_rank")[F.floor("x.at")], F.col("at_rank")[F.ceil("x.at")]
    # Equal ends are their own interpolation, infinite ones too.
    return each.select(*group, F.col("x.p").alias("p"), F.when(low == high, low).otherwise(low + (high - low) * (F.col("x.at") - F.floor("x.at"))).alias("quantile")).toDF(*by, "variable", "p", "quantile")


def _statistic(df: DataFrame, statistic: str, variable: str) -> Column:
    value = F.when(~is_missing(df, variable), F.col(variable))
    if statistic == "nmiss":
        return F.count("*") - F.count(value)
    if statistic == "sum":
        return F.coalesce(F.sum(value), F.lit(0.0))
    return {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[statistic](value)


def means(df: DataFrame, variables: str | Sequence[str], class_vars: str | Sequence[str] = (), statistics: Sequence[str] = STATISTICS, *,
          missing: bool = False) -> DataFrame:
    """CLASS x VAR x statistics, one row per class level, columns `<stat>_<var>`.

    Rows with a missing class level are left out unless `missing`. Without CLASS there is one row per variable.
    """
    variables, class_vars = names_of(variables), names_of(class_vars)
    require_columns(df, [*variables, *class_vars])
    unknown = sorted(set(statistics) - set(STATISTICS))
    if unknown:
        raise StepError(f"unknown statistics {unknown}; known: {STATISTICS}")
    if class_vars and not missing:
        df = df.dropna(subset=class_vars)
    simple = [s for s in statistics if s != "median"]
    table = df.groupBy(*class_vars).agg(*[_statistic(df, s, v).alias(f"{s}_{v}") for v in variables for s in simple] or [F.count("*").alias("__n")])
    if "median" in statistics:
        medians = quantiles(df, class_vars, variables, [0.5])
        wide = medians.groupBy(*[F.col(c).alias(f"__m_{c}") for c in class_vars]).agg(
            *[F.max(F.when(F.col("variable") == v, F.col("quantile"))).alias(f"median_{v}") for v in variables])
        same = [F.col(c).eqNullSafe(F.col(f"__m_{c}")) for c in class_vars]
        table = table.join(wide, same, "left") if same else table.join(F.broadcast(wide))
    table = table.select(*class_vars, *[f"{s}_{v}" for v in variables for s in statistics])
    if class_vars:
        return table
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), *[F.col(f"{s}_{v}").cast("long" if s in ("n", "nmiss") else "double").alias(s) for s in statistics])
                     for v in variables])
    return table.select(F.inline(rows))


def frequencies(df: DataFrame, column: str, *, missing: bool = False) -> DataFrame:
    """One-way table in level order: frequency, percent and both cumulated."""
    require_columns(df, [column])
    # The levels are used several times; the table is read once.
    levels = cut_lineage((df if missing else df.dropna(subset=[column])).groupBy(column).agg(F.count("*").alias("frequency")))
    levels = with_group_statistics(levels, [], __total=F.sum("frequency"))
    table = positions(levels, column, "__at", totals={"cum_frequency": "frequency"})
    share = lambda c: F.try_divide(F.col(c) * 100.0, F.col("__total"))
    return table.select(column, "frequency", share("frequency").alias("percent"), "cum_frequency", share("cum_frequency").alias("cum_percent"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two-way table in long form with cell, row and column percent."""
    require_columns(df, [a, b])
    cells = cut_lineage(df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count("*").alias("frequency")))
    cells = with_group_statistics(cells, [], __all=F.sum("frequency"))
    cells = with_group_statistics(cells, a, write=False, __row=F.sum("frequency"))
    cells = with_group_statistics(cells, b, write=False, __col=F.sum("frequency"))
    part = lambda whole: F.try_divide(F.col("frequency") * 100.0, F.col(whole))
    return cells.select(a, b, "frequency", part("__all").alias("percent"), part("__row").alias("row_percent"), part("__col").alias("col_percent"))


def crosstab_wide(df: DataFrame, a: str, b: str, levels: Sequence[str]) -> DataFrame:
    """Two-way table with a column per declared level of b; absent cells are 0."""
    require_columns(df, [a, b])
    return df.dropna(subset=[a, b]).groupBy(a).pivot(b, list(levels)).count().fillna(0)


@F.pandas_udf(T.DoubleType())
def _chi_square_tail(statistic: pd.Series, freedom: pd.Series) -> pd.Series:
    """P(X > x): the finite sum for even degrees of freedom, erfc plus a finite sum for odd ones."""

    def tail(x: float, df: int) -> float:
        half = x / 2.0
        if half <= 0 or df <= 0:
            return 1.0
        first, q = (0, 0.0) if df % 2 == 0 else (0.5, math.erfc(math.sqrt(half)))
        steps = df // 2
        return min(1.0, q + sum(math.exp(-half + (k + first) * math.log(half) - math.lgamma(k + first + 1)) for k in range(steps)))

    return pd.Series([tail(x, int(df)) for x, df in zip(statistic, freedom, strict=True)])


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """TABLES a*b / CHISQ: statistic, degrees of freedom and p-value in one row, from the cell counts."""
    require_columns(df, [a, b])
    cells = cut_lineage(df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count("*").alias("n")))
    cells = with_group_statistics(cells, a, write=False, __row=F.sum("n"))
    cells = with_group_statistics(cells, b, write=False, __col=F.sum("n"))
    total = cells.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n").cast("double") * F.col("n") / (F.col("__row").cast("double") * F.col("__col"))).alias("s"),
        F.countDistinct(a).alias("rows"),
        F.countDistinct(b).alias("cols"),
    )
    statistic = F.greatest(F.col("n") * (F.col("s") - 1), F.lit(0.0))
    table = total.select("n", F.when(F.col("n") > 0, (F.col("rows") - 1) * (F.col("cols") - 1)).alias("freedom"), statistic.alias("statistic"))
    return table.withColumn("p_value", _chi_square_tail("statistic", "freedom"))


def transpose_long(df: DataFrame, by: str | Sequence[str], variables: str | Sequence[str], name: str = "_name_", value: str = "col1") -> DataFrame:
    """Wide to long: one row per BY row and variable."""
    by, variables = names_of(by), names_of(variables)
    require_columns(df, [*by, *variables])
    return df.unpivot(by, variables, name, value)


def transpose_wide(df: DataFrame, by: str | Sequence[str], id_column: str, variable: str, levels: Sequence, aggregate=F.first, prefix: str = "") -> DataFrame:
    """Long to wide: one column per declared level of the ID column."""
    by = names_of(by)
    require_columns(df, [*by, id_column, variable])
    wide = df.groupBy(*by).pivot(id_column, list(levels)).agg(aggregate(variable))
    return wide.toDF(*by, *[f"{prefix}{level}" for level in levels])
