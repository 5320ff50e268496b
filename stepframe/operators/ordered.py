"""Order-dependent step operators: RETAIN, LAG, FIRST./LAST., sequence ids and accumulators.

A BY group may hold a third of the table, so no operator here needs a whole group in one task. Rows are cut into ranges
of (BY, order keys) (`stepframe.ranges`), at every size in the same way. Each range is worked off by itself after the one
shuffle by (BY, range); what a range takes over from the ranges before it comes from a scan over summaries of the groups
that lie across a border, at most one row per range, and is added by a broadcast join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.ranges import Ranges, order_rank, plan_ranges
from stepframe.semantics import Key, names_of, require_columns, require_order, same_keys

_RANGE = "__range"


@dataclass(frozen=True)
class Retained:
    kind: str
    source: str | Column


def total(source: str | Column) -> Retained:
    """Sum so far; missing values add nothing and the sum of nothing is 0."""
    return Retained("total", source)


def counter(source: str | Column | None = None) -> Retained:
    """Rows so far, or non-missing values so far."""
    return Retained("counter", F.lit(1) if source is None else source)


def lowest(source: str | Column) -> Retained:
    return Retained("lowest", source)


def highest(source: str | Column) -> Retained:
    return Retained("highest", source)


def latest(source: str | Column) -> Retained:
    """The last non-missing value, carried forward."""
    return Retained("latest", source)


def _input(retained: Retained) -> Column:
    source = F.col(retained.source) if isinstance(retained.source, str) else retained.source
    return F.when(source.isNotNull(), F.lit(1).cast("long")) if retained.kind == "counter" else source


def _fold(kind: str, column: Column) -> Column:
    return {"total": F.sum, "counter": F.sum, "lowest": F.min, "highest": F.max}[kind](column)


def _sum_type(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.IntegralType):
        return T.LongType()
    if isinstance(kind, T.DecimalType):
        return T.DecimalType(min(38, kind.precision + 10), kind.scale)
    return T.DoubleType()


def _earlier(by: Sequence[str], rows: int | None = None):
    """The ranges of a group before the current one."""
    return Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding if rows is None else -rows, -1)


def _take_over(df: DataFrame, carried: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with what their range takes over; `carried` has one row per range that begins inside a group."""
    right = carried.withColumnsRenamed({c: f"__of_{c}" for c in [*by, _RANGE]})
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in [*by, _RANGE]]
    return df.join(F.broadcast(right), same, "left").drop(*[f"__of_{c}" for c in [*by, _RANGE]])


def retain(
    df: DataFrame,
    by: str | Sequence[str],
    order_by: str | Sequence[str | Key],
    columns: dict[str, Retained],
    *,
    na_position: str = "default",
    ranges: int | Ranges | None = None,
) -> DataFrame:
    """Add running columns, restarted at each BY group (`by` may be empty)."""
    by = names_of(by)
    keys = require_order(df, order_by)
    require_columns(df, by, "BY variable")
    ranges = ranges if isinstance(ranges, Ranges) else plan_ranges(df, by, keys, na_position, ranges)
    inputs = {f"__in_{name}": (name, retained.kind) for name, retained in columns.items()}
    prepared = df.withColumns({f"__in_{name}": _input(retained) for name, retained in columns.items()})
    # What is carried over a border must fit the sum's type, not that of a single value.
    wide = {i: _sum_type(prepared.schema[i].dataType) for i, (_, kind) in inputs.items() if kind == "total"}
    prepared = prepared.withColumns({i: F.col(i).cast(t) for i, t in wide.items()})
    cell = [*by, _RANGE]

    carried = _summaries(ranges.number(ranges.across_borders(prepared), _RANGE), by, keys, inputs)
    carried = carried.select(*cell, *[
        (F.last(i, ignorenulls=True) if kind == "latest" else _fold(kind, F.col(i))).over(_earlier(by)).cast(prepared.schema[i].dataType).alias(f"__from_{name}")
        for i, (name, kind) in inputs.items()])

    so_far = (
        Window.partitionBy(*cell).orderBy(*[k.column(na_position) for k in keys])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranges.number(prepared, _RANGE).withColumns({
        f"__here_{name}": F.last(i, ignorenulls=True).over(so_far) if kind == "latest" else _fold(kind, F.col(i)).over(so_far)
        for i, (name, kind) in inputs.items()})
    joined = _take_over(local, carried, by)
    results = {}
    for i, (name, kind) in inputs.items():
        here, earlier = F.col(f"__here_{name}"), F.col(f"__from_{name}")
        if kind in ("total", "counter"):
            value = F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0))
            results[name] = F.coalesce(value.cast(wide[i]) if i in wide else value, F.lit(0))
        elif kind == "latest":
            results[name] = F.coalesce(here, earlier)
        else:
            results[name] = F.least(here, earlier) if kind == "lowest" else F.greatest(here, earlier)
    return joined.select(*[c for c in df.columns if c not in columns], *[v.alias(n) for n, v in results.items()])


def _summaries(rows: DataFrame, by: list[str], keys: list[Key], inputs: dict[str, tuple[str, str]]) -> DataFrame:
    """Each (group, range) folded to one row."""
    folded = [_fold(kind, F.col(i)).alias(i) for i, (_, kind) in inputs.items() if kind != "latest"]
    rank = order_rank(rows, keys)
    folded += [F.max_by(i, F.when(F.col(i).isNotNull(), rank)).alias(i) for i, (_, kind) in inputs.items() if kind == "latest"]
    return rows.groupBy(*by, _RANGE).agg(*folded)


def row_numbers(df, by, order_by, name: str = "row_number", **options) -> DataFrame:
    return retain(df, by, order_by, {name: counter()}, **options)


def positions(df: DataFrame, order_by: str | Sequence[str | Key], name: str = "position", *, na_position: str = "default",
              totals: dict[str, str] | None = None, ranges: int | Ranges | None = None) -> DataFrame:
    """1-based position of every row in a total order, and running totals over it. The keys must identify a row."""
    running = {name: counter()} | {new: total(c) for new, c in (totals or {}).items()}
    return retain(df, [], order_by, running, na_position=na_position, ranges=ranges)


def lag(
    df: DataFrame,
    by: str | Sequence[str],
    order_by: str | Sequence[str | Key],
    columns: dict[str, tuple[str, int]],
    *,
    ranges: int | Ranges | None = None,
) -> DataFrame:
    """`columns={new: (source, n)}`: the value n rows earlier in the BY group, NULL at its start."""
    by = names_of(by)
    keys = require_order(df, order_by)
    require_columns(df, [*by, *[source for source, _ in columns.values()]])
    ranges = ranges if isinstance(ranges, Ranges) else plan_ranges(df, by, keys, count=ranges)
    return _lagged(df, by, keys, columns, ranges).drop(_RANGE)


def _lagged(df: DataFrame, by: list[str], keys: list[Key], columns: dict[str, tuple[str, int]], ranges: Ranges) -> DataFrame:
    """The first rows of a range look into the last rows of the ranges before it."""
    depth = max(n for _, n in columns.values())
    sources = sorted({source for source, _ in columns.values()})
    cell = [*by, _RANGE]
    backwards = [Key(k.name, not k.descending).column() for k in keys]
    ends = ranges.number(ranges.across_borders(df), _RANGE)
    ends = ends.select(*cell, *[F.col(k.name) for k in keys if k.name not in by], *[F.col(s).alias(f"__v_{s}") for s in sources])
    ends = ends.withColumn("__back", F.row_number().over(Window.partitionBy(*cell).orderBy(*backwards))).filter(F.col("__back") <= depth)
    tails = ends.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct((-F.col("__back")).alias("p"), *[F.col(f"__v_{s}") for s in sources]))).alias("__tail"))
    carried = tails.select(*cell, F.flatten(F.collect_list("__tail").over(_earlier(by, depth))).alias("__tail"))

    w = Window.partitionBy(*cell).orderBy(*[k.column() for k in keys])
    local = ranges.number(df, _RANGE).withColumn("__at", F.row_number().over(w))
    local = local.withColumns({f"__lag_{new}": F.lag(source, n).over(w) for new, (source, n) in columns.items()})
    joined = _take_over(local, carried, by)
    found = {
        new: F.when(F.col("__at") > n, F.col(f"__lag_{new}")).otherwise(F.get("__tail", F.size("__tail") - n + F.col("__at") - 1)[f"__v_{source}"])
        for new, (source, n) in columns.items()
    }
    return joined.withColumns(found).drop("__at", "__tail", *[f"__lag_{new}" for new in columns])


def first_last_flags(df: DataFrame, by: str | Sequence[str], order_by: str | Sequence[str | Key]) -> DataFrame:
    """`first_<var>` and `last_<var>` (0/1) for nested BY variables; BY + order keys must identify a row.

    One map-side combined pass finds the first and last row of each innermost group; outer groups are rolled up
    from those. They are marked by a join on the full, unique key, so a hot group is spread over all tasks.
    """
    by = names_of(by)
    keys = require_order(df, order_by)
    require_columns(df, by, "BY variable")
    identity = list(dict.fromkeys([*by, *[k.name for k in keys]]))
    row = F.struct(*identity)
    rank = order_rank(df, keys)
    ends = df.groupBy(*by).agg(F.min_by(row, rank).alias("first"), F.max_by(row, rank).alias("last"))
    marks = None
    for level, var in enumerate(by):
        outer, inner = by[: level + 1], by[level + 1:]
        if inner:
            # Inner BY variables sort ascending, so the first row of the lowest inner group is the outer first row.
            place = F.struct(*inner)
            found = ends.groupBy(*outer).agg(F.min_by("first", place).alias("first"), F.max_by("last", place).alias("last"))
        else:
            found = ends.select("first", "last")
        both = F.array(*[F.struct(*[F.col(end)[c].alias(c) for c in identity], *[F.lit(int(f == f"{end}_{v}" and v == var)).alias(f) for v in by for f in (f"first_{v}", f"last_{v}")])
                         for end in ("first", "last")])
        found = found.select(F.inline(both))
        marks = found if marks is None else marks.unionByName(found)
    flags = [f"{end}_{v}" for v in by for end in ("first", "last")]
    marks = marks.groupBy(*identity).agg(*[F.max(f).alias(f) for f in flags])
    return same_keys(df, marks, identity, "left").withColumns({f: F.coalesce(F.col(f), F.lit(0)) for f in flags})


def first_of_group(df, by, order_by, rows: int = 1) -> DataFrame:
    """The first `rows` rows of each BY group; Spark limits each group before the shuffle."""
    keys = require_order(df, order_by)
    w = Window.partitionBy(*names_of(by)).orderBy(*[k.column() for k in keys])
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= rows).drop("__rn")


def last_of_group(df, by, order_by, rows: int = 1) -> DataFrame:
    return first_of_group(df, by, [Key(k.name, not k.descending) for k in require_order(df, order_by)], rows)


def sequence_ids(df, by, order_by, changes_of: str, name: str = "sequence_id", *, ranges: int | Ranges | None = None) -> DataFrame:
    """A number that grows by one whenever `changes_of` differs from the row before, from 1 in each BY group."""
    by = names_of(by)
    keys = require_order(df, order_by)
    require_columns(df, [*by, changes_of])
    ranges = ranges if isinstance(ranges, Ranges) else plan_ranges(df, by, keys, count=ranges)

    cell = [*by, _RANGE]
    in_range = Window.partitionBy(*cell).orderBy(*[k.column() for k in keys])

    def with_changes(rows: DataFrame) -> DataFrame:
        """Changes inside the range; its first row counts as none."""
        rows = ranges.number(rows, _RANGE).withColumns({"__at": F.row_number().over(in_range), "__before": F.lag(changes_of).over(in_range)})
        return rows.withColumn("__change", ((F.col("__at") > 1) & ~F.col("__before").eqNullSafe(F.col(changes_of))).cast("long")).drop("__before")

    per_range = with_changes(ranges.across_borders(df)).groupBy(*cell).agg(
        F.sum("__change").alias("__n"), F.min_by(changes_of, "__at").alias("__first"), F.max_by(changes_of, "__at").alias("__last"))
    here = Window.partitionBy(*by).orderBy(_RANGE)
    at_border = F.lag(F.lit(1)).over(here).isNotNull() & ~F.lag("__last").over(here).eqNullSafe(F.col("__first"))
    per_range = per_range.withColumn("__border", at_border.cast("long"))
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = per_range.select(*cell, (F.coalesce(F.sum("__n").over(_earlier(by)), F.lit(0)) + F.sum("__border").over(so_far)).alias("__from"))
    local = with_changes(df).withColumn("__local", F.sum("__change").over(in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = _take_over(local, carried, by)
    return joined.withColumn(name, F.lit(1) + F.col("__local") + F.coalesce("__from", F.lit(0))).drop("__at", "__change", "__local", "__from", _RANGE)


def capped_balance(df, by, order_by, amount: str, low: float, high: float, name: str = "balance", start: float = 0.0, *,
                   ranges: int | Ranges | None = None) -> DataFrame:
    """balance = min(high, max(low, balance + amount)), row after row; a missing amount leaves it alone.

    Not a prefix sum, yet steps compose: any run of rows maps the balance b to min(top, max(bottom, b + shift)). Each row
    gets the map from the start of its range, by doubling within an Arrow batch; the maps of ranges that lie across a
    border are composed per group, and the balance a range begins with goes through the map of each row.
    """
    by = names_of(by)
    keys = require_order(df, order_by)
    require_columns(df, [*by, amount])
    ranges = ranges if isinstance(ranges, Ranges) else plan_ranges(df, by, keys, count=ranges)
    cell, order = [*by, _RANGE], [k.column() for k in keys]
    step = F.coalesce(F.nanvl(F.col(amount).cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    in_range = Window.partitionBy(*cell).orderBy(*order)

    def mapped(rows: DataFrame) -> DataFrame:
        rows = ranges.number(rows.withColumn("__step", step), _RANGE).withColumn("__at", F.row_number().over(in_range))
        extended = T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("__shift", "__bottom", "__top")]])
        return rows.mapInArrow(_composed(low, high), extended)

    # Only keys and amounts of the groups across borders go through here.
    needed = list(dict.fromkeys([*by, *[k.name for k in keys], amount, *ranges.ties]))
    whole = mapped(ranges.across_borders(df.select(*needed))).groupBy(*cell).agg(F.max_by(F.struct("__shift", "__bottom", "__top"), "__at").alias("__map"))
    before = F.sort_array(F.collect_list(F.struct(_RANGE, "__map")).over(_earlier(by)))
    balance = F.aggregate(before, F.lit(float(start)), lambda b, x: F.least(x["__map"]["__top"], F.greatest(x["__map"]["__bottom"], b + x["__map"]["__shift"])))
    carried = whole.select(*cell, balance.alias("__start"))
    joined = _take_over(mapped(df), carried, by)
    result = F.least(F.col("__top"), F.greatest(F.col("__bottom"), F.coalesce("__start", F.lit(float(start))) + F.col("__shift")))
    return joined.select(*[c for c in df.columns if c != name], result.alias(name))


def _composed(low: float, high: float):
    """Per row, the map from the balance before its range to the balance after the row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: tuple[float, float, float] | None = None
        for batch in batches:
            at = batch.column("__at").to_numpy()
            shift = batch.column("__step").to_numpy().copy()
            n = len(shift)
            bottom, top = np.full(n, float(low)), np.full(n, float(high))
            # Rows of this batch before each row in its range.
            depth = np.minimum(np.arange(n), at - 1)
            reach = 1
            while reach <= depth.max(initial=0):
                later = np.flatnonzero(depth >= reach)
                s, b, t = shift[later - reach], bottom[later - reach], top[later - reach]
                s2, b2, t2 = shift[later], bottom[later], top[later]
                shift[later], bottom[later], top[later] = s + s2, np.minimum(t2, np.maximum(b2, b + s2)), np.minimum(t2, np.maximum(b2, t + s2))
                reach *= 2
            if carry is not None:
                inside = np.flatnonzero(at - 1 > np.arange(n))
                s, b, t = carry
                s2, b2, t2 = shift[inside], bottom[inside], top[inside]
                shift[inside], bottom[inside], top[inside] = s + s2, np.minimum(t2, np.maximum(b2, b + s2)), np.minimum(t2, np.maximum(b2, t + s2))
            if n:
                carry = shift[-1], bottom[-1], top[-1]
            added = [pa.array(x, pa.float64()) for x in (shift, bottom, top)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "__shift", "__bottom", "__top"])

    return run
