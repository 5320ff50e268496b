"""Ranges of a total order: borders drawn from the data, the range of a row, and the groups that lie across a border.

One plan for every size, key type and distribution. A sample of the key values, sorted by Spark, gives the borders; a row
finds its range by two broadcast joins, first with runs of ranges, then within the run. Neighbouring rows share a range
however the values are spread. A border cuts one BY group at most: what is carried into a range is one row at most.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.semantics import Key, StepError
from stepframe.sizing import cut_lineage, ordinal

_SAMPLED_PER_RANGE = 20
_KEY = "__key"


def order_rank(df: DataFrame, keys: Sequence[Key], na_position: str = "default") -> Column:
    """A struct that compares, ascending, as the keys do in their directions."""
    if na_position not in ("default", "first", "last"):
        raise StepError(f"na_position must be default, first or last, not {na_position!r}")
    parts = []
    for key in keys:
        column, kind = F.col(key.name), df.schema[key.name].dataType
        first = not key.descending if na_position == "default" else na_position == "first"
        if not key.descending:
            # In a struct, missing values sort first.
            parts.extend([column] if first else [column.isNull(), column])
            continue
        parts.append(column.isNotNull() if first else column.isNull())
        if isinstance(kind, (T.StringType, T.BinaryType)):
            # The end of a text sorts after any further character.
            parts.append(F.concat(F.translate(F.hex(column), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~")))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            parts.extend([~F.isnan(column), -column])
        elif isinstance(kind, T.DecimalType):
            parts.append(-column)
        elif isinstance(kind, T.BooleanType):
            parts.append(~column)
        elif (value := ordinal(column, kind)) is not None:
            # Unlike the negative, never out of range.
            parts.append(F.bitwise_not(value))
        else:
            raise StepError(f"order key {key.name} is {kind.simpleString()} and cannot be descending")
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


@dataclass(frozen=True)
class Ranges:
    """Ranges over (BY variables, order keys), each with the key it begins with and the key it ends before; none at the ends."""

    by: tuple[str, ...]
    keys: tuple[Key, ...]
    na_position: str
    ties: tuple[str, ...]
    runs: DataFrame
    each: DataFrame

    def _key(self, df: DataFrame) -> Column:
        """BY variables sort as usual wherever missing order keys go."""
        return F.struct(order_rank(df, [Key(c) for c in self.by]).alias("by") if self.by else F.lit(0).alias("by"), order_rank(df, self.keys, self.na_position).alias("at"),
                        (F.xxhash64(*self.ties) if self.ties else F.lit(0)).alias("tie"))

    def number(self, df: DataFrame, name: str) -> DataFrame:
        """The rows with the number of their range, which grows along the order."""
        def inside(low: str, high: str) -> Column:
            return (F.col(low).isNull() | (F.col(low) <= F.col(_KEY))) & (F.col(high).isNull() | (F.col(_KEY) < F.col(high)))

        # As many rows as ranges, and the root of that.
        rows = df.withColumn(_KEY, self._key(df)).join(F.broadcast(self.runs), inside("__run_low", "__run_high"))
        rows = rows.join(F.broadcast(self.each), (F.col("__run") == F.col("__of")) & inside("__low", "__high"))
        return rows.select(*[F.col(c) for c in df.columns if c != name], F.col("__number").alias(name))

    def across_borders(self, df: DataFrame) -> DataFrame:
        """The rows of BY groups that may have rows on both sides of a border: one group for each border at most."""
        if not self.by:
            return df
        groups = self.each.where("__low IS NOT NULL").select(*[F.col(f"__low.by.k{i}").alias(f"__b{i}") for i in range(len(self.by))])
        return df.join(F.broadcast(groups), [F.col(c).eqNullSafe(F.col(f"__b{i}")) for i, c in enumerate(self.by)], "left_semi")


def plan_ranges(df: DataFrame, by: Sequence[str], keys: Sequence[Key], na_position: str = "default", count: int | None = None) -> Ranges:
    """About `count` ranges with equally many rows (as many as shuffle partitions if not given).

    One pass over the key columns; 20 rows per range, drawn at random, are sorted. Where one key value fills more than a range, so
    that two borders are equal, rows of that value are told apart by a hash of all their columns, in a second pass.
    Results never depend on the borders.
    """
    count = count or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = tuple(by), tuple(k for k in keys if k.name not in by) or (Key(by[0]),), na_position
    borders, repeated = _draw(df, Ranges(*known, (), df, df), count)
    ties: tuple[str, ...] = ()
    if repeated:
        ties = tuple(f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType)))
        borders, _ = _draw(df, Ranges(*known, ties, df, df), count)
    runs = borders.where("level = 0").select(F.col("run").alias("__run"), F.col("low").alias("__run_low"), F.col("high").alias("__run_high"))
    each = borders.where("level = 1").select(F.col("run").alias("__of"), F.col("number").alias("__number"), F.col("low").alias("__low"), F.col("high").alias("__high"))
    return Ranges(*known, ties, runs, each)


def _draw(df: DataFrame, ranges: Ranges, count: int) -> tuple[DataFrame, bool]:
    """The borders of ranges (level 1) and of runs of them (level 0), written so that every later pass sees the same, and
    whether two of them are equal."""
    drawn = df.select(ranges._key(df).alias(_KEY)).orderBy(F.rand(11)).limit(_SAMPLED_PER_RANGE * count)
    found = drawn.agg(F.sort_array(F.collect_list(_KEY)).alias("a"), F.greatest(F.least(F.count("*"), F.lit(count)), F.lit(1)).alias("n"))
    width = math.isqrt(count) or 1

    def border(place: Column) -> Column:
        """The key that `place` ranges lie below."""
        return F.when((place > 0) & (place < F.col("n")), F.get("a", F.floor(place * F.size("a") / F.col("n")).cast("int")))

    def level(n: int, step: int) -> Column:
        last = F.floor((F.col("n") - 1) / step)
        return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.struct(
            F.lit(n).alias("level"), F.floor(i * step / width).alias("run"), i.cast("int").alias("number"), border(i * step).alias("low"), border((i + 1) * step).alias("high")))

    seen = Observation()
    rows = found.select(F.explode(F.concat(level(0, width), level(1, 1))).alias("x")).select("x.*")
    written = cut_lineage(rows.observe(seen, F.count_if(F.col("low") == F.col("high")).alias("repeated")))
    return written, seen.get["repeated"] > 0
