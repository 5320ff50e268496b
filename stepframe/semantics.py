"""The data rules every operator follows: names, missing values, dates, order keys.

Numeric missing is SQL NULL everywhere inside the package; NaN is turned into NULL where data enters.
Row order never comes from storage: operators whose result depends on it demand explicit order keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAS_EPOCH = "1960-01-01"


class StepError(ValueError):
    """Raised for an unknown column, a missing order key or a conflicting option."""


def dataset_name(name: str) -> str:
    """`Work.Scored` -> `work_scored`."""
    return name.strip().lower().replace(".", "_")


def normalize_names(df: DataFrame) -> DataFrame:
    """Lower-case every column and replace dots; two columns may not end up equal."""
    names = [dataset_name(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise StepError(f"column names collide after lower-casing: {clashes}")
    return df.toDF(*names)


def require_columns(df: DataFrame, columns: Iterable[str], role: str = "column") -> None:
    unknown = sorted(set(columns) - set(df.columns))
    if unknown:
        raise StepError(f"unknown {role}: {unknown}; known: {df.columns}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")).cast(df.schema[c].dataType) for c in floating})


def is_missing(df: DataFrame, column: str) -> Column:
    """NULL, or NaN in a floating column."""
    test = F.col(column).isNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        test = test | F.isnan(column)
    return test


def is_numeric_class(data_type: T.DataType) -> bool:
    """Only two classes of value exist for parity: numeric (booleans included) and object."""
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def value_class(data_type: T.DataType) -> str:
    return "numeric" if is_numeric_class(data_type) else "object"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_class(f.dataType)]


def from_sas_date(days: Column) -> Column:
    """Days since 1960-01-01 -> date."""
    return F.date_add(F.lit(SAS_EPOCH).cast("date"), days.cast("int"))


def to_sas_date(date: Column) -> Column:
    return F.datediff(date, F.lit(SAS_EPOCH).cast("date"))


@dataclass(frozen=True)
class Key:
    """One BY variable and its direction."""

    name: str
    descending: bool = False

    def column(self, na_position: str = "default") -> Column:
        c = F.col(self.name)
        if na_position == "last":
            return c.desc_nulls_last() if self.descending else c.asc_nulls_last()
        if na_position == "first":
            return c.desc_nulls_first() if self.descending else c.asc_nulls_first()
        if na_position != "default":
            raise StepError(f"na_position must be default, first or last, not {na_position!r}")
        return c.desc() if self.descending else c.asc()


def by_keys(clause: str | Sequence[str | Key]) -> list[Key]:
    """Read a BY clause: `"dept DESCENDING salary"`, or a list of such pieces."""
    words: list[str | Key] = []
    for piece in [clause] if isinstance(clause, str) else clause:
        words.extend([piece] if isinstance(piece, Key) else piece.split())
    keys: list[Key] = []
    descending = False
    for word in words:
        if isinstance(word, Key):
            keys.append(word)
        elif word.upper() in ("DESCENDING", "ASCENDING"):
            descending = word.upper() == "DESCENDING"
        else:
            keys.append(Key(word, descending))
            descending = False
    return keys


def require_order(df: DataFrame, order_by: str | Sequence[str | Key]) -> list[Key]:
    keys = by_keys(order_by)
    if not keys:
        raise StepError("this operator depends on row order: name its order_by keys")
    require_columns(df, [k.name for k in keys], "order key")
    return keys


def names_of(columns: str | Sequence[str]) -> list[str]:
    return columns.split() if isinstance(columns, str) else list(columns)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on named keys where a missing key equals a missing key; the left key columns are kept."""
    right = right.withColumnsRenamed({k: f"__same_{k}" for k in keys})
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"__same_{k}")) for k in keys], how).drop(*[f"__same_{k}" for k in keys])
