"""Scalar functions: text, arithmetic, missing values, value labels, user functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepframe.semantics import StepError
from stepframe.sizing import cut_lineage


def joined_name(*parts: Column, separator: str = " ") -> Column:
    """TRIM(a) || ' ' || TRIM(b): NULL if any part is."""
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        pieces.extend([F.lit(separator)] if i else [])
        pieces.append(F.trim(part))
    return F.concat(*pieces)


def divide(a: Column, b: Column) -> Column:
    """a / b; NULL if b is zero or either is missing."""
    return F.try_divide(a, b)


def log(x: Column) -> Column:
    """Natural logarithm, NULL outside its domain."""
    return F.when(x > 0, F.ln(x))


def logit(x: Column) -> Column:
    return log(F.try_divide(x, 1 - x))


def missing(x: Column, floating: bool = False) -> Column:
    """1 if missing, else 0; `floating` also counts NaN."""
    test = x.isNull() | F.isnan(x) if floating else x.isNull()
    return F.when(test, 1).otherwise(0)


def value_labels(column: Column, labels: Mapping[object, str], other: str | None = None) -> Column:
    """A small VALUE format inlined as branches; unlisted values print as themselves or as `other`."""
    default = column.cast("string") if other is None else F.lit(other)
    chain = None
    for value, label in labels.items():
        chain = F.when(column == value, label) if chain is None else chain.when(column == value, label)
    return F.when(column.isNull(), F.lit(None)).otherwise(chain.otherwise(default)) if chain is not None else default


def label_by_table(df: DataFrame, column: str, labels: DataFrame, value: str, label: str, name: str) -> DataFrame:
    """A format kept in a table. It is written first, so that Spark knows its bytes and broadcasts it only if they are few."""
    lookup = cut_lineage(labels.select(F.col(value).alias("__value"), F.col(label).alias(name)))
    return df.join(lookup, F.col(column) == F.col("__value"), "left").drop("__value")


def picture(column: Column, decimals: int = 2, prefix: str = "") -> Column:
    """PICTURE-like text: thousands separators, fixed decimals, optional prefix."""
    return F.concat(F.lit(prefix), F.format_number(column, decimals))


def read_number(text: Column, template: str = "999,999,999.99") -> Column:
    """INFORMAT-like reading of formatted numbers; NULL if the text does not fit."""
    return F.try_to_number(text, F.lit(template)).cast("double")


def define_function(spark: SparkSession, name: str, arguments: Mapping[str, str], returns: str, expression: str) -> None:
    """PROC FCMP with an expression body: a SQL function that Spark inlines into the plan."""
    for word in (name, *arguments):
        if not word.isidentifier():
            raise StepError(f"not a name: {word!r}")
    signature = ", ".join(f"{a} {t}" for a, t in arguments.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature}) RETURNS {returns} RETURN {expression}")


def batch_function(function: Callable[..., pd.Series], returns: str = "double"):
    """PROC FCMP with a body that is no expression: whole Arrow batches, never single rows."""
    return F.pandas_udf(function, returns)
