"""Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, whatever the number of places it is used in."""
    return F.element_at(F.transform(F.array(value), body), 1)
