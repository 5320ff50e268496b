"""Date functions of the step language: literals, day numbers, INTNX and INTCK."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepframe.semantics import StepError, from_sas_date, to_sas_date

__all__ = ["date_literal", "from_sas_date", "intck", "intnx", "to_sas_date", "write_date"]

_MONTHS = {"month": 1, "qtr": 3, "semiyear": 6, "year": 12}


def date_literal(text: Column) -> Column:
    """'01JAN2023' -> date; anything unreadable is NULL."""
    return F.try_to_date(F.initcap(F.lower(text)), "ddMMMyyyy")


def write_date(date: Column) -> Column:
    """date -> '01JAN2023'."""
    return F.upper(F.date_format(date, "ddMMMyyyy"))


def _month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def _month_start(index: Column) -> Column:
    return F.make_date(F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1))


def _sunday(date: Column) -> Column:
    return F.date_sub(date, F.dayofweek(date) - 1)


def _begin(unit: str, date: Column, n: Column) -> Column:
    if unit == "day":
        return F.date_add(date, n)
    if unit == "week":
        return F.date_add(_sunday(date), n * 7)
    months = _MONTHS[unit]
    index = _month_index(date)
    return _month_start(index - F.pmod(index, F.lit(months)) + n * months)


def _unit(unit: str) -> str:
    unit = unit.lower()
    if unit not in ("day", "week", *_MONTHS):
        raise StepError(f"unknown interval {unit!r}; known: day, week, {', '.join(_MONTHS)}")
    return unit


def intnx(unit: str, date: Column, n: int | Column, align: str = "begin") -> Column:
    """Move by n intervals and align to its begin, end or the same place; weeks start on Sunday."""
    unit = _unit(unit)
    date = date.cast("date")
    n = F.lit(n) if isinstance(n, int) else n.cast("int")
    if align == "begin":
        return _begin(unit, date, n)
    if align == "end":
        return F.date_sub(_begin(unit, date, n + 1), 1)
    if align == "same":
        if unit in _MONTHS:
            return F.add_months(date, n * _MONTHS[unit])
        return F.date_add(date, n * (7 if unit == "week" else 1))
    raise StepError(f"align must be begin, end or same, not {align!r}")


def intck(unit: str, start: Column, stop: Column) -> Column:
    """How many interval boundaries lie between two dates (negative backwards)."""
    unit = _unit(unit)
    start, stop = start.cast("date"), stop.cast("date")
    if unit == "day":
        return F.datediff(stop, start)
    if unit == "week":
        return (F.datediff(_sunday(stop), _sunday(start)) / 7).cast("int")
    months = _MONTHS[unit]
    period = lambda d: F.floor(_month_index(d) / months)
    return (period(stop) - period(start)).cast("int")
