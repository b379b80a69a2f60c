"""Column arithmetic shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top, bottom) -> Column:
    """``top / bottom`` as double, null when ``bottom`` is zero or null."""
    return F.try_divide(F.col(top) if isinstance(top, str) else top,
                        (F.col(bottom) if isinstance(bottom, str) else bottom)
                        .cast("double"))


def percent(part, whole, digits: int | None = 2) -> Column:
    value = 100 * ratio(part, whole)
    return value if digits is None else F.round(value, digits)


def rounded(column, digits: int, half_even: bool = False) -> Column:
    """Half away from zero, or half to even for callers that need numpy's rule."""
    return F.bround(column, digits) if half_even else F.round(column, digits)


def share(condition: Column) -> Column:
    """Share of the rows of a group that meet ``condition`` (nulls do not)."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def code_to_name(column, mapping: dict, default=None) -> Column:
    """Look a value up in a short fixed mapping, without a join."""
    col = F.col(column) if isinstance(column, str) else column
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), col)
    return found if default is None else F.coalesce(found, F.lit(default))
