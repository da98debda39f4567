"""Expressions without a one-word name in ``pyspark.sql.functions``; all stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

col = F.col
lit = F.lit


def int_div(a: Column, b: Column) -> Column:
    """Integer quotient truncated toward zero; dividing by zero raises under ANSI mode."""
    return F.call_function("div", a, b)


def is_true(cond: Column) -> Column:
    return cond.eqNullSafe(F.lit(True))


def is_false(cond: Column) -> Column:
    return cond.eqNullSafe(F.lit(False))


def not_distinct(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def like(c: Column, pattern: str, *, escape: str = "\\", ignore_case: bool = False) -> Column:
    """LIKE or ILIKE with an escape character; a NULL operand gives NULL."""
    f = F.ilike if ignore_case else F.like
    return f(c, F.lit(pattern), F.lit(escape))


def count_all() -> Column:
    return F.count(F.lit(1))


def count_rows_with(*cols: Column) -> Column:
    """COUNT(a, b, ...): rows in which no argument is NULL."""
    return F.call_function("count", *cols)
