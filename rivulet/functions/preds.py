"""Predicates as Columns."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {
    "equal": operator.eq,
    "nonequal": operator.ne,
    "less": operator.lt,
    "nonless": operator.ge,
    "greater": operator.gt,
    "nongreater": operator.le,
}


def compare(op: str, a: Column, b: Column) -> Column:
    return COMPARISONS[op](a, b)


def all_of(*ps: Column) -> Column:
    return reduce(operator.and_, ps)


def any_of(*ps: Column) -> Column:
    return reduce(operator.or_, ps)


def between(x: Column, low, high, with_low: bool = True, with_high: bool = True) -> Column:
    return (x >= low if with_low else x > low) & (x <= high if with_high else x < high)


def distance(a: Column, b: Column, dates: bool = False) -> Column:
    """Difference of numbers, or in days."""
    return F.abs(F.datediff(a, b)) if dates else F.abs(a - b)


def within(a: Column, b: Column, d, closed: bool = True, dates: bool = False) -> Column:
    """The symmetric band |a - b| <= d, or < d."""
    x = distance(a, b, dates)
    return x <= d if closed else x < d


def shifted(op: str, a: Column, b: Column, d) -> Column:
    """The band of width 2d whose upper end is ``a op b + d``."""
    return COMPARISONS[op](a, b + d) & (a >= b - d)


def like_contains(text: Column, pattern: str) -> Column:
    """Whether the text holds the pattern without its percent signs."""
    return F.contains(text, F.lit(pattern.replace("%", "")))


def always(value: bool = True) -> Column:
    return F.lit(value)
