"""Scalar expressions; each gives a Column that stays inside generated code."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_at(df: DataFrame, i: int) -> Column:
    """The i-th column, for plans that count columns."""
    return df[df.columns[i]]


def const(value) -> Column:
    return F.lit(value)


def add(*xs: Column) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out + x
    return out


def subtract(*xs: Column) -> Column:
    """From left to right."""
    out = xs[0]
    for x in xs[1:]:
        out = out - x
    return out


def multiply(*xs: Column) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out * x
    return out


def divide_int(*xs: Column) -> Column:
    """Division as doubles, cut to an integer toward zero; null for a zero divisor."""
    out = xs[0].cast("double")
    for x in xs[1:]:
        out = F.try_divide(out, x.cast("double"))
    return out.cast("int")


def concat(*xs: Column) -> Column:
    return F.concat(*[x.cast("string") for x in xs])


UNITS = {"day": "days", "week": "weeks", "month": "months", "year": "years"}


def date_plus(d: Column, unit: str, n: int) -> Column:
    """Calendar addition to a date."""
    return (d.cast("timestamp_ntz") + F.make_interval(**{UNITS[unit]: F.lit(n)})).cast("date")


def days_between(a: Column, b: Column) -> Column:
    """Days from a to b."""
    return F.datediff(b, a)


def year(d: Column) -> Column:
    return F.year(d)


def date_int(d: Column) -> Column:
    """yyyymmdd as an integer."""
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def date_of_int(i: Column) -> Column:
    return F.to_date(i.cast("string"), "yyyyMMdd")


def cents(x: Column) -> Column:
    """The digits of an amount with two decimals, without its point."""
    return F.round(x * 100).cast("int")


def digits(text: Column) -> Column:
    """The digits of a number's text without its point, however many decimals it is written with."""
    return F.replace(text, F.lit("."), F.lit("")).cast("int")


def key_of_int_amount(i: Column, amount: Column, divider: int) -> Column:
    """One bigint from an integer and an amount of two decimals."""
    return i.cast("bigint") + F.try_divide(cents(amount).cast("double"), F.lit(divider * 100.0)).cast("bigint") * 100000000


def key_of_int_text(i: Column, text: Column) -> Column:
    """One integer from an integer and the digit a text begins with."""
    return i + F.substring(text, 1, 1).cast("int") * 100000000


def phone_number(text: Column, first_digits: int | None = None) -> Column:
    """A phone number's digits, or the first of them, as a bigint."""
    s = F.replace(text, F.lit("-"), F.lit(""))
    return (s if first_digits is None else F.substring(s, 1, first_digits)).cast("bigint")


def as_date(text: str) -> Column:
    return F.lit(date.fromisoformat(text))
