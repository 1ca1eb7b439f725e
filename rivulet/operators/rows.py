"""Row operators: filter, project, chain, union, distinct, sample, map and flat map."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Operator = Callable[[DataFrame], DataFrame]


class Row:
    """Stands for a row in a lambda: its attributes and items are Columns, so a lambda becomes one expression, run in the JVM."""

    def __init__(self, df: DataFrame):
        object.__setattr__(self, "_df", df)

    def __getattr__(self, name: str) -> Column:
        if name in self._df.columns:
            return F.col(f"`{name}`")
        raise AttributeError(f"no column {name} among {self._df.columns}")

    def __getitem__(self, i: int | str) -> Column:
        return F.col(f"`{self._df.columns[i] if isinstance(i, int) else i}`")


def _named(values) -> list[Column]:
    if isinstance(values, dict):
        return [(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in values.items()]
    values = values if isinstance(values, (tuple, list)) else (values,)
    return [c if isinstance(c, Column) else F.lit(c) for c in values]


def select(condition: Column | Callable[[Row], Column]) -> Operator:
    return lambda df: df.where(condition(Row(df)) if callable(condition) and not isinstance(condition, Column) else condition)


def project(*columns: int | str | Column) -> Operator:
    """By position, name or expression; rows are never merged."""
    return lambda df: df.select(*[df[df.columns[c]] if isinstance(c, int) else c for c in columns])


def chain(*operators: Operator) -> Operator:
    def run(df: DataFrame) -> DataFrame:
        for op in operators:
            df = op(df)
        return df

    return run


def union(*inputs: DataFrame) -> DataFrame:
    """All rows of all inputs, columns by position."""
    out = inputs[0]
    for df in inputs[1:]:
        out = out.unionAll(df)
    return out


def distinct(keys: Sequence[str], first_by: Sequence[Column] | None = None) -> Operator:
    """One whole row for each key: any, or the first in the given order."""

    def run(df: DataFrame) -> DataFrame:
        if not first_by:
            return df.dropDuplicates(list(keys))
        n = "__place"
        return df.withColumn(n, F.row_number().over(W.partitionBy(*keys).orderBy(*first_by))).where(F.col(n) == 1).drop(n)

    return run


def sample(rate: float, seed: int = 1) -> Operator:
    return lambda df: df if rate >= 1 else df.sample(False, rate, seed)


def sample_for_buckets(rows: int, buckets: int, rows_per_bucket: int = 100, seed: int = 1) -> Operator:
    """So many rows as an equi-depth histogram of that many buckets needs."""
    return sample(min(1.0, buckets * rows_per_bucket / max(rows, 1)), seed)


def among(column: str, values: Sequence) -> Operator:
    """Rows whose column is one of a given set, as arcs of chosen hubs."""
    return lambda df: df.where(F.col(column).isin(*values))


def map_rows(fn: Callable[[Row], object]) -> Operator:
    """fn gives the new columns, as a dict, tuple or single Column."""
    return lambda df: df.select(*_named(fn(Row(df))))


def flat_map(fn: Callable[[Row], Column], name: str = "value", keep: Sequence[str] = ()) -> Operator:
    """fn gives an array column; each of its items becomes a row."""
    return lambda df: df.select(*keep, F.explode(fn(Row(df))).alias(name))
