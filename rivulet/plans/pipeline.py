"""Functional front end: sources, filter, map, flat map, join, grouping and windows, written with lambdas over rows.

A lambda runs once, over a stand-in whose attributes are Columns; what it gives
is the expression. Python's and/or/if on a Column fail at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators.joins import sliding_join
from rivulet.operators.rows import Row, flat_map, map_rows, select
from rivulet.operators.windows import numbered_windows, windowed
from rivulet.sources.registry import Sources


class Stream:
    def __init__(self, df: DataFrame):
        self._df = df

    @staticmethod
    def source(sources: Sources, name: str) -> Stream:
        return Stream(sources.load(name))

    def filter(self, fn: Callable[[Row], Column]) -> Stream:
        return Stream(select(fn)(self._df))

    def map(self, fn: Callable[[Row], object]) -> Stream:
        return Stream(map_rows(fn)(self._df))

    def flat_map(self, fn: Callable[[Row], Column], name: str = "value", keep: Sequence[str] = ()) -> Stream:
        return Stream(flat_map(fn, name, keep)(self._df))

    def join(self, other: Stream, key: Callable[[Row], Column], other_key: Callable[[Row], Column]) -> Stream:
        """On equal keys; columns of the other side whose names are taken get the suffix _2."""
        left, right = self._df, _renamed(other._df, self._df.columns)
        k2 = other_key(Row(other._df))
        right = _renamed(other._df.withColumn("__k2", k2), self._df.columns)
        return Stream(left.withColumn("__k1", key(Row(left))).join(right, F.col("__k1") == F.col("__k2")).drop("__k1", "__k2"))

    def on_sliding_window(self, other: Stream, ts: str, other_ts: str, seconds: float, on: Sequence[tuple[str, str]] = ()) -> Stream:
        """Pairs at most so many seconds apart."""
        taken = self._df.columns
        name = lambda c: f"{c}_2" if c in taken else c
        return Stream(sliding_join(self._df, _renamed(other._df, taken), ts, name(other_ts), seconds, on=[(a, name(b)) for a, b in on]))

    def group_by_key(self, agg: Callable[[Row], Column | int], key: Callable[[Row], object] | None = None) -> Grouped:
        """The sum of ``agg`` for each key; a count is the sum of 1."""
        return Grouped(self._df, agg, key)

    def to_df(self) -> DataFrame:
        return self._df


class Grouped:
    def __init__(self, df: DataFrame, agg, key, window: tuple[str, int, int | None, bool] | None = None):
        self._df, self._agg, self._key, self._window = df, agg, key, window

    def on_window(self, ts: str, seconds: int, slide: int, numbered: bool = False) -> Grouped:
        return Grouped(self._df, self._agg, self._key, (ts, seconds, slide, numbered))

    def on_tumbling_window(self, ts: str, seconds: int, numbered: bool = False) -> Grouped:
        return Grouped(self._df, self._agg, self._key, (ts, seconds, None, numbered))

    def to_df(self, name: str = "total") -> DataFrame:
        row = Row(self._df)
        keys = self._key(row) if self._key else ()
        keys = dict(keys) if isinstance(keys, dict) else {f"_{k + 1}": c for k, c in enumerate(keys if isinstance(keys, (tuple, list)) else (keys,))}
        value = self._agg(row)
        value = value if isinstance(value, Column) else F.lit(value)
        df = self._df.withColumns({**keys, "__v": value})
        total = F.sum("__v").alias(name)
        if self._window is None:
            return df.groupBy(*keys).agg(total)
        ts, seconds, slide, numbered = self._window
        return (numbered_windows if numbered else windowed)(df, ts, seconds, total, slide=slide, keys=list(keys))


def _renamed(df: DataFrame, taken: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{c}_2" if c in taken else c) for c in df.columns])
