"""Aggregations: count, sum, average (also as sum and count), distinct ones, several at once, and running ones with their changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.operators.rows import Operator
from rivulet.operators.slices import Slices, slices_of


def count(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def total(x: Column, name: str) -> Column:
    return F.sum(x).alias(name)


def average(x: Column, name: str) -> Column:
    return F.avg(x).alias(name)


def sum_and_count(x: Column, name: str) -> list[Column]:
    """An average that can be merged further: <name>_sum and <name>_count, never divided."""
    return [F.sum(x).alias(f"{name}_sum"), F.count(x).alias(f"{name}_count")]


def group(keys: Mapping[str, Column] | Sequence[str], *aggs: Column, empty_row: bool = False) -> Operator:
    """By columns or named expressions. Without keys an empty input gives no row, unless empty_row asks for it."""

    def run(df: DataFrame) -> DataFrame:
        cols = [c.alias(n) for n, c in keys.items()] if isinstance(keys, Mapping) else [F.col(k) for k in keys]
        if cols:
            return df.groupBy(*cols).agg(*aggs)
        out = df.agg(*aggs, *([] if empty_row else [F.count(F.lit(1)).alias("__rows")]))
        return out if empty_row else out.where("__rows > 0").drop("__rows")

    return run


def distinct_group(keys: Sequence[str], of: Sequence[str], *aggs: Column, over_all: bool = False) -> Operator:
    """Aggregates over rows that differ in ``of``: within each group, or (over_all) once in the whole input, at the smallest group."""

    def run(df: DataFrame) -> DataFrame:
        if over_all:
            first = df.groupBy(*of).agg(F.min(F.struct(*keys)).alias("__g")).select(*of, *[F.col(f"__g.{k}").alias(k) for k in keys]) if keys else df.select(*of).distinct()
            return first.groupBy(*keys).agg(*aggs)
        return df.select(*dict.fromkeys([*keys, *of])).distinct().groupBy(*keys).agg(*aggs)

    return run


def running(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str = "total", tie: str | None = None, slices: int | None = None) -> DataFrame:
    """Every row with the running sum of its key before (old_<name>, null at first) and after it (new_<name>).

    A key with more than one in ``slices`` rows (by default eight for each
    shuffle partition) is cut into slices of its own order column; sums run
    within a slice and the totals of the slices before are added, so no task
    has to hold a whole key, however many rows it has. Sums of doubles lose
    digits as they do in any order; amounts as decimals or whole cents don't.
    """
    hashed = F.xxhash64(*[F.col(k) for k in keys]) if keys else F.lit(0).cast("bigint")
    cut = Slices(df, slices or slices_of(df.sparkSession), hashed, order).added(df, "__slice").withColumn("__v", value)
    by = [F.col(order), *([F.col(tie)] if tie else [])]
    inside = W.partitionBy(*keys, "__slice").orderBy(*by)
    rows = cut.withColumn("__run", F.sum("__v").over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn("__at", F.row_number().over(inside))
    sums = cut.groupBy(*keys, "__slice").agg(F.sum("__v").alias("__s"))
    before = sums.select(*keys, "__slice", F.sum("__s").over(W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    same = reduce(lambda a, k: a & F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")), keys, F.col("r.__slice") == F.col("b.__slice"))
    joined = rows.alias("r").join(before.alias("b"), same).select("r.*", "b.__before")
    new = F.coalesce("__before", F.lit(0)) + F.col("__run")
    first = F.col("__before").isNull() & (F.col("__at") == 1)
    return joined.select(*df.columns, F.when(~first, new - F.col("__v")).alias(f"old_{name}"), new.alias(f"new_{name}"))


def deltas(df: DataFrame, keys: Sequence[str], order: str, value: Column, tie: str | None = None) -> DataFrame:
    """(keys.., order, delta): the changes an incremental sum hands on; the first change of a key is its first value."""
    r = running(df, keys, order, value, tie=tie)
    return r.select(*keys, order, *([tie] if tie else []), (F.col("new_total") - F.coalesce("old_total", F.lit(0))).alias("delta"))


def retractions(df: DataFrame, keys: Sequence[str], order: str, value: Column, tie: str | None = None) -> DataFrame:
    """(keys.., order, total, multiplicity): the old value with -1, the new one with +1."""
    r = running(df, keys, order, value, tie=tie)
    pair = F.array(
        F.struct(F.col("old_total").alias("total"), F.lit(-1).alias("multiplicity")),
        F.struct(F.col("new_total").alias("total"), F.lit(1).alias("multiplicity")),
    )
    return r.select(*keys, order, *([tie] if tie else []), F.inline(pair)).where("total is not null")


def heavy_hitters(df: DataFrame, key: str, threshold: int, name: str = "n") -> DataFrame:
    """Keys of at least ``threshold`` rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) >= threshold)
