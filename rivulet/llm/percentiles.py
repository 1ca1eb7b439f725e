"""Percentiles by cumulative frequencies.

The mergeable partial result is the count per group and value; states of
several days or loads are combined by adding counts, and the percentiles read
from them are exact (error 0): the p-th is the smallest value whose cumulative
count reaches ceil(p * n), at least 1.

Values are range-sorted within groups, running sums are taken within
partitions, partition offsets are added, and the first value that reaches each
target rank is picked: only the rows where a target falls leave their partition.

Nulls: null values (and NaN) are left out; a null group is a group of its own. A
group without values has no row. Repeated rows count as often as they stand
there; -0.0 and 0.0 are one value. Empty tables give no rows; extra columns are
ignored, and groups may not be named as the results are (value, n, size, share).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.ranked import positions
from rivulet.shared import broadcast_if_small


def frequencies(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The partial result: (group.., value, n)."""
    if taken := {"value", "n", "size", "share"} & set(group):
        raise ValueError(f"groups may not be named {sorted(taken)}")
    v = F.col(value).cast("double") + F.lit(0.0)
    return df.select(*group, v.alias("value")).where("value is not null and not isnan(value)").groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))


def merged(states: Sequence[DataFrame], group: Sequence[str]) -> DataFrame:
    """Partial results of several loads as one."""
    total = states[0]
    for s in states[1:]:
        total = total.unionByName(s)
    return total.groupBy(*group, "value").agg(F.sum("n").alias("n"))


def percentiles(state: DataFrame, group: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(group.., share, value, n): value is the share-percentile of the group's n values."""
    group = list(group)
    rows, offsets = positions(state, group, [F.col("value").asc()], weight="n", every_group=True)
    sizes = offsets.groupBy(*group).agg(F.sum("__total").alias("size"))

    def same(a: str, b: str) -> Column:
        return reduce(lambda x, g: x & F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")), group, F.lit(True))

    known = offsets.alias("o").join(sizes.alias("z"), same("o", "z")).select(*[F.col(f"o.{g}").alias(g) for g in group], "__pid", "__before", "size")
    known = broadcast_if_small(known, 100_000)
    targets = F.array(*[F.lit(float(p)) for p in shares])
    end = F.col("__before") + F.col("__pos")
    placed = (
        rows.alias("r")
        .join(known.alias("k"), same("r", "k") & (F.col("r.__pid") == F.col("k.__pid")))
        .select(*[F.col(f"r.{g}").alias(g) for g in group], "value", (end - F.col("r.n")).alias("start"), end.alias("end"), "size")
    )

    def reached(p: Column) -> Column:
        rank = F.greatest(F.lit(1), F.ceil(p * F.col("size")))
        return (rank > F.col("start")) & (rank <= F.col("end"))

    return placed.where(F.exists(targets, reached)).select("*", F.explode(targets).alias("share")).where(reached(F.col("share"))).select(*group, "share", "value", F.col("size").alias("n"))
