"""Per-key results where a few keys hold most rows: eager aggregation through joins.

Both inputs are first reduced to one compact state per join key (a count and
sums, combined before the shuffle by partial aggregation), the states are
joined, counts are multiplied and sums scaled by the other side's count, and the
result is rolled up. A key with a third of all rows sends at most one row from
each map task and joins as one row, so no task has more to do than another.

Nulls: a null join key joins nothing but counts in a state of its own; null
measures are left out of sums. Repeated rows count as often as they stand
there. Empty inputs give no rows. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.shared import staged


def compact(df: DataFrame, key: Mapping[str, Column], group: Mapping[str, Column] | None = None, sums: Mapping[str, Column] | None = None, n: str = "n") -> DataFrame:
    """One row per key (and group): the count n and the sums."""
    cols = [c.alias(a) for a, c in {**key, **(group or {})}.items()]
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(n), *[F.sum(c).alias(a) for a, c in (sums or {}).items()])


def join_states(left: DataFrame, right: DataFrame, on: Sequence[str], group: Sequence[str], left_sums: Sequence[str] = (), right_sums: Sequence[str] = ()) -> DataFrame:
    """What a join of the full inputs followed by count and sums by ``group`` would give, from states with counts ln and rn."""
    joined = left.join(right, list(on))
    return joined.groupBy(*group).agg(
        F.sum(F.col("ln") * F.col("rn")).alias("n"),
        *[F.sum(F.col(s) * F.col("rn")).alias(s) for s in left_sums],
        *[F.sum(F.col(s) * F.col("ln")).alias(s) for s in right_sums],
    )


def heavy_keys(fields: Sequence[tuple[str, str, DataFrame]], share: int = 20) -> DataFrame:
    """(tab, field, heavy_key): values that hold at least 1/share of all rows of their table. fields: table name, column name, table.

    A value's share of its table is its share of the pairs that the table's
    rows make with all rows of the table. That join is done eagerly: one input
    is reduced to a state per value, the other to a state per table (rolled up
    from the same, as both are one table, which is read once), the states are
    joined by table, and the counts multiplied.
    """
    states = None
    for tab, field, df in fields:
        one = compact(df, {"tab": F.lit(tab), "field": F.lit(field)}, {"heavy_key": F.col(field).cast("string")}, n="ln")
        states = one if states is None else states.unionByName(one)
    states = staged(states, "states")
    whole = states.groupBy("tab", "field").agg(F.sum("ln").alias("rn"))  # a row for each field given, so it is broadcast: by shuffle each field would gather in one task
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731 - pairs of rows outgrow 64 bits
    joined = states.where("heavy_key is not null").join(F.broadcast(whole), ["tab", "field"])
    pairs = joined.withColumn("pairs", wide("ln") * wide("rn")).where(F.col("pairs") * share >= wide("rn") * wide("rn"))
    return pairs.groupBy("tab", "field", "heavy_key").agg(F.sum("pairs").alias("pairs")).select("tab", "field", "heavy_key")
