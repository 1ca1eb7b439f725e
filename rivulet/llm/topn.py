"""The N highest-scoring items of every group, ranked, ties always settled alike (smaller item first).

Method: a global range-partitioned sort on group, score and item; counts per
partition and group are prefix-summed into exact positions; positions up to N
stay. See ``ranked``.

Nulls: rows without group, score or item are left out. Repeated rows of one
key: the latest load counts, a null load is the earliest, rows alike in load
are settled by their values. Empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.ranked import placed, positions

AMOUNT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?$"


def amount(c: Column) -> Column:
    """An amount of one currency as a double: currency signs and codes, thousands separators, exponents, and the accountants' brackets and trailing minus; null for anything else."""
    s = F.regexp_replace(F.translate(c, "−", "-"), r"[\s\x{a0}]+", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^([+-]?)(?:\$|€|£|USD|EUR|GBP)([+-]?)", "$1$2"), r"(?:USD|EUR|GBP|€)$", "")
    s = F.regexp_replace(s, r"^\((?:\$|€|£|USD|EUR|GBP)?(\d[\d,]*\.?\d*|\.\d+)\)$", "-$1")
    s = F.regexp_replace(s, r"^(\d[\d,]*\.?\d*|\.\d+)-$", "-$1")
    s = F.when(s.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d*)?$"), F.translate(s, ",", "")).otherwise(s)
    return F.when(s.rlike(AMOUNT), s.try_cast("double") + F.lit(0.0))


def latest(df: DataFrame, key: str, *values: str) -> DataFrame:
    """The row of the latest loaded_at for each key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("loaded_at", *values)).alias("s")).select(key, *[F.col(f"s.{v}").alias(v) for v in values])


def top_n(df: DataFrame, group: list[str], score: str, item: str, n: Column, most: int) -> DataFrame:
    """(group.., rnk, item) of the items placed up to n, the same for all rows of a group and no more than ``most``."""
    rows, offsets = positions(df.select(*group, score, item).where(F.col(score).isNotNull() & F.col(item).isNotNull()), group, [F.col(score).desc(), F.col(item).asc()], keep=most)
    return placed(rows, offsets, group).where(F.col("__place") <= n).select(*group, F.col("__place").cast("int").alias("rnk"), F.col(item).alias("item"))
