"""Keys with many rows cut into slices of about even size, in proportion to the data.

A key is cut where it has more than one in ``number`` of all rows. There are
fewer such keys than ``number``, and fewer cuts than four times as many,
whatever the data, so both are collected and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.shared import shuffle_partitions


def slices_of(spark: SparkSession) -> int:
    """Eight for each task of a shuffle: enough for hashing to spread them evenly."""
    return 8 * shuffle_partitions(spark)


def place_among(cuts: Column, at: Column, steps: list[int], below: bool = False) -> Column:
    """How many of the sorted cuts lie before ``at`` (or are at most as large, if below), by binary search with the given powers of two, falling."""
    before = (lambda c: c <= at) if below else (lambda c: c < at)
    further = lambda n, step: F.when((n + step <= F.size(cuts)) & before(F.try_element_at(cuts, n + step)), n + step).otherwise(n)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)


class Slices:
    """Cuts the rows of each large ``key`` (a bigint) at quantiles of its own ``at``; rows of one moment aren't cut apart."""

    def __init__(self, rows: DataFrame, number: int, key: str | Column = "c1", at: str | Column = "c0"):
        self.key, self.at = (F.col(c) if isinstance(c, str) else c for c in (key, at))
        keyed = rows.select(self.key.alias("__k"), self.at.alias("__at")).where("__k is not null and __at is not null")
        total = rows.count()
        self.rows = max(1, -(-total // number))
        counts = keyed.groupBy("__k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > self.rows)
        found = counts.select("__k", F.ceil(F.log2(F.col("n") / self.rows)).cast("int")).collect()  # fewer than ``number``
        self.cuts = None
        if found:
            hot = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in found], "__key bigint, __level int"))
            # a percentile_approx has the same shares for all groups: one for each power of two, of which a key fills one
            of = lambda k: F.percentile_approx(F.when(F.col("__level") == k, F.col("__at")), [i / 2**k for i in range(1, 2**k)], 10 * 2**k)
            cuts = keyed.join(hot, F.col("__k") == F.col("__key")).groupBy("__key").agg(F.coalesce(*[of(k) for k in sorted({r[1] for r in found})]).alias("__cuts"))
            self.cuts = F.broadcast(cuts.select("__key", F.array_distinct("__cuts").alias("__cuts")))
            self.steps = [2**k for k in range(max(r[1] for r in found), -1, -1)]

    def added(self, df: DataFrame, name: str = "slice") -> DataFrame:
        """With the number of cuts of the row's key before it, 0 for all keys that aren't cut."""
        if self.cuts is None:
            return df.withColumn(name, F.lit(0))
        place = F.when(F.col("__cuts").isNotNull(), place_among(F.col("__cuts"), self.at, self.steps)).otherwise(0)
        return df.join(self.cuts, self.key == F.col("__key"), "left").withColumn(name, place).drop("__key", "__cuts")


def salts_of(rows: DataFrame, key: Column, number: int | None = None) -> DataFrame:
    """(__key, __salts) of the keys with more than one in ``number`` rows: as many salts as they fill slices. Fewer than ``number`` rows, broadcast."""
    number = number or slices_of(rows.sparkSession)
    each = max(1, -(-rows.count() // number))
    counts = rows.select(key.alias("__key")).where("__key is not null").groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > each)
    return F.broadcast(counts.select("__key", F.ceil(F.col("n") / each).cast("bigint").alias("__salts")))


def salted(df: DataFrame, key: Column, salts: DataFrame, name: str) -> DataFrame:
    """Rows of large keys spread over their salts."""
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.coalesce("__salts", F.lit(1)))
    return df.join(salts, key == F.col("__key"), "left").withColumn(name, spread).drop("__key", "__salts")


def copied(df: DataFrame, key: Column, salts: DataFrame, name: str) -> DataFrame:
    """Rows of large keys once for each of their salts."""
    return df.join(salts, key == F.col("__key"), "left").withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("__salts", F.lit(1)) - 1))).drop("__key", "__salts")
