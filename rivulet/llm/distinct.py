"""Distinct counts by stochastic averaging: bit matrices of hash ranks.

A sketch is up to ``buckets`` rows (bucket, bits): an identifier's hash picks
the bucket by its low bits and sets one bit, the place of the lowest 1 among
the rest. Sketches merge by bitwise OR, in any order and any number of times, so
results of days or loads add up, and a row that comes twice changes nothing. A
small set takes no more rows than it has members.

The count is the maximum-likelihood estimate: bit k of a bucket is empty with
probability exp(-n * 2^-(k+1) / buckets), so the number of buckets in which it
is set is all that matters. The standard error comes from the Fisher
information, less the Poisson part that a fixed count doesn't have; it is at
most about 0.65 / sqrt(buckets), 1.0 % at 4096.

Nulls: a null identifier isn't counted; null group values are values. A group
without identifiers has no row. Empty tables give no rows; extra columns are
ignored, and groups may not be named metric, bucket, bits, h or r.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.shared import ship

BITS, LANES = 48, 4  # ranks kept; counters in one bigint while they are summed


def sketch(df: DataFrame, group: Mapping[str, Column], ids: Mapping[str, Column], buckets: int = 4096) -> DataFrame:
    """(group.., metric, bucket, bits): one sketch for each group and each named identifier."""
    if buckets & (buckets - 1) or not 16 <= buckets <= 32768:
        raise ValueError("buckets must be a power of two from 16 to 32768")
    if taken := {"metric", "bucket", "bits", "h", "r"} & set(group):
        raise ValueError(f"groups may not be named {sorted(taken)}")
    width = buckets.bit_length() - 1
    names = sorted(ids)
    hashed = df.select(*[c.alias(g) for g, c in group.items()], *[F.when(c.isNotNull(), F.xxhash64(c)).alias(f"h_{m}") for m, c in ids.items()])
    pairs = F.inline(F.array(*[F.struct(F.lit(k << width).alias("metric"), F.col(f"h_{m}").alias("h")) for k, m in enumerate(names)]))
    rest = F.bitwise_not(F.lit(0)).cast("bigint")  # all ones
    rank_bits = F.shiftrightunsigned("h", width).bitwiseOR(F.lit(1 << (BITS - 1)))
    # while they are shuffled, metric and bucket are one number
    return (
        hashed.select(*group, pairs)
        .where("h is not null")
        .select(*group, F.col("h").bitwiseAND(F.lit(buckets - 1)).cast("int").bitwiseOR(F.col("metric")).alias("bucket"), rank_bits.alias("r"))
        .select(*group, "bucket", F.col("r").bitwiseAND((F.col("r").bitwiseXOR(rest)) + F.lit(1)).alias("bits"))
        .groupBy(*group, "bucket")
        .agg(F.bit_or("bits").alias("bits"))
        .select(*group, F.element_at(F.array(*[F.lit(m) for m in names]), F.shiftright("bucket", width) + 1).alias("metric"), F.col("bucket").bitwiseAND(F.lit(buckets - 1)).alias("bucket"), "bits")
    )


def merge(sketches: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sketches brought together in coarser groups; also unions of sketches of several loads."""
    return sketches.groupBy(*group, "metric", "bucket").agg(F.bit_or("bits").alias("bits"))


def estimates(sketches: DataFrame, group: Sequence[str], buckets: int = 4096) -> DataFrame:
    """(group.., metric, estimate, std_error, low, high); low and high lie two standard errors off."""
    ship(sketches.sparkSession)
    lanes = []
    for k in range(0, BITS, LANES):
        word = F.lit(0).cast("bigint")
        for j in range(LANES):
            word = word + F.shiftleft(F.shiftrightunsigned("bits", k + j).bitwiseAND(F.lit(1).cast("bigint")), 16 * j)
        lanes.append(F.sum(word).alias(f"w{k // LANES}"))
    counted = sketches.groupBy(*group, "metric").agg(*lanes)
    solved = counted.select(*group, "metric", _solver(buckets)(F.struct(*[F.col(f"w{k}") for k in range(BITS // LANES)])).alias("e"))
    return solved.select(*group, "metric", F.col("e.estimate").alias("estimate"), F.col("e.std_error").alias("std_error"), F.greatest(F.lit(0.0), F.col("e.estimate") - 2 * F.col("e.std_error")).alias("low"), (F.col("e.estimate") + 2 * F.col("e.std_error")).alias("high"))


def solve(counts, buckets: int):
    """counts: an array (groups, BITS) of buckets in which each bit is set. Gives estimates and their standard errors."""
    s = counts.astype(np.float64)
    p = np.exp2(-np.minimum(np.arange(1, BITS + 1), BITS - 1)) / buckets  # the last place takes all further ranks
    log_n = np.log(np.maximum(s.sum(axis=1), 1.0))
    for _ in range(60):
        lam = np.exp(log_n)[:, None] * p
        full = lam / np.expm1(np.clip(lam, 1e-300, 700.0))  # lam * e^-lam / (1 - e^-lam)
        score = (s * full - (buckets - s) * lam).sum(axis=1)
        info = (buckets * lam * full).sum(axis=1)
        step = np.clip(score / np.maximum(info, 1e-300), -1.0, 1.0)
        log_n = log_n + step
        if np.abs(step).max(initial=0.0) < 1e-9:
            break
    lam = np.exp(log_n)[:, None] * p
    info = (buckets * lam * (lam / np.expm1(np.clip(lam, 1e-300, 700.0)))).sum(axis=1)
    n = np.exp(log_n)
    # 1 / (6 buckets): identifiers that met in bucket and rank, which small counts don't show
    return n, n * np.sqrt(np.maximum(1 / np.maximum(info, 1e-300) - 1 / n, 1 / (6 * buckets)))


def _solver(buckets: int):
    @F.pandas_udf("estimate double, std_error double")
    def run(words: pd.DataFrame) -> pd.DataFrame:
        w = words.to_numpy(dtype=np.int64)
        counts = np.stack([(w[:, k // LANES] >> (16 * (k % LANES))) & 0xFFFF for k in range(BITS)], axis=1)
        n, se = solve(counts, buckets)
        return pd.DataFrame({"estimate": n, "std_error": se})

    return run
