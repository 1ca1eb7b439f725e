"""Inner joins: equi, theta, band, cross, n-way, pre-aggregated, and joins in time windows. Output has the left columns, then the right ones; equal rows match as often as they stand there; nulls match nothing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.operators.slices import copied, place_among, salted, salts_of, slices_of
from rivulet.shared import shuffle_partitions


def equi_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str] | None = None, keep_right: bool = False, residual: Column | None = None) -> DataFrame:
    """On equal key columns; the right key columns are left out unless keep_right."""
    right_keys = right_keys or left_keys
    on = reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in zip(left_keys, right_keys)])
    if residual is not None:
        on = on & residual
    out = left.join(right, on)
    return out if keep_right else out.drop(*[right[b] for b in right_keys])


def skewed_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, slices: int | None = None) -> DataFrame:
    """An equi join whose left side has keys with more than one in ``slices`` of its rows (by default eight for each shuffle partition): each is spread over as many tasks as it fills slices, and only its right rows are repeated."""
    salts = salts_of(left, left[left_key], slices)
    l, r = salted(left, F.col(left_key), salts, "__s"), copied(right, F.col(right_key), salts, "__rs")
    return l.join(r, (l[left_key] == r[right_key]) & (F.col("__s") == F.col("__rs"))).drop("__s", "__rs")


def expression_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """On equal values of an expression of each side."""
    return left.withColumn("__k", left_key).join(right.withColumn("__k", right_key), "__k").drop("__k")


def theta_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """On any condition; equalities among its conjuncts are used for hashing."""
    return left.join(right, condition)


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair: for inputs whose product is the wanted result."""
    return left.crossJoin(right)


def band_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, d, closed: bool = True, on: Sequence[tuple[str, str]] = (), slices: int | None = None) -> DataFrame:
    """Pairs with |left_key - right_key| <= d (< d if not closed) of numbers, and equal further columns ``on``.

    A left row falls in one bucket of width d, a right row goes to three, and
    buckets are joined by hash; each pair meets once, no nested loop is run.
    A bucket with more than one in ``slices`` left rows (by default eight for
    each shuffle partition) is spread over as many tasks as it fills slices.
    """
    if d == 0:
        return left.join(right, reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in on], left_key == right_key)) if closed else left.join(right, F.lit(False))
    l = left.withColumn("__lk", left_key).withColumn("__b", F.floor(F.col("__lk") / d))
    r = right.withColumn("__rk", right_key).withColumn("__rb", F.floor(F.col("__rk") / d))
    r = r.withColumn("__rb", F.explode(F.array(F.col("__rb") - 1, F.col("__rb"), F.col("__rb") + 1)))
    at = lambda bucket, names: F.xxhash64(bucket, *names)  # noqa: E731 - one bucket of one value of the further columns
    salts = salts_of(l, at(F.col("__b"), [left[a] for a, _ in on]), slices)
    l = salted(l, at(F.col("__b"), [F.col(a) for a, _ in on]), salts, "__s")
    r = copied(r, at(F.col("__rb"), [F.col(b) for _, b in on]), salts, "__rs")
    same = reduce(lambda a, b: a & b, [l[a] == r[b] for a, b in on], (F.col("__b") == F.col("__rb")) & (F.col("__s") == F.col("__rs")))
    gap = F.abs(F.col("__lk") - F.col("__rk"))
    return l.join(r, same & (gap <= d if closed else gap < d)).drop("__lk", "__b", "__s", "__rk", "__rb", "__rs")


def _ranges(left: Column, right: Column, l: DataFrame, r: DataFrame) -> tuple[Column, list[int]]:
    """Cuts that part the values of both sides into ranges of about equal numbers of rows, one for each shuffle partition, and the steps to search them."""
    n = shuffle_partitions(l.sparkSession)
    both = l.select(left.alias("v")).unionAll(r.select(right.alias("v")))
    cuts = sorted(set(both.agg(F.percentile_approx("v", [k / n for k in range(1, n)], 10 * n)).first()[0] or [])) if n > 1 else []
    return F.array(*[F.lit(c) for c in cuts]), [2**k for k in range(max(len(cuts), 1).bit_length() - 1, -1, -1)]


def inequality_join(left: DataFrame, right: DataFrame, left_key: Column, op: str, right_key: Column) -> DataFrame:
    """Pairs with left_key < right_key (or <=, >, >=) and nothing else to join on, without a nested loop over all.

    Values are parted into ranges. A row of the side with more rows goes to its
    own range, a row of the other to its own and to those whose rows all match
    it, and ranges are joined by hash: only pairs within one range are compared
    in vain. Ranges are cut into pieces of about equal numbers of pairs, as
    few bytes can give many pairs; a piece has a million pairs or more.
    """
    ups = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    cuts, steps = _ranges(left_key, right_key, left, right)
    l = left.withColumn("__lk", left_key).where("__lk is not null").withColumn("__lb", place_among(cuts, F.col("__lk"), steps, below=True))
    r = right.withColumn("__rk", right_key).where("__rk is not null").withColumn("__rb", place_among(cuts, F.col("__rk"), steps, below=True))
    ln, rn = (dict(x.groupBy(b).count().collect()) for x, b in ((l, "__lb"), (r, "__rb")))  # a row for each range
    spread_left = sum(ln.values()) >= sum(rn.values())
    downward = (op[0] == "<") == spread_left  # the way a row of the other side goes from its own range
    own, other = (ln, rn) if spread_left else (rn, ln)
    ranges = range(max([*ln, *rn], default=0) + 1)
    pairs = [own.get(b, 0) * sum(n for k, n in other.items() if (k >= b if downward else k <= b)) for b in ranges]
    each = max(1_000_000, -(-sum(pairs) // slices_of(left.sparkSession)))
    pieces = [max(1, -(-n // each)) for n in pairs]
    first, number = F.array(*[F.lit(sum(pieces[:b])) for b in ranges]), F.array(*[F.lit(n) for n in pieces])

    def spread(df: DataFrame, b: str, name: str) -> DataFrame:
        hashed = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])
        return df.withColumn(name, (F.get(first, b) + F.pmod(hashed, F.get(number, b))).cast("int"))

    def repeated(df: DataFrame, b: str, name: str) -> DataFrame:
        end = F.get(first, b) + F.get(number, b) - 1
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), end) if downward else F.sequence(F.get(first, b), F.lit(sum(pieces) - 1))))

    l, r = (spread if spread_left else repeated)(l, "__lb", "__lp"), (repeated if spread_left else spread)(r, "__rb", "__rp")
    # with a number of its own a shuffle keeps its tasks: adaptive execution would merge them by their bytes
    l, r = l.repartition(sum(pieces), "__lp"), r.repartition(sum(pieces), "__rp")
    return l.join(r, (F.col("__lp") == F.col("__rp")) & ups[op](F.col("__lk"), F.col("__rk"))).drop("__lk", "__lb", "__lp", "__rk", "__rb", "__rp")


def inequality_count(left: DataFrame, right: DataFrame, left_key: Column, op: str, right_key: Column, name: str = "n") -> DataFrame:
    """The left rows with the number of right rows for which left_key op right_key (<, <=, >, >=), 0 too; a null key counts none.

    No pair is made: the right values are reduced to counts, parted into
    ranges, and summed within a range and over the ranges before.
    """
    cuts, steps = _ranges(left_key, right_key, left, right)
    values = right.select(right_key.alias("__v")).where("__v is not null").groupBy("__v").agg(F.count(F.lit(1)).alias("__n"))
    asked = left.select(left_key.alias("__v")).where("__v is not null").distinct().withColumn("__n", F.lit(0).cast("bigint"))
    marked = values.unionAll(asked).groupBy("__v").agg(F.sum("__n").alias("__n")).withColumn("__r", place_among(cuts, F.col("__v"), steps, below=True))
    sums = marked.groupBy("__r").agg(F.sum("__n").alias("__s"))  # a row for each range
    over = W.orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    before = F.broadcast(sums.select("__r", F.coalesce(F.sum("__s").over(over), F.lit(0)).alias("__before"), F.sum("__s").over(W.partitionBy()).alias("__all")))
    upto = F.sum("__n").over(W.partitionBy("__r").orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
    ranked = marked.withColumn("__upto", upto).join(before, "__r").withColumn("__upto", F.col("__upto") + F.col("__before"))
    n = {"<": F.col("__all") - F.col("__upto"), "<=": F.col("__all") - F.col("__upto") + F.col("__n"), ">": F.col("__upto") - F.col("__n"), ">=": F.col("__upto")}[op]
    return left.withColumn("__k", left_key).join(ranked.select(F.col("__v"), n.alias(name)), F.col("__k") == F.col("__v"), "left").withColumn(name, F.coalesce(name, F.lit(0))).drop("__k", "__v")


def days(d: Column) -> Column:
    """A date as a number, for bands in days."""
    return F.unix_date(d.cast("date"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def nway_join(relations: Mapping[str, DataFrame], predicates: Sequence[tuple[set[str], Column]]) -> DataFrame:
    """Joins all relations; a predicate names the relations it needs and refers to columns as "name.column".

    Relations are added one by one, always one that a predicate ties to those
    already joined while there is one, and each predicate is put where all its
    relations are first there. Columns come out in the order the relations were
    declared, named <relation>_<column>.
    """
    left = [*relations]
    waiting = [(set(names), p) for names, p in predicates]
    done = {left[0]}
    out = relations[left.pop(0)].alias(next(iter(relations)))
    while left:
        tied = [n for n in left if any(n in names and names <= done | {n} and len(names) > 1 for names, _ in waiting)]
        name = tied[0] if tied else left[0]
        left.remove(name)
        done.add(name)
        ready = [p for names, p in waiting if names <= done]
        waiting = [(names, p) for names, p in waiting if not names <= done]
        right = relations[name].alias(name)
        out = out.join(right, reduce(lambda a, b: a & b, ready)) if ready else out.crossJoin(right)
    if waiting:
        raise ValueError(f"predicates over unknown relations: {[n for n, _ in waiting]}")
    return out.select(*[F.col(f"{n}.`{c}`").alias(f"{n}_{c}") for n, df in relations.items() for c in df.columns])


def preaggregated_join(left: DataFrame, right: DataFrame, key: str, group: Sequence[str], name: str = "n") -> DataFrame:
    """Counts of the join by left columns ``group``: both sides are counted per key before they meet."""
    l = left.groupBy(key, *group).agg(F.count(F.lit(1)).alias("__l"))
    r = right.groupBy(key).agg(F.count(F.lit(1)).alias("__r"))
    return l.join(r, key).groupBy(*group).agg(F.sum(F.col("__l") * F.col("__r")).alias(name))


def sliding_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, seconds: float, on: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Pairs at most so many seconds apart, ends included."""
    return band_join(left, right, micros(left[left_ts]), micros(right[right_ts]), int(seconds * 1_000_000), on=on)


def tumbling_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, seconds: int, on: Sequence[tuple[str, str]] = (), origin: int = 0, end_included: bool = False) -> DataFrame:
    """Pairs in one window of so many seconds; end_included also takes a right row at the very end of the left row's window."""
    width = seconds * 1_000_000
    l = left.withColumn("__w", F.floor((micros(left[left_ts]) - origin) / width))
    at = micros(right[right_ts]) - origin
    window = F.floor(at / width)
    if end_included:
        r = right.withColumn("__rw", F.explode(F.when(at % width == 0, F.array(window, window - 1)).otherwise(F.array(window))))
    else:
        r = right.withColumn("__rw", window)
    same = reduce(lambda a, b: a & b, [l[a] == r[b] for a, b in on], F.col("__w") == F.col("__rw"))
    return l.join(r, same).drop("__w", "__rw")
