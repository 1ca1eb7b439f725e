"""Histories of entity attributes, as insert-only satellites with lead-based views.

A satellite row is appended only where the hash-diff of an attribute's value
changes; nothing is ever updated, and the end of a version is the beginning of
the next satellite row, computed in a view. Satellites are kept apart by change
rate: the table is partitioned by attribute and each satellite is a set of its
partitions, so fast ones don't rewrite or slow down the slow ones.

An entity may hold a large share of all rows. Every entity with more rows than
one in ``slices`` of the log (by default eight for each shuffle partition) is
cut at quantiles of its own moments into slices of about so many rows; a window
covers one entity, attribute and slice. The first row of a slice is kept until
it is compared with the last of the slices before. There are fewer such
entities than ``slices``, and fewer cuts than four times as many, so these are
broadcast. Rows reach their window by one shuffle, on attribute and a salt of
entity and slice; an attribute has as many salts as the log has rows of it over
rows a slice, so tasks are even and the files of the table no more than salts.

The hash-diff is 64 bits wide; only neighbouring states of one attribute are
ever compared by it.

Nulls: rows without entity or moment are ignored, a null value is no value.
Rows received twice and the same value stated again change nothing; of several
rows of one moment the last received counts. Rows of one moment aren't cut
apart. Empty input gives no versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.functions.spellings import catalogue, with_type
from rivulet.operators.slices import Slices, slices_of
from rivulet.operators.wide import statements
from rivulet.shared import staged

KEY = ("c1", "attr_id")
Catalogue = list[tuple[int, str, str]]


def _salts(rows: DataFrame, attributes: Catalogue, rows_each: int) -> Column:
    """As many salts for each attribute as its rows fill tasks."""
    counted = with_type(rows.groupBy("c2").count(), F.col("c2"), attributes).where("attr_id is not null").groupBy("attr_id").agg(F.sum("count"))
    known = [F.lit(x) for i, n in counted.collect() for x in (i, max(1, -(-n // rows_each)))]  # one row an attribute of the catalogue
    return F.coalesce(F.try_element_at(F.create_map(*known), F.col("attr_id")), F.lit(1)) if known else F.lit(1)


def _candidates(rows: DataFrame, attributes: Catalogue, slices: int | None) -> tuple[DataFrame, bool]:
    """Satellite rows, and ``opens`` for the first of each slice, which may repeat the state before; whether there are slices."""
    cut = Slices(rows, slices or slices_of(rows.sparkSession))
    stated = cut.added(statements(rows, attributes).where("attr_id is not null")).withColumn("__salt", F.pmod(F.xxhash64("c1", "slice"), _salts(rows, attributes, cut.rows)))
    group = W.partitionBy("attr_id", "__salt", "c1", "slice").orderBy("c0", "arrival")
    last = (
        stated.repartition("attr_id", "__salt")
        .withColumn("__next", F.lead("c0").over(group))
        .where("__next is null or __next <> c0")
        .withColumn("hash_diff", F.when(F.col("val").isNotNull(), F.xxhash64("val")))
    )
    seen = last.withColumn("opens", F.row_number().over(group) == 1).withColumn("__before", F.lag("hash_diff").over(group))
    # a first row that deletes is kept too while slices may precede it
    kept = ~F.col("hash_diff").eqNullSafe(F.col("__before")) if cut.cuts is None else F.col("opens") | ~F.col("hash_diff").eqNullSafe(F.col("__before"))
    return seen.where(kept).select("c1", F.col("c0").alias("valid_from"), "slice", "val", "hash_diff", "opens", "attr_id"), cut.cuts is not None


def _settled(candidates: DataFrame, sliced: bool) -> DataFrame:
    """Without the first rows of slices that repeat the state before."""
    if not sliced:
        return candidates.drop("opens")
    cut = candidates.join(F.broadcast(candidates.where("slice > 0").select("c1").distinct()), "c1", "left_semi")  # entities that are cut, fewer than slices
    ends = cut.groupBy(*KEY, "slice").agg(F.max(F.struct("valid_from", "hash_diff")).alias("end"))
    carried = ends.select(*KEY, "slice", F.lag("end.hash_diff").over(W.partitionBy(*KEY).orderBy("slice")).alias("carried")).where("carried is not null")
    joined = candidates.join(carried, [*KEY, "slice"], "left")
    return joined.where(~(F.col("opens") & F.col("hash_diff").eqNullSafe(F.col("carried")))).select("c1", "valid_from", "slice", "val", "hash_diff", "attr_id")


def changes(rows: DataFrame, attribute_types: DataFrame | Catalogue, slices: int | None = None) -> DataFrame:
    """Satellite rows (c1, valid_from, slice, val, hash_diff, attr_id): one for each change of an attribute, hash_diff null for a deletion."""
    candidates, sliced = _candidates(rows, catalogue(attribute_types), slices)
    return _settled(staged(candidates, "candidates") if sliced else candidates, sliced)


def satellites(rows: DataFrame, attribute_types: DataFrame | Catalogue, fast_rate: float = 4.0, slices: int | None = None) -> dict[str, DataFrame]:
    """The satellites ``fast`` and ``slow``; fast ones hold the attributes of more than fast_rate changes an entity."""
    candidates, sliced = _candidates(rows, catalogue(attribute_types), slices)
    table = staged(candidates, "satellite", ("attr_id",))
    rates = table.groupBy("attr_id").agg((F.count("*") / F.approx_count_distinct("c1")).alias("rate"))
    fast = [r[0] for r in rates.where(F.col("rate") > fast_rate).select("attr_id").collect()]  # a part of the catalogue
    return {name: _settled(table.where(kept), sliced) for name, kept in (("fast", F.col("attr_id").isin(fast)), ("slow", ~F.col("attr_id").isin(fast)))}


def versions(satellite: DataFrame) -> DataFrame:
    """The view (c1, attr_id, val, valid_from, valid_to): valid_to is the next row's valid_from, -1 if there is none; deletions have no row."""
    within = W.partitionBy(*KEY, "slice").orderBy("valid_from")
    inside = satellite.select("*", F.lead("valid_from").over(within).alias("next"))
    cut = F.broadcast(satellite.where("slice > 0").select("c1").distinct())  # fewer entities than there are slices
    starts = satellite.join(cut, "c1", "left_semi").groupBy(*KEY, "slice").agg(F.min("valid_from").alias("start"))
    carried = starts.select(*KEY, "slice", F.lead("start").over(W.partitionBy(*KEY).orderBy("slice")).alias("carried")).where("carried is not null")
    return (
        inside.where("hash_diff is not null")
        .join(carried, [*KEY, "slice"], "left")
        .select("c1", "attr_id", "val", "valid_from", F.coalesce("next", "carried", F.lit(-1)).cast("bigint").alias("valid_to"))
    )


def appended(satellite: DataFrame, batch: DataFrame, attribute_types: DataFrame) -> DataFrame:
    """The rows a later load adds: where the batch's first statement of an attribute differs from the satellite's last state, and every change after it.

    The batch must begin after the satellite's last moment of each attribute it
    touches; late rows call for the satellite of that attribute to be built anew
    from the log, since a state that was not appended can't be told from none.
    """
    last = satellite.groupBy(*KEY).agg(F.max(F.struct("valid_from", "hash_diff")).alias("last"), F.max("slice").alias("reached")).select(*KEY, F.col("last.hash_diff").alias("held"), "reached")
    new = changes(batch, attribute_types)
    # a batch that opens with a deletion adds a row only if a value is in force, so deletions are put back before comparing
    opening = (
        statements(batch, catalogue(attribute_types)).where("attr_id is not null").groupBy(*KEY).agg(F.min(F.struct("c0", F.negate("arrival").alias("a"), "deleted")).alias("o"))
        .where("o.deleted").select(*KEY, F.col("o.c0").alias("valid_from"))
    )
    gone = opening.join(last.where("held is not null"), list(KEY), "left_semi").join(last, list(KEY)).select("c1", "valid_from", F.col("reached").alias("slice"), F.lit(None).cast("string").alias("val"), F.lit(None).cast("bigint").alias("hash_diff"), "attr_id")
    first = W.partitionBy(*KEY).orderBy("valid_from")
    fresh = new.withColumn("rn", F.row_number().over(first)).join(last, list(KEY), "left").join(opening.select(*KEY, F.lit(True).alias("reopened")), list(KEY), "left")
    return fresh.where((F.col("rn") > 1) | F.col("reopened").isNotNull() | ~F.col("hash_diff").eqNullSafe(F.col("held"))).select("c1", "valid_from", (F.col("slice") + F.coalesce("reached", F.lit(0))).alias("slice"), "val", "hash_diff", "attr_id").unionByName(gone)
