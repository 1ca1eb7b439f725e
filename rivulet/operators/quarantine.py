"""Strict load of delimited text: valid rows typed, the others apart with the reason.

A row is loaded only if it conforms; the loaded records' offsets are subtracted
from the raw ones by an anti-join, and only the remainder is diagnosed. A record
is known by its rec_id (compared null-safe) and a 64-bit digest of its line and feed, so
a repeated or null rec_id loses nothing.

Quoting is judged by cutting the line at the double quotes: outside pieces have
even places, inside ones odd places, and an empty outside piece between two
inside ones is a doubled quote. No expression backtracks or recurses, so very
long lines and fields are safe.

Nulls: a null line counts as an empty one; a null or unknown feed has the reason
``unknown_feed``. Empty input gives empty tables. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.spellings import catalogue, let, value_text, with_type
from rivulet.operators.wide import SQL_TYPES
from rivulet.shared import staged

TEXT, KEY, NUMBER, DATE = "string", "bigint", "double", "date"
FEEDS = {
    "machine_attributes": (",", [("c0", KEY), ("c1", KEY), ("c2", TEXT), ("c3", TEXT), ("c4", "int")]),
    "orders": ("|", [("orderkey", KEY), ("custkey", KEY), ("orderstatus", TEXT), ("totalprice", NUMBER), ("orderdate", DATE), ("orderpriority", TEXT), ("clerk", TEXT), ("shippriority", KEY), ("comment", TEXT)]),
    "lineitems": ("|", [("orderkey", KEY), ("partkey", KEY), ("suppkey", KEY), ("linenumber", KEY), ("quantity", NUMBER), ("extendedprice", NUMBER), ("discount", NUMBER), ("tax", NUMBER), ("returnflag", TEXT), ("linestatus", TEXT), ("shipdate", DATE), ("commitdate", DATE), ("receiptdate", DATE), ("shipinstruct", TEXT), ("shipmode", TEXT), ("comment", TEXT)]),
}
MAY_BE_EMPTY = {"c3", "comment"}
PATTERNS = {KEY: r"^[+-]?\d+$", NUMBER: r"^[+-]?(\d+\.?\d*|\.\d+)$", DATE: r"^\d{4}-\d{2}-\d{2}$"}
HOLD = "\ue000"


def _delimiter() -> Column:
    return F.when(F.col("feed") == "machine_attributes", ",").otherwise("|")


def _cut(raw: DataFrame) -> DataFrame:
    """Adds d (digest), quoted (whether the quoting is right) and f (the fields, unquoted; null if the quoting is wrong)."""
    line, delim = F.coalesce(F.col("line"), F.lit("")), F.col("delim")

    def well_quoted(pieces: Column) -> Column:
        last = F.size(pieces) - 1

        def wrong(x: Column, i: Column) -> Column:
            starts = (i == 0) | (x == "") | F.startswith(x, delim)
            ends = (i == last) | (x == "") | F.endswith(x, delim)
            return (i % 2 == 0) & ~(starts & ends)

        return (F.size(pieces) % 2 == 1) & ~F.exists(F.transform(pieces, wrong), lambda w: w)

    def masked(x: Column, i: Column) -> Column:
        """Inside pieces hold back their delimiters while the line is split."""
        safe = F.replace(x, F.lit(HOLD), F.lit(HOLD + "0"))
        return F.when(i % 2 == 1, F.replace(safe, delim, F.lit(HOLD + "1"))).otherwise(safe)

    def plain(x: Column) -> Column:
        inner = F.when(F.startswith(x, F.lit('"')), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
        return F.replace(F.replace(inner, F.lit(HOLD + "1"), delim), F.lit(HOLD + "0"), F.lit(HOLD))

    def fields(pieces: Column) -> Column:
        whole = F.array_join(F.transform(pieces, masked), '"')
        return F.transform(F.when(delim == ",", F.split(whole, ",")).otherwise(F.split(whole, r"\|")), plain)

    # let keeps the pieces from being cut anew for every piece; inline keeps the fields from being cut anew for every test of them
    def judged(pieces: Column) -> Column:
        return let(F.struct(well_quoted(pieces).alias("quoted"), pieces.alias("pieces")), lambda s: F.struct(s["quoted"].alias("quoted"), F.when(s["quoted"], fields(s["pieces"])).alias("f")))

    return raw.select("rec_id", "feed", line.alias("line"), F.xxhash64(line, "feed").alias("d"), _delimiter().alias("delim")).select("*", F.inline(F.array(let(F.split("line", '"'), judged))))


def _counted(feed: str) -> Column:
    delim, fields = FEEDS[feed]
    if delim == ",":
        return F.size("f") == len(fields)
    return (F.size("f") == len(fields) + 1) & (F.element_at("f", -1) == "")


def _valued(feed: str) -> Column:
    ok = F.lit(True)
    for i, (name, kind) in enumerate(FEEDS[feed][1]):
        x = F.get("f", F.lit(i))
        if name == "c3":
            ok = ok & ((x == "") | value_text(F.col("value"), F.col("value_type")).isNotNull())
            continue
        if name == "c4":
            ok = ok & x.isin("0", "1")
        elif kind in PATTERNS:
            ok = ok & x.rlike(PATTERNS[kind]) & x.try_cast(kind).isNotNull()
        elif name not in MAY_BE_EMPTY:
            ok = ok & (x != "")
    return F.coalesce(ok, F.lit(False))


def _typed(cut: DataFrame, attributes: list[tuple[int, str, str]]) -> DataFrame:
    """Adds value (c3, where the feed has it) and value_type."""
    named = cut.withColumn("value", F.when(F.col("feed") == "machine_attributes", F.get("f", F.lit(3))))
    return with_type(named, F.when(F.col("feed") == "machine_attributes", F.get("f", F.lit(2))), attributes)


def _conforms(feed: str) -> Column:
    return F.col("quoted") & F.coalesce(_counted(feed), F.lit(False)) & _valued(feed)


def load(raw: DataFrame, feed: str, attribute_types: DataFrame | list) -> DataFrame:
    """The conforming rows of one feed, typed, with the record's offset (rec_id, d) and the feed's columns."""
    cut = _typed(_cut(raw.where(F.col("feed") == feed)), catalogue(attribute_types))
    cols = [F.nullif(F.get("f", F.lit(i)), F.lit("")).try_cast(kind).alias(name) for i, (name, kind) in enumerate(FEEDS[feed][1])]
    return cut.where(_conforms(feed)).select("rec_id", "d", *cols)


def with_values(loaded: DataFrame, attribute_types: DataFrame | list) -> DataFrame:
    """Rows of machine_attributes with c3 in a column of its attribute's type, c3_integer, c3_real, c3_boolean or c3_hash; an empty c3 is in none."""
    typed = with_type(loaded, F.col("c2"), catalogue(attribute_types)).withColumn("__value", value_text(F.col("c3"), F.col("value_type")))
    return typed.select(*loaded.columns, *[F.when(F.col("value_type") == k, F.col("__value").try_cast(t)).alias(f"c3_{k}") for k, t in SQL_TYPES.items()])


def rejected(raw: DataFrame, attribute_types: DataFrame | list) -> DataFrame:
    """(rec_id, reason, feed, line) of the records that weren't loaded.

    The raw text is read and cut once: the offsets of all records are written
    with the mark of those that a load would take, and with the line of the
    others. The marked offsets are subtracted from all; what remains is diagnosed.
    """
    attributes = catalogue(attribute_types)
    conforms = F.lit(False)
    for feed in FEEDS:
        conforms = F.when(F.col("feed") == feed, _conforms(feed)).otherwise(conforms)
    # inline keeps the judgement from being made anew for the mark and for the line
    judged = _typed(_cut(raw), attributes).select("rec_id", "d", "feed", "line", F.inline(F.array(F.struct(conforms.alias("loaded")))))
    offsets = staged(judged.select("rec_id", "d", "loaded", F.when(~F.col("loaded"), F.col("feed")).alias("feed"), F.when(~F.col("loaded"), F.col("line")).alias("line")), "offsets")
    loaded = offsets.where("loaded").select(F.col("rec_id").alias("__rec_id"), F.col("d").alias("__d"))
    rest = offsets.join(loaded, F.col("rec_id").eqNullSafe(F.col("__rec_id")) & (F.col("d") == F.col("__d")), "left_anti")
    reason = F.when(~F.coalesce(F.col("feed").isin(*FEEDS), F.lit(False)), "unknown_feed").when(~F.col("quoted"), "quoting")
    for feed in FEEDS:
        reason = reason.when((F.col("feed") == feed) & ~_counted(feed), "column_count")
    for feed in FEEDS:
        reason = reason.when((F.col("feed") == feed) & ~_valued(feed), "bad_value")
    return _typed(_cut(rest.select("rec_id", "feed", "line")), attributes).select("rec_id", reason.alias("reason"), "feed", "line")
