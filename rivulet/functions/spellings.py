"""Values written in more than one way, brought to one spelling. All are JVM expressions; a text that denotes nothing gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YES = ("true", "t", "yes", "y", "1")
NO = ("false", "f", "no", "n", "0")


def bare(c: Column) -> Column:
    """Without the blanks and quotes around."""
    return F.regexp_replace(c, r"^[\s\x{a0}\"']+|[\s\x{a0}\"']+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once, however often it is named: keeps generated code small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_text(c: Column) -> Column:
    """32 bytes as 44 characters of padded standard base64, from padded, unpadded, URL-safe base64 or hexadecimal digits."""
    # most values have the one spelling already: 256 bits leave two bits of the last character empty
    return F.when(c.rlike(r"^[A-Za-z0-9+/]{42}[AEIMQUYcgkosw048]=$"), c).otherwise(_hash_text(c))


def _hash_text(c: Column) -> Column:
    return let(
        F.translate(F.rtrim(bare(c), F.lit("=")), "-_", "+/"),
        lambda s: F.when(s.rlike(r"^[A-Za-z0-9+/]{43}$"), F.base64(F.unbase64(F.concat(s, F.lit("="))))).when(s.rlike(r"^(0[xX])?[0-9A-Fa-f]{64}$"), F.base64(F.unhex(F.right(s, F.lit(64))))),
    )


def number_text(c: Column) -> Column:
    """Digits with sign, point and exponent as BigDecimal reads them; thousands separators are taken out."""
    return let(
        let(F.translate(bare(c), "−", "-"), lambda s: F.when(s.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d*)?$"), F.translate(s, ",", "")).otherwise(s)),
        lambda s: F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?$"), s),
    )


def integer_text(c: Column) -> Column:
    """Whole numbers of up to 38 digits; 21.0 and 57. are whole, 3.7 is not."""

    def whole(s: Column) -> Column:
        plain = F.regexp_replace(s, r"\..*$", "").try_cast("decimal(38,0)")
        power = let(s.try_cast("decimal(38,9)"), lambda x: F.when(x == F.floor(x), x.try_cast("decimal(38,0)")))
        return F.when(s.rlike(r"^[+-]?\d+(\.0*)?$"), plain).when(s.rlike("[eE]"), power).cast("string")

    return F.when(c.rlike(r"^(0|[1-9]\d{0,17})$"), c).otherwise(let(number_text(c), whole))


def real_text(c: Column) -> Column:
    plain = F.when(c.rlike(r"^\d{1,9}\.\d{1,9}$"), c).otherwise(number_text(c))
    return (plain.try_cast("double") + F.lit(0.0)).cast("string")


def boolean_text(c: Column) -> Column:
    return F.when(c.isin("true", "false"), c).otherwise(let(F.lower(bare(c)), lambda s: F.when(s.isin(*YES), "true").when(s.isin(*NO), "false")))


def value_text(c: Column, value_type: Column) -> Column:
    """The one spelling of a value of the given type (integer, real, boolean or hash), null if it denotes none. Both are named several times: they should be plain columns."""
    return F.when(value_type == "integer", integer_text(c)).when(value_type == "real", real_text(c)).when(value_type == "boolean", boolean_text(c)).when(value_type == "hash", hash_text(c))


def catalogue(attribute_types: DataFrame | list, limit: int = 20_000) -> list[tuple[int, str, str]]:
    """(attr_id, name in its one spelling, type) of a catalogue, each name once, with the least attr_id. Its rows become columns, so more than ``limit`` is an error."""
    if isinstance(attribute_types, list):
        return attribute_types
    rows = (
        attribute_types.select(F.col("attr_id").alias("i"), hash_text(F.col("attr_name")).alias("n"), F.col("value_type").alias("t"))
        .where("i is not null and n is not null and t is not null")
        .limit(limit + 1)
        .collect()
    )
    if len(rows) > limit:
        raise ValueError(f"a catalogue of more than {limit} attributes can't become columns")
    first: dict[str, tuple[int, str]] = {}
    for i, n, t in rows:
        first[n] = min(first.get(n, (i, t)), (i, t))
    return sorted((i, n, t) for n, (i, t) in first.items())


def with_type(df: DataFrame, name: Column, attributes: list[tuple[int, str, str]]) -> DataFrame:
    """Adds attr_id and value_type of the attribute that ``name`` denotes, null for none. The catalogue, bounded by its limit, is broadcast; only names that aren't in their one spelling are spelled anew."""
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({quoted(n)}, {i}, {quoted(t)})" for i, n, t in attributes) or "(null, null, null)"
    known = df.sparkSession.sql(f"SELECT CAST(n AS STRING) n, CAST(i AS INT) i, CAST(t AS STRING) t FROM VALUES {values} AS v(n, i, t)")
    one = F.broadcast(known.select(F.col("n").alias("__n1"), F.col("i").alias("__i1"), F.col("t").alias("__t1")))
    two = F.broadcast(known.select(F.col("n").alias("__n2"), F.col("i").alias("__i2"), F.col("t").alias("__t2")))
    named = df.withColumn("__name", name).join(one, F.col("__name") == F.col("__n1"), "left").join(two, F.when(F.col("__i1").isNull(), hash_text(F.col("__name"))) == F.col("__n2"), "left")
    return named.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("__i1", "__i2").alias("attr_id"), F.coalesce("__t1", "__t2").alias("value_type"))
