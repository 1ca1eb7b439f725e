"""Attribute-value rows into one typed row per entity.

Rows are reduced to the deciding one per entity and attribute (combined before
the shuffle, so a busy entity is no one task's work) and written once as narrow
tables: partitioned by blocks of attributes of one type, bucketed by entity. The
narrow tables of a block are merged into its typed columns bucket by bucket, and
the blocks meet in a balanced tree of outer joins. As all are bucketed alike,
nothing is shuffled after the write. Each branch of the tree begins with a spine
of all entities, so LEFT joins are enough: they keep the partitioning by
entity, whereas a FULL one loses it.

Nulls: a row without entity or moment is ignored; a null value is no value; a
null deletion mark is no deletion. Repeated rows decide nothing twice. An
entity without any usable row keeps a row of nulls. Empty input gives no rows.
Extra columns, also of clashing names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.spellings import catalogue, value_text, with_type
from rivulet.shared import bucketed, partitions_for

SQL_TYPES = {"integer": "decimal(38,0)", "real": "double", "boolean": "boolean", "hash": "string"}


def statements(rows: DataFrame, attributes: list[tuple[int, str, str]]) -> DataFrame:
    """(c1, c0, arrival, attr_id, deleted, val); attr_id is null for a row that can't be used, val is spelled in the one way."""
    deleted = F.coalesce(F.col("c4"), F.lit(0)) == 1
    kept = rows.select("c0", "c1", "arrival", "c2", "c3", deleted.alias("deleted")).where("c0 is not null and c1 is not null")
    typed = with_type(kept, F.col("c2"), attributes).withColumnRenamed("attr_id", "named")
    # inline keeps a later filter on attr_id from being pushed down, which would judge every value twice
    val = F.when(~F.col("deleted"), value_text(F.col("c3"), F.col("value_type")))
    return typed.select("c0", "c1", "arrival", "deleted", F.inline(F.array(F.struct("named", val.alias("val"))))).select(
        "c0", "c1", "arrival", "deleted", F.when(F.col("deleted") | F.col("val").isNotNull(), F.col("named")).alias("attr_id"), "val"
    )


def narrow_tables(rows: DataFrame, attributes: list[tuple[int, str, str]], block: dict[int, int]) -> DataFrame:
    """The deciding statement of each entity and attribute, as a table partitioned by the attributes' blocks and bucketed by entity; block null lists further entities."""
    latest = (
        statements(rows, attributes)
        .groupBy("c1", "attr_id")
        .agg(F.max(F.struct("c0", "arrival", "deleted", "val")).alias("s"))
        .select("c1", "attr_id", F.when(F.col("attr_id").isNotNull() & ~F.col("s.deleted"), F.col("s.val")).alias("val"))
    )
    of = F.try_element_at(F.create_map(*[F.lit(x) for kv in block.items() for x in kv]), "attr_id") if block else F.lit(None)
    placed = latest.withColumn("block", F.when(F.col("val").isNotNull(), of).cast("int"))
    return bucketed(placed, "narrow", "c1", partitions_for(rows), ("block",))


def _tree(spine: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Every branch begins with the spine, so that no entity is lost."""
    if len(parts) > 4:
        half = len(parts) // 2
        parts, spine = [_tree(spine, parts[half:])], _tree(spine, parts[:half])
    for one in parts:
        # a bucket has one row an entity, so hash tables of a bucket are small and even
        spine = spine.join(one.hint("shuffle_hash"), "c1", "left")
    return spine


def wide_table(rows: DataFrame, attribute_types: DataFrame | list, fan_in: int = 8) -> DataFrame:
    """One row per machine c1; column a<attr_id> of the attribute's type. fan_in: attributes of one type in a block, more where there are over 64 blocks."""
    attributes = catalogue(attribute_types)
    fan_in = max(fan_in, -(-len(attributes) // 64))
    blocks: list[list[tuple[int, str, str]]] = []
    for kind in sorted({t for _, _, t in attributes}):
        alike = [a for a in attributes if a[2] == kind]
        blocks += [alike[k : k + fan_in] for k in range(0, len(alike), fan_in)]
    narrow = narrow_tables(rows, attributes, {i: k for k, some in enumerate(blocks) for i, _, _ in some})

    def merged(k: int) -> DataFrame:
        typed = [F.max(F.when(F.col("attr_id") == i, F.col("val")).cast(SQL_TYPES.get(t, "string"))).alias(f"a{i}") for i, _, t in blocks[k]]
        return narrow.where(F.col("block") == k).groupBy("c1").agg(*typed)

    wide = _tree(narrow.select("c1").distinct(), [merged(k) for k in range(len(blocks))])
    return wide.select("c1", *[f"a{i}" for i, _, _ in attributes])


def cell_text(c: Column, value_type: str) -> Column:
    if value_type == "real":
        return F.coalesce(c.try_cast("decimal(38,3)").cast("string"), F.format_string("%.3f", c))
    return c.cast("string")


def cells(wide: DataFrame, attributes: list[tuple[int, str, str]]) -> DataFrame:
    """(c1, attr_id, cell) of the non-empty cells."""
    if not attributes:
        return wide.select("c1", F.lit(None).cast("int").alias("attr_id"), F.lit(None).cast("string").alias("cell")).where("false")
    pairs = F.array(*[F.struct(F.lit(i).alias("attr_id"), F.when(F.col(f"a{i}").isNotNull(), cell_text(F.col(f"a{i}"), t)).alias("cell")) for i, _, t in attributes])
    return wide.select("c1", F.explode(pairs).alias("p")).select("c1", "p.attr_id", "p.cell").where("cell is not null")
