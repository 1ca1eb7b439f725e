"""Queries p1, p3, p4 and p6 with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.spellings import catalogue
from rivulet.operators import eager, history, quarantine, wide
from rivulet.shared import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    known = catalogue(table(spark, d, "attribute_types"))
    return wide.cells(wide.wide_table(table(spark, d, "machine_attributes"), known), known)


def p1_filled(spark: SparkSession, d: str) -> DataFrame:
    """How many attributes of each type every machine has."""
    known = catalogue(table(spark, d, "attribute_types"))
    w = wide.wide_table(table(spark, d, "machine_attributes"), known)
    count = lambda kind: sum((F.col(f"a{i}").isNotNull().cast("int") for i, _, t in known if t == kind), F.lit(0))
    return w.select("c1", *[count(k).cast("bigint").alias(f"n_{k}") for k in wide.SQL_TYPES])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.rejected(table(spark, d, "raw_records"), table(spark, d, "attribute_types")).select("rec_id", "reason").where("reason is not null")


def p3_loaded_orders(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.load(table(spark, d, "raw_records"), "orders", table(spark, d, "attribute_types")).drop("d").withColumn("totalprice", F.round("totalprice", 2))


def p3_loaded_lineitems(spark: SparkSession, d: str) -> DataFrame:
    loaded = quarantine.load(table(spark, d, "raw_records"), "lineitems", table(spark, d, "attribute_types")).drop("d")
    return loaded.withColumns({n: F.round(n, 2) for n, k in quarantine.FEEDS["lineitems"][1] if k == "double"})


def p3_loaded_machine_attributes(spark: SparkSession, d: str) -> DataFrame:
    """With c3 also typed, in the column of its attribute's type."""
    types = table(spark, d, "attribute_types")
    return quarantine.with_values(quarantine.load(table(spark, d, "raw_records"), "machine_attributes", types).drop("d"), types)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    kept = history.satellites(table(spark, d, "machine_attributes"), table(spark, d, "attribute_types"))
    return history.versions(kept["fast"]).unionByName(history.versions(kept["slow"])).select("c1", "attr_id", "valid_from", "valid_to")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return eager.heavy_keys(
        [
            ("tpch_orders", "custkey", table(spark, d, "tpch_orders")),
            ("tpch_lineitems", "orderkey", table(spark, d, "tpch_lineitems")),
            ("tpch_customer", "mktsegment", table(spark, d, "tpch_customer")),
        ]
    )


def p6_segment_orders(spark: SparkSession, d: str) -> DataFrame:
    """Rows and price of the join of all customer rows with all order rows, by market segment."""
    left = eager.compact(table(spark, d, "tpch_customer"), {"custkey": F.col("custkey")}, {"mktsegment": F.col("mktsegment")}, n="ln")
    right = eager.compact(table(spark, d, "tpch_orders"), {"custkey": F.col("custkey")}, sums={"price": F.col("totalprice").cast("decimal(18,2)")}, n="rn")
    return eager.join_states(left, right, ["custkey"], ["mktsegment"], right_sums=["price"]).select("mktsegment", "n", F.col("price").cast("double").alias("price"))


def p6_customer_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows and price of the join of all order rows with all line items, by customer."""
    left = eager.compact(table(spark, d, "tpch_orders"), {"orderkey": F.col("orderkey")}, {"custkey": F.col("custkey")}, n="ln")
    right = eager.compact(table(spark, d, "tpch_lineitems"), {"orderkey": F.col("orderkey")}, sums={"price": F.col("extendedprice").cast("decimal(18,2)")}, n="rn")
    return eager.join_states(left, right, ["orderkey"], ["custkey"], right_sums=["price"]).select("custkey", "n", F.col("price").cast("double").alias("price"))


QUERIES = {f.__name__: f for f in (p1_found, p1_filled, p3_found, p3_loaded_orders, p3_loaded_lineitems, p3_loaded_machine_attributes, p4_found, p6_found, p6_segment_orders, p6_customer_lines)}

_USABLE = r"""
cat as (
  select attr_id, rtrim(translate(trim(attr_name, E' \t\n\r"'''), '-_', '+/'), '=') as k, value_type from attribute_types
), said as (
  select c0, c1, arrival, coalesce(c4, 0) = 1 as deleted, rtrim(translate(trim(c2, E' \t\n\r"'''), '-_', '+/'), '=') as k,
    case when regexp_full_match(trim(c3, E' \t\n\r"'''), '[+-]?\d{1,3}(,\d{3})+(\.\d*)?') then replace(trim(c3, E' \t\n\r"'''), ',', '') else trim(c3, E' \t\n\r"''') end as v
  from machine_attributes where c0 is not null and c1 is not null
), valued as (
  select c0, c1, arrival, attr_id, value_type, deleted,
    case value_type
      when 'integer' then case when regexp_full_match(v, '[+-]?\d+(\.0*)?') then cast(cast(replace(regexp_replace(v, '\..*$', ''), '+', '') as hugeint) as varchar) end
      when 'real' then case when regexp_full_match(v, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?') then printf('%.3f', cast(replace(v, '+', '') as double)) end
      when 'boolean' then case when lower(v) in ('true', 't', 'yes', 'y', '1') then 'true' when lower(v) in ('false', 'f', 'no', 'n', '0') then 'false' end
      when 'hash' then case when regexp_full_match(rtrim(translate(v, '-_', '+/'), '='), '[A-Za-z0-9+/]{43}') then rtrim(translate(v, '-_', '+/'), '=') || '=' end
    end as val
  from said join cat using (k)
), usable as (
  select c0, c1, arrival, attr_id, value_type, case when not deleted then val end as val from valued where deleted or val is not null
)"""


def _fields_ok(feed: str) -> str:
    delim, fields = quarantine.FEEDS[feed]
    tests = []
    for i, (name, kind) in enumerate(fields, 1):
        x = f"f[{i}]"
        if name == "c3":
            tests.append(
                f"""({x} = '' or case t.value_type
  when 'integer' then regexp_full_match({x}, '[+-]?\\d+(\\.0*)?|[+-]?\\d{{1,3}}(,\\d{{3}})+(\\.0*)?')
  when 'real' then regexp_full_match({x}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d{{1,3}})?|[+-]?\\d{{1,3}}(,\\d{{3}})+(\\.\\d*)?')
  when 'boolean' then lower({x}) in ('true', 't', 'yes', 'y', '1', 'false', 'f', 'no', 'n', '0')
  when 'hash' then regexp_full_match(rtrim(translate({x}, '-_', '+/'), '='), '[A-Za-z0-9+/]{{43}}') else false end)"""
            )
        elif name == "c4":
            tests.append(f"{x} in ('0', '1')")
        elif kind == "bigint":
            tests.append(f"try_cast(case when regexp_full_match({x}, '[+-]?\\d+') then {x} end as bigint) is not null")
        elif kind == "double":
            tests.append(f"regexp_full_match({x}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)')")
        elif kind == "date":
            tests.append(f"regexp_full_match({x}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') and try_cast({x} as date) is not null")
        elif name not in quarantine.MAY_BE_EMPTY:
            tests.append(f"{x} <> ''")
    return " and ".join(f"coalesce({t}, false)" for t in tests)


def _raw_sql(feed: str) -> str:
    delim, fields = quarantine.FEEDS[feed]
    d = {",": ",", "|": r"\|"}[delim]
    n = len(fields)
    counted = f"len(f) = {n}" if delim == "," else f"len(f) = {n + 1} and f[{n + 1}] = ''"
    join = "left join attribute_types t on f[3] = t.attr_name" if delim == "," else ""
    return f"""select rec_id, f, case when not quoted then 'quoting' when not ({counted}) then 'column_count' when not ({_fields_ok(feed)}) then 'bad_value' end as reason from (
  select rec_id, regexp_full_match(line, '(?s)(?:"(?:[^"]|"")*"|[^"{delim}]*)(?:{d}(?:"(?:[^"]|"")*"|[^"{delim}]*))*') as quoted,
    list_transform(regexp_extract_all('{delim}' || line, '(?s){d}("(?:[^"]|"")*"|[^"{delim}]*)', 1), lambda x: case when x like '"%' then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) as f
  from raw_records where feed = '{feed}') r {join}"""


def _typed_sql(feed: str) -> str:
    def one(i: int, name: str, kind: str) -> str:
        x = f"cast(nullif(f[{i}], '') as {kind.replace('string', 'varchar')})"
        return f"{f'round({x}, 2)' if kind == 'double' else x} as {name}"

    return ", ".join(one(i, n, k) for i, (n, k) in enumerate(quarantine.FEEDS[feed][1], 1))



ORACLE = {
    "p1_found": f"""with {_USABLE}, last as (select *, row_number() over (partition by c1, attr_id order by c0 desc, arrival desc) as rn from usable)
select c1, attr_id, val as cell from last where rn = 1 and val is not null""",
    "p1_filled": f"""with {_USABLE}, last as (select *, row_number() over (partition by c1, attr_id order by c0 desc, arrival desc) as rn from usable)
select m.c1, coalesce(sum((value_type = 'integer')::int), 0)::bigint as n_integer, coalesce(sum((value_type = 'real')::int), 0)::bigint as n_real,
  coalesce(sum((value_type = 'boolean')::int), 0)::bigint as n_boolean, coalesce(sum((value_type = 'hash')::int), 0)::bigint as n_hash
from (select distinct c1 from machine_attributes where c0 is not null and c1 is not null) m left join (select * from last where rn = 1 and val is not null) l on m.c1 = l.c1 group by m.c1""",
    "p3_found": "select rec_id, reason from (" + " union all ".join(f"select rec_id, reason from ({_raw_sql(f)})" for f in quarantine.FEEDS) + ") where reason is not null",
    "p3_loaded_orders": "select rec_id, "
    + ", ".join(f"{'round(' if k == 'double' else ''}cast(nullif(f[{i}], '') as {k.replace('string', 'varchar')}){', 2)' if k == 'double' else ''} as {n}" for i, (n, k) in enumerate(quarantine.FEEDS["orders"][1], 1))
    + f" from ({_raw_sql('orders')}) where reason is null",
    "p3_loaded_lineitems": f"select rec_id, {_typed_sql('lineitems')} from ({_raw_sql('lineitems')}) where reason is null",
    "p3_loaded_machine_attributes": f"""select rec_id, {_typed_sql('machine_attributes')},
  case when value_type = 'integer' and f[4] <> '' then cast(regexp_replace(replace(replace(f[4], ',', ''), '+', ''), '\\..*$', '') as decimal(38,0)) end as c3_integer,
  case when value_type = 'real' and f[4] <> '' then cast(replace(replace(f[4], ',', ''), '+', '') as double) end as c3_real,
  case when value_type = 'boolean' and f[4] <> '' then lower(f[4]) in ('true', 't', 'yes', 'y', '1') end as c3_boolean,
  case when value_type = 'hash' and f[4] <> '' then rtrim(translate(f[4], '-_', '+/'), '=') || '=' end as c3_hash
from ({_raw_sql('machine_attributes')}) left join attribute_types on f[3] = attr_name where reason is null""",
    "p4_found": f"""with {_USABLE}, states as (
  select c1, attr_id, c0, arg_max(coalesce(val, ''), arrival) as val from usable group by c1, attr_id, c0
), changed as (
  select *, lag(val, 1, '') over (partition by c1, attr_id order by c0) as before from states
), ends as (
  select *, lead(c0) over (partition by c1, attr_id order by c0) as next from changed where val <> before
)
select c1, attr_id, c0 as valid_from, coalesce(next, -1)::bigint as valid_to from ends where val <> ''""",
    "p6_found": " union all ".join(
        f"select '{t}' as tab, '{f}' as field, {f}::varchar as heavy_key from {t} where {f} is not null group by {f} having count(*) * 20 >= (select count(*) from {t})"
        for t, f in (("tpch_orders", "custkey"), ("tpch_lineitems", "orderkey"), ("tpch_customer", "mktsegment"))
    ),
    "p6_segment_orders": "select mktsegment, count(*)::bigint as n, sum(totalprice::decimal(18,2))::double as price from tpch_customer join tpch_orders using (custkey) group by mktsegment",
    "p6_customer_lines": "select custkey, count(*)::bigint as n, sum(extendedprice::decimal(18,2))::double as price from tpch_orders join tpch_lineitems using (orderkey) group by custkey",
}
