"""Queries p2, p5, p7, p8, p9 and p10, with the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm import distinct, leaks, packing, percentiles, topn
from rivulet.llm import sentences as sentence_split
from rivulet.shared import table

GROUP = ["shipdate", "returnflag", "linestatus", "shipmode"]
CAPACITY = 2048  # tokens
SHARES = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def _line_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of orders and customers by day and group. The customer of an order is that of its latest load."""
    lines = table(spark, d, "tpch_lineitems").select("orderkey", *GROUP)  # a sketch ignores what comes again, so nothing is made distinct
    groups = {g: F.col(g) for g in GROUP}
    orders = topn.latest(table(spark, d, "tpch_orders"), "orderkey", "custkey").where("custkey is not null")
    return distinct.sketch(lines, groups, {"orders": F.col("orderkey")}).unionByName(distinct.sketch(lines.join(orders, "orderkey"), groups, {"customers": F.col("custkey")}))


def p2_distinct_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Distinct orders and customers of each shipdate and combination of returnflag, linestatus and shipmode."""
    return distinct.estimates(_line_sketches(spark, d), GROUP)


def p2_distinct_merged(spark: SparkSession, d: str) -> DataFrame:
    """The daily sketches added together to months, for each returnflag, linestatus and both."""
    months = _line_sketches(spark, d).withColumn("month", F.date_trunc("month", "shipdate").cast("date"))
    by_both = distinct.merge(months, ["month", "returnflag", "linestatus"])
    levels = [by_both]
    for rest in (["returnflag"], ["linestatus"], []):
        level = distinct.merge(by_both, ["month", *rest])
        levels.append(level.select("month", *[F.col(g) if g in rest else F.lit("all").alias(g) for g in ("returnflag", "linestatus")], "metric", "bucket", "bits"))
    total = levels[0]
    for level in levels[1:]:
        total = total.unionByName(level)
    return distinct.estimates(total, ["month", "returnflag", "linestatus"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    customers = topn.latest(table(spark, d, "tpch_customer"), "custkey", "nationkey", "acctbal")
    orders = topn.latest(table(spark, d, "tpch_orders"), "orderkey", "custkey", "totalprice")
    scored = customers.select(F.lit("nation").alias("grp_kind"), F.col("nationkey").alias("grp"), topn.amount(F.col("acctbal")).alias("score"), F.col("custkey").alias("item")).unionByName(
        orders.select(F.lit("customer").alias("grp_kind"), F.col("custkey").alias("grp"), (F.col("totalprice") + F.lit(0.0)).alias("score"), F.col("orderkey").alias("item"))
    )
    n = F.when(F.col("grp_kind") == "nation", 10).otherwise(3)
    return topn.top_n(scored.where("grp is not null and not isnan(score)"), ["grp_kind", "grp"], "score", "item", n, most=10).select("grp_kind", "grp", "rnk", "item")


def p7_percentiles_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Of each day's partial result by itself."""
    group = ["shipdate", "returnflag", "linestatus"]
    return percentiles.percentiles(percentiles.frequencies(table(spark, d, "tpch_lineitems"), group, "extendedprice"), group, SHARES)


def p7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    state = percentiles.frequencies(table(spark, d, "tpch_lineitems"), ["returnflag", "linestatus"], "extendedprice")
    return percentiles.percentiles(state, ["returnflag", "linestatus"], SHARES)


def p7_merged_loads(spark: SparkSession, d: str) -> DataFrame:
    """The same from the partial results of two halves of the loads."""
    lines = table(spark, d, "tpch_lineitems").withColumn("half", F.coalesce(F.year("loaded_at") % 2, F.lit(0)))
    group = ["returnflag", "linestatus"]
    states = [percentiles.frequencies(lines.where(F.col("half") == k), group, "extendedprice") for k in (0, 1)]
    return percentiles.percentiles(percentiles.merged(states, group), group, SHARES)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", packing.token_count(F.col("text")).alias("n_tokens"))
    return packing.pack(docs, CAPACITY)


def p8_pack_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every text in containers of CAPACITY tokens."""
    return _packed(spark, d)


def p8_container_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers by how full they are, in percent."""
    fills = _packed(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("fill"), F.count("*").alias("pieces"))
    return fills.groupBy(F.floor(F.col("fill") * 100 / CAPACITY).alias("percent")).agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("fill").alias("n_tokens"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked stretch of each item in each document, with its place."""
    return leaks.passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_removals(spark: SparkSession, d: str) -> DataFrame:
    return leaks.removals(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_split.sentence_units(table(spark, d, "documents"))


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The units with their text."""
    return sentence_split.sentences(table(spark, d, "documents"))


# Checks that SQL can state: the operator's result against exact counts, or what must hold for it.


def p2_within_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts by returnflag and linestatus, and whether the merged sketches' estimates lie within five standard errors."""
    by = ["returnflag", "linestatus"]
    estimates = distinct.estimates(distinct.merge(_line_sketches(spark, d), by), by).select(*[F.col(g).alias(f"e_{g}") for g in by], "metric", "estimate", "std_error")
    orders = topn.latest(table(spark, d, "tpch_orders"), "orderkey", "custkey")
    exact = table(spark, d, "tpch_lineitems").select("orderkey", *by).join(orders, "orderkey", "left").groupBy(*by).agg(F.count_distinct("orderkey").alias("orders"), F.count_distinct("custkey").alias("customers"))
    counted = exact.select(*by, F.explode(F.create_map(F.lit("orders"), F.col("orders"), F.lit("customers"), F.col("customers"))).alias("m", "n")).where("n > 0")
    same = (F.col("m") == F.col("metric")) & F.col("returnflag").eqNullSafe(F.col("e_returnflag")) & F.col("linestatus").eqNullSafe(F.col("e_linestatus"))
    return counted.join(estimates, same, "left").select(*by, F.col("m").alias("metric"), "n", F.coalesce(F.abs(F.col("estimate") - F.col("n")) <= 5 * F.col("std_error"), F.lit(False)).alias("near"))


def p8_texts_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of each document, whether its tokens are all there, no container it is in is overfull, and only a text longer than a container is split."""
    packed = _packed(spark, d).withColumn("fill", F.sum("n_tokens").over(Window.partitionBy("container")))
    placed = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("pieces"), F.max("fill").alias("fill"), F.count_if(F.col("n_tokens") == CAPACITY).alias("full"))
    sizes = table(spark, d, "documents").where("text is not null").select("doc_id", packing.token_count(F.col("text")).alias("size"))
    held = lambda c: F.coalesce(c, F.lit(False))
    return sizes.join(placed, "doc_id", "left").select(
        "doc_id", held(F.col("placed") == F.col("size")).alias("complete"), held(F.col("fill") <= CAPACITY).alias("fits"), held((F.col("pieces") == 1) | (F.col("size") > CAPACITY) & (F.col("pieces") - F.col("full") <= 1)).alias("whole")
    )


def p9_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """The leaks found that have twelve words of an item as they are but for case and punctuation; SQL finds those by itself."""
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")

    def runs(text: str):
        words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}]+)"))
        return F.transform(F.sequence(F.lit(1), F.size(words) - 11), lambda i: F.array_join(F.slice(words, i, 12), " "))

    enough = lambda text: F.size(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}]+)"))) >= 12
    found = leaks.leaks(docs, items).join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", "item_text"), "item_id").where(enough("text") & enough("item_text"))
    return found.where(F.arrays_overlap(runs("text"), runs("item_text"))).select("doc_id", "item_id")


def p10_covering(spark: SparkSession, d: str) -> DataFrame:
    """Of each text: the characters in its units that aren't blanks (so none is left out), units that cross a line break, and units that overlap the one before."""
    units = sentence_split.sentence_units(table(spark, d, "documents"), keep=("doc_id", "text"))
    unit = F.substring("text", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))
    judged = units.select("doc_id", F.length(F.translate(unit, sentence_split.BLANKS, "")).alias("covered"), F.contains(unit, F.lit("\n")).alias("crosses"), (F.lag("end_pos").over(Window.partitionBy("doc_id").orderBy("start_pos")) > F.col("start_pos")).alias("overlaps"))
    return judged.groupBy("doc_id").agg(F.sum("covered").cast("bigint").alias("covered"), F.count_if("crosses").alias("crossing"), F.count_if("overlaps").alias("overlapping"))


QUERIES = {f.__name__: f for f in (p2_distinct_by_day, p2_distinct_merged, p5_found, p7_percentiles_by_day, p7_percentiles, p7_merged_loads, p8_pack_documents, p8_container_fill, p9_found, p9_passages, p9_removals, p10_found, p10_sentences, p2_within_bounds, p8_texts_whole, p9_verbatim, p10_covering)}

_P7 = (
    "with v as (select GROUP, extendedprice + 0.0 as value, row_number() over (partition by GROUP order by extendedprice) as rn, count(*) over (partition by GROUP) as n "
    "from tpch_lineitems where extendedprice is not null), s as (select unnest([" + ", ".join(f"{p}::double" for p in SHARES) + "]) as share) "
    "select GROUP, share, value, n from v, s where rn = greatest(1, ceil(share * n))"
)
_BLANKS = "".join(f"' || chr({ord(c)}) || '" for c in sentence_split.BLANKS)
_RUNS = "select ID, unnest([array_to_string(w[i:i + 11], ' ') for i in range(1, len(w) - 10)]) as run from (select ID, regexp_extract_all(lower(TEXT), '[\\p{L}\\p{M}\\p{N}]+') as w from TABLE where TEXT is not null)"
ORACLE = {
    "p2_within_bounds": """with o as (select orderkey, arg_max(coalesce(custkey, -1), loaded_at) as custkey from tpch_orders where orderkey is not null group by 1),
  l as (select returnflag, linestatus, l.orderkey, nullif(custkey, -1) as custkey from tpch_lineitems l left join o on l.orderkey = o.orderkey),
  n as (select returnflag, linestatus, count(distinct orderkey) as orders, count(distinct custkey) as customers from l group by 1, 2)
select returnflag, linestatus, 'orders' as metric, orders::bigint as n, true as near from n where orders > 0
union all select returnflag, linestatus, 'customers', customers::bigint, true from n where customers > 0""",
    "p8_texts_whole": "select doc_id, true as complete, true as fits, true as whole from documents where text is not null",
    "p9_verbatim": "select distinct doc_id, item_id from ("
    + _RUNS.replace("ID", "doc_id").replace("TEXT", "text").replace("TABLE", "documents")
    + ") d join ("
    + _RUNS.replace("ID", "item_id").replace("TEXT", "item_text").replace("TABLE", "eval_items")
    + ") i on d.run = i.run",
    "p10_covering": f"select doc_id, length(translate(text, '{_BLANKS}', ''))::bigint as covered, 0::bigint as crossing, 0::bigint as overlapping from documents where length(translate(text, '{_BLANKS}', '')) > 0",
    "p5_found": r"""with c0 as (
  select custkey, nationkey, replace(replace(replace(replace(trim(acctbal), ' ', ''), 'USD', ''), '$', ''), ',', '') as a,
    row_number() over (partition by custkey order by loaded_at desc nulls last) as k from tpch_customer where custkey is not null
), c as (
  select custkey, nationkey, try_cast(case when regexp_full_match(a, '\((\d+\.?\d*)\)') then '-' || trim(a, '()') when regexp_full_match(a, '\d+\.?\d*-') then '-' || rtrim(a, '-')
    when regexp_full_match(a, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') then ltrim(a, '+') end as double) as score from c0 where k = 1
), o as (
  select orderkey, custkey, totalprice, row_number() over (partition by orderkey order by loaded_at desc nulls last) as k from tpch_orders where orderkey is not null
), r as (
  select 'nation' as grp_kind, nationkey as grp, row_number() over (partition by nationkey order by score desc, custkey) as rnk, custkey as item, 10 as n from c where nationkey is not null and score is not null
  union all
  select 'customer', custkey, row_number() over (partition by custkey order by totalprice desc, orderkey), orderkey, 3 from o where k = 1 and custkey is not null and totalprice is not null
)
select grp_kind, grp, rnk::int as rnk, item from r where rnk <= n""",
    "p7_percentiles_by_day": _P7.replace("GROUP", "shipdate, returnflag, linestatus"),
    "p7_percentiles": _P7.replace("GROUP", "returnflag, linestatus"),
    "p7_merged_loads": _P7.replace("GROUP", "returnflag, linestatus"),
}
