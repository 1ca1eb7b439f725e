"""Queries of the relational and streaming operators, each with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet import streaming
from rivulet.functions import exprs as E
from rivulet.functions import preds as P
from rivulet.operators import aggregates as A
from rivulet.operators import joins as J
from rivulet.operators import rows as R
from rivulet.operators import sinks as K
from rivulet.operators import windows as Win
from rivulet.plans import sql
from rivulet.plans.builder import Context
from rivulet.plans.pipeline import Stream
from rivulet.shared import passing_path, table
from rivulet.sources import Sources, delimited

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
C = F.col


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _revenue():
    return C("l_extendedprice") * (1 - C("l_discount"))


def _date(c: str):
    return C(c).cast("date")


def _sources(spark: SparkSession, d: str) -> Sources:
    return Sources(spark).register_parquet(d)


# customers, orders, segments

SEGMENT_COUNT = "select c_mktsegment, count(*)::bigint as n from customer join orders on c_custkey = o_custkey group by c_mktsegment"


@query(SEGMENT_COUNT)
def hyracks_count_by_segment(spark, d):
    j = J.equi_join(table(spark, d, "customer"), table(spark, d, "orders"), ["c_custkey"], ["o_custkey"])
    return A.group(["c_mktsegment"], A.count())(j)


@query("select c_mktsegment, count(distinct o_orderkey)::bigint as n from customer join orders on c_custkey = o_custkey group by c_mktsegment")
def hyracks_distinct_orders(spark, d):
    j = J.equi_join(table(spark, d, "customer"), table(spark, d, "orders"), ["c_custkey"], ["o_custkey"])
    return A.distinct_group(["c_mktsegment"], ["o_orderkey"], A.count())(j)


@query(SEGMENT_COUNT)
def agg_preagg_join(spark, d):
    return J.preaggregated_join(table(spark, d, "customer").withColumnRenamed("c_custkey", "k"), table(spark, d, "orders").select(C("o_custkey").alias("k")), "k", ["c_mktsegment"])


# predicates and projections


@query("select " + ", ".join(f"sum((l_quantity {op} 25)::int)::bigint as n_{n}" for n, op in (("equal", "="), ("nonequal", "<>"), ("less", "<"), ("nonless", ">="), ("greater", ">"), ("nongreater", "<="))) + " from lineitem")
def select_comparison_ops(spark, d):
    return table(spark, d, "lineitem").agg(*[F.count_if(P.compare(op, C("l_quantity"), F.lit(25.0))).alias(f"n_{op}") for op in P.COMPARISONS])


@query("select sum((l_quantity between 10 and 20)::int)::bigint as closed, sum((l_quantity > 10 and l_quantity < 20)::int)::bigint as opened, sum((l_quantity > 10 and l_quantity <= 20)::int)::bigint as half from lineitem")
def select_between_variants(spark, d):
    q = C("l_quantity")
    return table(spark, d, "lineitem").agg(F.count_if(P.between(q, 10, 20)).alias("closed"), F.count_if(P.between(q, 10, 20, False, False)).alias("opened"), F.count_if(P.between(q, 10, 20, False, True)).alias("half"))


@query("select p_partkey, p_name from part where contains(p_name, 'red') and (p_size < 10 or p_size > 40)")
def like_contains(spark, d):
    return R.chain(R.select(P.all_of(P.always(), P.like_contains(C("p_name"), "%red%"), P.any_of(C("p_size") < 10, C("p_size") > 40))), R.project("p_partkey", "p_name"))(table(spark, d, "part"))


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) as charge, l_quantity + l_linenumber - 1 as shifted from lineitem")
def project_arith(spark, d):
    charge = E.multiply(C("l_extendedprice"), E.subtract(F.lit(1.0), C("l_discount")), E.add(F.lit(1.0), C("l_tax")))
    return R.project(0, "l_linenumber", F.round(charge, 6).alias("charge"), E.subtract(E.add(C("l_quantity"), C("l_linenumber")), F.lit(1)).alias("shifted"))(table(spark, d, "lineitem"))


@query("select o_orderkey, trunc(o_totalprice / 1000)::int as thousands, trunc(o_orderkey / 7)::int as sevenths from orders")
def int_division(spark, d):
    return table(spark, d, "orders").select("o_orderkey", E.divide_int(C("o_totalprice"), F.lit(1000)).alias("thousands"), E.divide_int(C("o_orderkey"), F.lit(7)).alias("sevenths"))


@query("select year(o_orderdate)::int as y, (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::int as ymd, count(*)::bigint as n from orders group by 1, 2")
def year_extract(spark, d):
    o = table(spark, d, "orders")
    return A.group({"y": E.year(C("o_orderdate")), "ymd": E.date_int(C("o_orderdate"))}, A.count())(o)


@query("select o_orderkey, (o_orderdate + interval 90 day)::date as d90, (o_orderdate + interval 2 month)::date as m2, (o_orderdate + interval 1 year)::date as y1 from orders")
def date_add_unit(spark, d):
    day = _date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", E.date_plus(day, "day", 90).alias("d90"), E.date_plus(day, "month", 2).alias("m2"), E.date_plus(day, "year", 1).alias("y1"))


@query("select o_orderkey, date_diff('day', o_orderdate::date, date '2002-01-01')::int as days from orders")
def date_diff_days(spark, d):
    return table(spark, d, "orders").select("o_orderkey", E.days_between(_date("o_orderdate"), E.as_date("2002-01-01")).alias("days"))


@query("select c_custkey, c_name || '-' || c_mktsegment as label from customer")
def string_concat(spark, d):
    return table(spark, d, "customer").select("c_custkey", E.concat(C("c_name"), F.lit("-"), C("c_mktsegment")).alias("label"))


@query("select c_custkey, round(c_acctbal * 100)::int as cents, c_nationkey::bigint + trunc(round(c_acctbal * 100)::int / 200.0)::bigint * 100000000 as k from customer")
def composite_key_int_double(spark, d):
    return table(spark, d, "customer").select("c_custkey", E.cents(C("c_acctbal")).alias("cents"), E.key_of_int_amount(C("c_nationkey"), C("c_acctbal"), 2).alias("k"))


@query("select o_orderkey, (o_orderkey % 1000)::int + substr(o_orderpriority, 1, 1)::int * 100000000 as k from orders")
def composite_key_int_string(spark, d):
    return table(spark, d, "orders").select("o_orderkey", E.key_of_int_text((C("o_orderkey") % 1000).cast("int"), C("o_orderpriority")).alias("k"))


@query("select c_custkey, (c_nationkey + 10)::bigint * 10000000 + c_custkey % 10000000 as phone, c_nationkey::bigint + 10 as prefix from customer")
def long_phone(spark, d):
    text = F.format_string("%d-%03d-%04d", C("c_nationkey") + 10, F.floor(C("c_custkey") % 10000000 / 10000).cast("int"), C("c_custkey") % 10000)
    return table(spark, d, "customer").select("c_custkey", E.phone_number(text).alias("phone"), E.phone_number(text, 2).alias("prefix"))


@query("select o_custkey, o_orderkey, o_orderdate::date as o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k from orders) where k = 1")
def distinct_first_by_key(spark, d):
    first = R.distinct(["o_custkey"], [C("o_orderdate"), C("o_orderkey")])
    return first(table(spark, d, "orders")).select("o_custkey", "o_orderkey", _date("o_orderdate").alias("o_orderdate"))


@query("select distinct c_mktsegment from customer")
def distinct_keys(spark, d):
    return R.distinct(["c_mktsegment"])(table(spark, d, "customer").select("c_mktsegment"))


@query("select count(*)::bigint as n from lineitem")
def sample_all(spark, d):
    return R.sample_for_buckets(1000, 1000)(table(spark, d, "lineitem")).agg(A.count())


@query("select event_id, user_id from events where user_id in (1, 5, 9)")
def among_hubs(spark, d):
    return R.among("user_id", [1, 5, 9])(table(spark, d, "events")).select("event_id", "user_id")


@query("select word, count(*)::bigint as n from (select unnest(string_split(p_name, ' ')) as word from part) group by word")
def flat_map_tokens(spark, d):
    return A.group(["word"], A.count())(R.flat_map(lambda t: F.split(t.p_name, " "), "word")(table(spark, d, "part")))


@query("select p_partkey as id, p_size * 2 as doubled from part where p_size > 20")
def map_filter(spark, d):
    return R.chain(R.select(lambda t: t.p_size > 20), R.map_rows(lambda t: {"id": t[0], "doubled": t.p_size * 2}))(table(spark, d, "part"))


@query("select nationkey, count(*)::bigint as n from (select c_nationkey as nationkey from customer union all select s_nationkey from supplier) group by nationkey")
def union_components(spark, d):
    both = R.union(table(spark, d, "customer").select(C("c_nationkey").alias("nationkey")), table(spark, d, "supplier").select("s_nationkey"))
    return A.group(["nationkey"], A.count())(both)


# aggregates


@query("select l_returnflag, count(*)::bigint as n from lineitem group by 1")
def agg_count(spark, d):
    return A.group(["l_returnflag"], A.count())(table(spark, d, "lineitem"))


@query("select l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) as total from lineitem group by 1, 2")
def agg_sum(spark, d):
    return A.group(["l_returnflag", "l_linestatus"], F.round(F.sum("l_extendedprice"), 2).alias("total"))(table(spark, d, "lineitem"))


@query("select l_returnflag, round(avg(l_quantity), 6) as mean from lineitem group by 1")
def agg_avg(spark, d):
    return A.group(["l_returnflag"], F.round(F.avg("l_quantity"), 6).alias("mean"))(table(spark, d, "lineitem"))


@query("select l_returnflag, sum(l_quantity) as q_sum, count(l_quantity)::bigint as q_count from lineitem group by 1")
def agg_avg_sumcount(spark, d):
    return A.group(["l_returnflag"], *A.sum_and_count(C("l_quantity"), "q"))(table(spark, d, "lineitem"))


@query("select l_linestatus, count(*)::bigint as n, sum(l_quantity) as q, round(avg(l_tax), 6) as tax from lineitem group by 1")
def agg_multi(spark, d):
    return A.group(["l_linestatus"], A.count(), A.total(C("l_quantity"), "q"), F.round(F.avg("l_tax"), 6).alias("tax"))(table(spark, d, "lineitem"))


@query("select trunc(l_quantity / 10)::int as tens, count(*)::bigint as n from lineitem group by 1")
def agg_group_by_expr(spark, d):
    return A.group({"tens": E.divide_int(C("l_quantity"), F.lit(10))}, A.count())(table(spark, d, "lineitem"))


@query("select l_returnflag, count(distinct l_suppkey)::bigint as n, sum(distinct l_suppkey)::bigint as total from lineitem group by 1")
def agg_count_distinct(spark, d):
    return A.distinct_group(["l_returnflag"], ["l_suppkey"], A.count(), F.sum("l_suppkey").alias("total"))(table(spark, d, "lineitem"))


@query("select g as l_returnflag, count(*)::bigint as n from (select min(l_returnflag) as g from lineitem group by l_suppkey) group by 1")
def agg_distinct_over_all(spark, d):
    return A.distinct_group(["l_returnflag"], ["l_suppkey"], A.count(), over_all=True)(table(spark, d, "lineitem"))


@query("select sum(l_quantity) as q from lineitem having count(*) > 0")
def agg_global(spark, d):
    return A.group([], A.total(C("l_quantity"), "q"))(table(spark, d, "lineitem"))


@query("select 1.0::double as q where false")
def agg_global_empty(spark, d):
    return A.group([], A.total(C("l_quantity"), "q"))(table(spark, d, "lineitem").where("l_quantity < 0"))


@query("select l_returnflag, sum(l_quantity) as q, sum(n)::bigint as n from (select l_returnflag, l_suppkey, sum(l_quantity) as l_quantity, count(*) as n from lineitem group by 1, 2) group by 1")
def agg_two_phase(spark, d):
    part = A.group(["l_returnflag", "l_suppkey"], F.sum("l_quantity").alias("q"), A.count())(table(spark, d, "lineitem"))
    return A.group(["l_returnflag"], F.sum("q").alias("q"), F.sum("n").alias("n"))(part)


# joins


@query("select l_orderkey, l_linenumber, l_quantity, o_custkey from lineitem join orders on l_orderkey = o_orderkey")
def join_equi(spark, d):
    return J.equi_join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["l_orderkey"], ["o_orderkey"])


@query("select s_suppkey, s_nationkey, n_nationkey, n_name from supplier join nation on s_nationkey = n_nationkey")
def join_equi_keep_right(spark, d):
    return J.equi_join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name"), ["s_nationkey"], ["n_nationkey"], keep_right=True)


@query("select a.l_partkey, a.l_suppkey, count(*)::bigint as n from lineitem a join (select distinct l_partkey, l_suppkey from lineitem where l_quantity > 40) b on a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey group by 1, 2")
def join_equi_multi_key(spark, d):
    l = table(spark, d, "lineitem")
    b = l.where("l_quantity > 40").select(C("l_partkey").alias("p"), C("l_suppkey").alias("s")).distinct()
    return A.group(["l_partkey", "l_suppkey"], A.count())(J.equi_join(l.select("l_partkey", "l_suppkey"), b, ["l_partkey", "l_suppkey"], ["p", "s"]))


@query("select s_suppkey, p_partkey from supplier join part on s_suppkey = p_partkey % 100 + 1")
def join_hash_expression(spark, d):
    return J.expression_join(table(spark, d, "supplier").select("s_suppkey"), table(spark, d, "part").select("p_partkey"), C("s_suppkey"), C("p_partkey") % 100 + 1)


@query("select o_orderkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey and l_extendedprice > o_totalprice / 2")
def join_equi_residual(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    return J.equi_join(o, l, ["o_orderkey"], ["l_orderkey"], residual=l.l_extendedprice > o.o_totalprice / 2).select("o_orderkey", "l_linenumber")


@query("select s_suppkey, count(*)::bigint as n from supplier join part on s_acctbal < p_retailprice group by s_suppkey")
def join_theta_ineq(spark, d):
    s, p = table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), table(spark, d, "part").select("p_retailprice")
    return J.inequality_count(s, p, C("s_acctbal"), "<", C("p_retailprice")).where("n > 0").select("s_suppkey", "n")


@query("select s_suppkey, c_custkey from supplier join customer on s_acctbal > c_acctbal")
def join_inequality_pairs(spark, d):
    s, c = table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return J.inequality_join(s, c, C("s_acctbal"), ">", C("c_acctbal")).select("s_suppkey", "c_custkey")


@query("select count(*)::bigint as n, round(sum(l_extendedprice), 2) as total from orders join lineitem on o_orderkey = l_orderkey and 10 * l_extendedprice < o_totalprice having count(*) > 0")
def join_theta_expr(spark, d):
    j = J.theta_join(table(spark, d, "orders"), table(spark, d, "lineitem"), (C("o_orderkey") == C("l_orderkey")) & (10 * C("l_extendedprice") < C("o_totalprice")))
    return A.group([], A.count(), F.round(F.sum("l_extendedprice"), 2).alias("total"))(j)


@query("select sum(s_suppkey)::bigint as total, count(*)::bigint as n from supplier, nation having count(*) > 0")
def join_cross(spark, d):
    return A.group([], F.sum("s_suppkey").alias("total"), A.count())(J.cross_join(table(spark, d, "supplier"), table(spark, d, "nation")))


@query("select a.s_suppkey as s1, b.s_suppkey as s2 from supplier a join supplier b on abs(a.s_suppkey - b.s_suppkey) <= 1 and a.s_nationkey = b.s_nationkey")
def join_band_keyed(spark, d):
    a = table(spark, d, "supplier").select(C("s_suppkey").alias("s1"), C("s_nationkey").alias("n1"))
    b = table(spark, d, "supplier").select(C("s_suppkey").alias("s2"), C("s_nationkey").alias("n2"))
    return J.band_join(a, b, C("s1"), C("s2"), 1, on=[("n1", "n2")]).select("s1", "s2")


@query("select count(*)::bigint as n, sum(s_suppkey * c_custkey)::bigint as checksum from supplier join customer on abs(s_nationkey - c_nationkey) <= 1 having count(*) > 0")
def join_band_int(spark, d):
    """Both sides are counted and summed by nation before they meet, in decimals as SQL sums bigints in 128 bits; a checksum beyond a bigint is an error there and here."""
    wide = lambda x: C(x).cast("decimal(19,0)")
    s = A.group(["s_nationkey"], A.count("sn"), F.sum(wide("s_suppkey")).alias("st"))(table(spark, d, "supplier"))
    c = A.group(["c_nationkey"], A.count("cn"), F.sum(wide("c_custkey")).alias("ct"))(table(spark, d, "customer"))
    j = J.band_join(s, c, C("s_nationkey"), C("c_nationkey"), 1)
    return A.group([], F.sum(C("sn") * C("cn")).alias("n"), F.sum(C("st") * C("ct")).cast("bigint").alias("checksum"))(j)


@query("select count(*)::bigint as n from supplier join customer on abs(s_acctbal - c_acctbal) < 2 having count(*) > 0")
def join_band_open(spark, d):
    return A.group([], A.count())(J.band_join(table(spark, d, "supplier").select("s_acctbal"), table(spark, d, "customer").select("c_acctbal"), C("s_acctbal"), C("c_acctbal"), 2, closed=False))


@query("select count(*)::bigint as n from (select l_shipdate::date as a from lineitem where l_returnflag = 'R' and l_quantity > 45) x join (select l_shipdate::date as b from lineitem where l_returnflag <> 'R' and l_quantity > 45) y on abs(date_diff('day', a, b)) <= 1 having count(*) > 0")
def join_band_date(spark, d):
    l = table(spark, d, "lineitem").where("l_quantity > 45")
    x, y = l.where("l_returnflag = 'R'").select(_date("l_shipdate").alias("a")), l.where("l_returnflag <> 'R'").select(_date("l_shipdate").alias("b"))
    return A.group([], A.count())(J.band_join(x, y, J.days(C("a")), J.days(C("b")), 1))


@query("select count(*)::bigint as n from (select s_suppkey as a from supplier) join (select s_suppkey as b from supplier) on a >= b - 5 and a <= b + 5 having count(*) > 0")
def join_band_shifted(spark, d):
    a, b = table(spark, d, "supplier").select(C("s_suppkey").alias("a")), table(spark, d, "supplier").select(C("s_suppkey").alias("b"))
    return A.group([], A.count())(J.band_join(a, b, C("a"), C("b"), 5).where(P.shifted("nongreater", C("a"), C("b"), 5)))


@query("select count(*)::bigint as n, round(avg(a.o_totalprice), 2) as mean from orders a join orders b on a.o_custkey = b.o_custkey and a.o_totalprice > 10 * b.o_totalprice having count(*) > 0")
def join_self(spark, d):
    o = table(spark, d, "orders")
    a, b = o.select("o_custkey", "o_totalprice"), o.select(C("o_custkey").alias("k"), C("o_totalprice").alias("p"))
    j = J.equi_join(a, b, ["o_custkey"], ["k"], residual=C("o_totalprice") > 10 * C("p"))
    return A.group([], A.count(), F.round(F.avg("o_totalprice"), 2).alias("mean"))(j)


@query("select count(*)::bigint as n from lineitem a join lineitem b on a.l_partkey = b.l_partkey and a.l_extendedprice > b.l_extendedprice and a.l_returnflag = 'R' and b.l_returnflag = 'N' having count(*) > 0")
def join_self_prices(spark, d):
    l = table(spark, d, "lineitem")
    a, b = l.where("l_returnflag = 'R'").select("l_partkey", "l_extendedprice"), l.where("l_returnflag = 'N'").select(C("l_partkey").alias("k"), C("l_extendedprice").alias("p"))
    return A.group([], A.count())(J.equi_join(a, b, ["l_partkey"], ["k"], residual=C("l_extendedprice") > C("p")))


@query("select r_name, count(*)::bigint as n from region join nation on r_regionkey = n_regionkey join supplier on n_nationkey = s_nationkey join lineitem on s_suppkey = l_suppkey group by r_name")
def join_nway(spark, d):
    j = J.nway_join(
        {"r": table(spark, d, "region"), "n": table(spark, d, "nation"), "s": table(spark, d, "supplier"), "l": table(spark, d, "lineitem").select("l_suppkey")},
        [({"r", "n"}, C("r.r_regionkey") == C("n.n_regionkey")), ({"n", "s"}, C("n.n_nationkey") == C("s.s_nationkey")), ({"s", "l"}, C("s.s_suppkey") == C("l.l_suppkey"))],
    )
    return A.group({"r_name": C("r_r_name")}, A.count())(j)


@query("select n_name, count(*)::bigint as n from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where l_quantity > 45 group by n_name")
def join_fragment_lines_nations(spark, d):
    j = J.nway_join({"l": table(spark, d, "lineitem").where("l_quantity > 45").select("l_suppkey"), "s": table(spark, d, "supplier"), "n": table(spark, d, "nation")}, [({"l", "s"}, C("l.l_suppkey") == C("s.s_suppkey")), ({"s", "n"}, C("s.s_nationkey") == C("n.n_nationkey"))])
    return A.group({"n_name": C("n_n_name")}, A.count())(j)


@query("select p_type, count(*)::bigint as n from part join lineitem on p_partkey = l_partkey group by p_type")
def join_fragment_part_lines(spark, d):
    return A.group(["p_type"], A.count())(J.equi_join(table(spark, d, "lineitem").select("l_partkey"), table(spark, d, "part"), ["l_partkey"], ["p_partkey"]))


@query("with ps as (select distinct l_partkey as pk, l_suppkey as sk from lineitem) select count(*)::bigint as n, round(sum(p_retailprice), 2) as total from part join ps on p_partkey = pk join (select * from supplier join nation on s_nationkey = n_nationkey) on sk = s_suppkey where p_size < 10 and s_acctbal > 0 and 2 * p_retailprice > s_acctbal / 10 having count(*) > 0")
def join_multiple_bushy(spark, d):
    ps = table(spark, d, "lineitem").select(C("l_partkey").alias("pk"), C("l_suppkey").alias("sk")).distinct()
    left = J.equi_join(table(spark, d, "part").where("p_size < 10"), ps, ["p_partkey"], ["pk"])
    right = J.equi_join(table(spark, d, "supplier").where("s_acctbal > 0"), table(spark, d, "nation"), ["s_nationkey"], ["n_nationkey"])
    j = J.theta_join(left, right, (C("sk") == C("s_suppkey")) & (2 * C("p_retailprice") > C("s_acctbal") / 10))
    return A.group([], A.count(), F.round(F.sum("p_retailprice"), 2).alias("total"))(j)


@query("select o_custkey, count(*)::bigint as n, sum(l.linenumber)::bigint as lines from (select orderkey, custkey as o_custkey from tpch_orders) o join tpch_lineitems l on o.orderkey = l.orderkey group by 1")
def join_skewed_keys(spark, d):
    l, o = table(spark, d, "tpch_lineitems").select("orderkey", "linenumber"), table(spark, d, "tpch_orders").select(C("orderkey").alias("k"), C("custkey").alias("o_custkey"))
    return A.group(["o_custkey"], A.count(), F.sum("linenumber").alias("lines"))(J.skewed_join(l, o, "orderkey", "k"))


@query("select count(*)::bigint as n, sum(l.linenumber * o.shippriority + o.orderkey)::bigint as checksum from (select orderkey, linenumber from tpch_lineitems) l join (select orderkey, shippriority from tpch_orders) o on l.orderkey between o.orderkey - 1 and o.orderkey + 1 having count(*) > 0")
def join_band_skewed(spark, d):
    """A band on a key of which one value holds a tenth of the rows."""
    l, o = table(spark, d, "tpch_lineitems").select("orderkey", "linenumber"), table(spark, d, "tpch_orders").select(C("orderkey").alias("k"), "shippriority")
    return A.group([], A.count(), F.sum(C("linenumber") * C("shippriority") + C("k")).alias("checksum"))(J.band_join(l, o, C("orderkey"), C("k"), 1))


@query("select p_name, count(*)::bigint as n from part join (select distinct l_partkey as a, l_suppkey as b from lineitem) x on p_partkey = x.a join (select distinct l_partkey as a, l_suppkey as b from lineitem) y on x.b = y.a group by 1")
def url_reachability(spark, d):
    """Paths of two arcs by the name that an index gives to their start."""
    e = table(spark, d, "lineitem").select(C("l_partkey").alias("a"), C("l_suppkey").alias("b")).distinct()
    # the second hop is only counted, so it comes as a count by its start
    hop = A.group(["a"], A.count())(e)
    j = J.nway_join({"x": e, "y": hop, "i": table(spark, d, "part").select("p_partkey", "p_name")}, [({"x", "y"}, C("x.b") == C("y.a")), ({"x", "i"}, C("x.a") == C("i.p_partkey"))])
    return A.group({"p_name": C("i_p_name")}, F.sum("y_n").alias("n"))(j)


@query("select m.c1 as machine, count(*)::bigint as n from machine_attributes m join attribute_types t on m.c2 = t.attr_name join (select c1, max(c0) as last from machine_attributes where c4 = 1 group by c1) f on m.c1 = f.c1 where m.c3 <> '' and m.c0 <= f.last group by 1")
def most_failed_machine(spark, d):
    """Statements before the last deletion of each machine, by a join of three relations."""
    m = table(spark, d, "machine_attributes")
    log = R.select(C("c3") != "")(m).select("c0", "c1", "c2")
    failed = A.group(["c1"], F.max("c0").alias("last"))(R.select(C("c4") == 1)(m))
    j = J.nway_join({"m": log, "t": table(spark, d, "attribute_types").select("attr_name"), "f": failed}, [({"m", "t"}, C("m.c2") == C("t.attr_name")), ({"m", "f"}, (C("m.c1") == C("f.c1")) & (C("m.c0") <= C("f.last")))])
    return A.group({"machine": C("m_c1")}, A.count())(j)


EDGES = "select distinct l_partkey % 97 as a, (l_suppkey * 7 + l_linenumber) % 97 as b from lineitem where l_quantity > 48"


@query(f"with e as ({EDGES}) select x.a as a, z.b as b, count(*)::bigint as n from e x join e y on x.b = y.a join e z on y.b = z.a group by 1, 2")
def reachability_3hop(spark, d):
    e = table(spark, d, "lineitem").where("l_quantity > 48").select((C("l_partkey") % 97).alias("a"), ((C("l_suppkey") * 7 + C("l_linenumber")) % 97).alias("b")).distinct()
    # paths are counted hop by hop, so no more rows than pairs of nodes are ever joined
    two = e.alias("x").join(e.alias("y"), C("x.b") == C("y.a")).groupBy(C("x.a").alias("a"), C("y.b").alias("m")).agg(A.count("k"))
    return two.join(e.alias("z"), C("m") == C("z.a")).groupBy(two["a"].alias("a"), C("z.b").alias("b")).agg(F.sum("k").alias("n"))


@query("with e as (select distinct l_partkey as a, l_suppkey as b from lineitem) select x.a as a, count(*)::bigint as n from e x join e y on x.b = y.a join e z on y.b = z.a group by 1")
def reachability_3hop_arcs(spark, d):
    """Paths of three arcs by start node, over all arcs from part to supplier; a part and a supplier of one number are one node."""
    e = table(spark, d, "lineitem").select(C("l_partkey").alias("a"), C("l_suppkey").alias("b")).distinct()
    # paths are counted hop by hop from their end, so no hop joins more rows than there are arcs
    paths = e.groupBy("a").agg(A.count())
    for _ in range(2):
        paths = e.join(paths.select(C("a").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("n"))
    return paths


@query("select sum(r.o_orderkey * t.s_suppkey)::bigint as total, count(*)::bigint as n from orders r join customer s on r.o_custkey = s.c_custkey join supplier t on s.c_nationkey = t.s_nationkey where r.o_custkey = 10 having count(*) > 0")
def rst(spark, d):
    r = table(spark, d, "orders").where("o_custkey = 10").select(C("o_orderkey").alias("A"), C("o_custkey").alias("B"))
    s = table(spark, d, "customer").select(C("c_custkey").alias("B"), C("c_nationkey").alias("C"))
    t = table(spark, d, "supplier").select(C("s_nationkey").alias("C"), C("s_suppkey").alias("D"))
    return A.group([], F.sum(C("A") * C("D")).alias("total"), A.count())(J.equi_join(J.equi_join(r, s, ["B"]), t, ["C"]))


@query("select c1, count(*)::bigint as n from machine_attributes where c4 = 1 and c3 <> '' group by c1")
def cluster_deleted_attributes(spark, d):
    return A.group(["c1"], A.count())(R.select((C("c4") == 1) & (C("c3") != ""))(table(spark, d, "machine_attributes")))


# decision support queries


def _col_line(spark, d):
    return table(spark, d, "lineitem")


@query("select o_orderkey, o_orderdate::date as o_orderdate, o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' and o_orderdate < date '1998-03-15' and l_shipdate > date '1998-03-15' group by 1, 2, 3")
def q3(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, d, "orders").where("o_orderdate < timestamp_ntz'1998-03-15'").select("o_orderkey", "o_custkey", _date("o_orderdate").alias("o_orderdate"), "o_orderpriority")
    l = _col_line(spark, d).where("l_shipdate > timestamp_ntz'1998-03-15'")
    j = J.equi_join(J.equi_join(o, c, ["o_custkey"], ["c_custkey"]), l, ["o_orderkey"], ["l_orderkey"])
    return A.group(["o_orderkey", "o_orderdate", "o_orderpriority"], F.round(F.sum(_revenue()), 2).alias("revenue"))(j)


@query("select o_orderpriority, count(distinct o_orderkey)::bigint as n from orders join lineitem on l_orderkey = o_orderkey where o_orderdate >= date '1996-07-01' and o_orderdate < date '1996-10-01' and l_shipdate > o_orderdate + interval 30 day group by 1")
def q4(spark, d):
    o = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1996-07-01' and o_orderdate < timestamp_ntz'1996-10-01'")
    l = _col_line(spark, d).select("l_orderkey", "l_shipdate")
    j = J.equi_join(o, l, ["o_orderkey"], ["l_orderkey"], residual=E.days_between(_date("o_orderdate"), _date("l_shipdate")) > 30)
    return A.distinct_group(["o_orderpriority"], ["o_orderkey"], A.count())(j)


Q5 = "from region join nation on r_regionkey = n_regionkey join supplier on s_nationkey = n_nationkey join lineitem on l_suppkey = s_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey and c_nationkey = s_nationkey where r_name = 'ASIA' and o_orderdate >= date '1997-01-01' and o_orderdate < date '1998-01-01' group by n_name"


def _q5(spark, d):
    r = table(spark, d, "region").where("r_name = 'ASIA'").select("r_regionkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    o = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1997-01-01' and o_orderdate < timestamp_ntz'1998-01-01'").select("o_orderkey", "o_custkey")
    l = _col_line(spark, d).select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    sn = J.equi_join(s, J.equi_join(n, r, ["n_regionkey"], ["r_regionkey"]), ["s_nationkey"], ["n_nationkey"])
    lo = J.equi_join(J.equi_join(l, sn, ["l_suppkey"], ["s_suppkey"]), o, ["l_orderkey"], ["o_orderkey"])
    return J.equi_join(lo, table(spark, d, "customer").select("c_custkey", "c_nationkey"), ["o_custkey", "s_nationkey"], ["c_custkey", "c_nationkey"])


@query(f"select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue {Q5}")
def q5(spark, d):
    return A.group(["n_name"], F.round(F.sum(_revenue()), 2).alias("revenue"))(_q5(spark, d))


@query(f"select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue_sum, count(*)::bigint as revenue_count {Q5}")
def q5_avg(spark, d):
    s, n = A.sum_and_count(_revenue(), "revenue")
    return A.group(["n_name"], s, n)(_q5(spark, d)).select("n_name", F.round("revenue_sum", 2).alias("revenue_sum"), "revenue_count")


@query("select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem where l_shipdate >= date '1997-01-01' and l_shipdate < date '1998-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24 having count(*) > 0")
def q6(spark, d):
    l = R.select(P.all_of(C("l_shipdate") >= F.expr("timestamp_ntz'1997-01-01'"), C("l_shipdate") < F.expr("timestamp_ntz'1998-01-01'"), P.between(C("l_discount"), 0.05, 0.07), C("l_quantity") < 24))(_col_line(spark, d))
    return A.group([], F.round(F.sum(C("l_extendedprice") * C("l_discount")), 2).alias("revenue"))(l)


Q7 = "from supplier join lineitem on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation n1 on s_nationkey = n1.n_nationkey join nation n2 on c_nationkey = n2.n_nationkey where ((n1.n_name = 'NATION_6' and n2.n_name = 'NATION_7') or (n1.n_name = 'NATION_7' and n2.n_name = 'NATION_6')) and l_shipdate between date '1998-01-01' and date '1999-12-31'"


def _q7(spark, d):
    n = table(spark, d, "nation").where("n_name in ('NATION_6', 'NATION_7')").select("n_nationkey", "n_name")
    s = J.equi_join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), n.withColumnRenamed("n_name", "supp_nation"), ["s_nationkey"], ["n_nationkey"])
    c = J.equi_join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), n.withColumnRenamed("n_name", "cust_nation"), ["c_nationkey"], ["n_nationkey"])
    l = _col_line(spark, d).where("l_shipdate >= timestamp_ntz'1998-01-01' and l_shipdate <= timestamp_ntz'1999-12-31'").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate")
    ls = J.equi_join(l, s, ["l_suppkey"], ["s_suppkey"])
    oc = J.equi_join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"], ["c_custkey"])
    return J.equi_join(ls, oc, ["l_orderkey"], ["o_orderkey"], residual=C("supp_nation") != C("cust_nation"))


@query(f"select n1.n_name as supp_nation, n2.n_name as cust_nation, year(l_shipdate)::int as l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue {Q7} group by 1, 2, 3")
def q7(spark, d):
    return A.group({"supp_nation": C("supp_nation"), "cust_nation": C("cust_nation"), "l_year": E.year(C("l_shipdate"))}, F.round(F.sum(_revenue()), 2).alias("revenue"))(_q7(spark, d))


@query("select n2.n_name as nation, year(o_orderdate)::int as o_year, round(sum(l_extendedprice * (1 - l_discount)), 2) as volume from part join lineitem on p_partkey = l_partkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation n1 on c_nationkey = n1.n_nationkey join region on n1.n_regionkey = r_regionkey join supplier on s_suppkey = l_suppkey join nation n2 on s_nationkey = n2.n_nationkey where r_name = 'AMERICA' and p_type = 'ECONOMY' and o_orderdate between date '1998-01-01' and date '1999-12-31' group by 1, 2")
def q8(spark, d):
    p = table(spark, d, "part").where("p_type = 'ECONOMY'").select("p_partkey")
    nr = J.equi_join(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), table(spark, d, "region").where("r_name = 'AMERICA'").select("r_regionkey"), ["n_regionkey"], ["r_regionkey"])
    c = J.equi_join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), nr, ["c_nationkey"], ["n_nationkey"]).select("c_custkey")
    o = J.equi_join(table(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1998-01-01' and o_orderdate <= timestamp_ntz'1999-12-31'").select("o_orderkey", "o_custkey", "o_orderdate"), c, ["o_custkey"], ["c_custkey"])
    l = J.equi_join(_col_line(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"), p, ["l_partkey"], ["p_partkey"])
    s = J.equi_join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "nation").select(C("n_nationkey").alias("k"), C("n_name").alias("nation")), ["s_nationkey"], ["k"])
    j = J.equi_join(J.equi_join(l, o, ["l_orderkey"], ["o_orderkey"]), s, ["l_suppkey"], ["s_suppkey"])
    return A.group({"nation": C("nation"), "o_year": E.year(C("o_orderdate"))}, F.round(F.sum(_revenue()), 2).alias("volume"))(j)


@query("select n_name as nation, year(o_orderdate)::int as o_year, round(sum(l_extendedprice * (1 - l_discount)), 2) as profit from part join lineitem on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join nation on s_nationkey = n_nationkey where contains(p_name, 'red') group by 1, 2")
def q9_partial(spark, d):
    j = J.nway_join(
        {"p": table(spark, d, "part").where(P.like_contains(C("p_name"), "%red%")).select("p_partkey"), "l": _col_line(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"), "s": table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "o": table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "n": table(spark, d, "nation").select("n_nationkey", "n_name")},
        [({"p", "l"}, C("p.p_partkey") == C("l.l_partkey")), ({"s", "l"}, C("s.s_suppkey") == C("l.l_suppkey")), ({"o", "l"}, C("o.o_orderkey") == C("l.l_orderkey")), ({"s", "n"}, C("s.s_nationkey") == C("n.n_nationkey"))],
    )
    return A.group({"nation": C("n_n_name"), "o_year": E.year(C("o_o_orderdate"))}, F.round(F.sum(C("l_l_extendedprice") * (1 - C("l_l_discount"))), 2).alias("profit"))(j)


@query("select c_custkey, c_name, n_name, c_acctbal, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey where o_orderdate >= date '1996-10-01' and o_orderdate < date '1997-01-01' and l_returnflag = 'R' group by 1, 2, 3, 4")
def q10(spark, d):
    o = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1996-10-01' and o_orderdate < timestamp_ntz'1997-01-01'").select("o_orderkey", "o_custkey")
    l = _col_line(spark, d).where("l_returnflag = 'R'").select("l_orderkey", "l_extendedprice", "l_discount")
    per_customer = A.group(["o_custkey"], F.sum(_revenue()).alias("r"))(J.equi_join(o, l, ["o_orderkey"], ["l_orderkey"]))
    c = J.equi_join(table(spark, d, "customer"), table(spark, d, "nation"), ["c_nationkey"], ["n_nationkey"])
    return J.equi_join(c, per_customer, ["c_custkey"], ["o_custkey"]).select("c_custkey", "c_name", "n_name", "c_acctbal", F.round("r", 2).alias("revenue"))


@query("select l_linestatus, count(*)::bigint as n from orders join lineitem on o_orderkey = l_orderkey where (starts_with(o_orderpriority, '1') or starts_with(o_orderpriority, '2')) and l_shipdate < o_orderdate + interval 60 day and year(l_shipdate) = 1997 group by 1")
def q12_like(spark, d):
    o = table(spark, d, "orders").where(P.any_of(F.startswith("o_orderpriority", F.lit("1")), F.startswith("o_orderpriority", F.lit("2")))).select("o_orderkey", "o_orderdate")
    l = _col_line(spark, d).where("l_shipdate >= timestamp_ntz'1997-01-01' and l_shipdate < timestamp_ntz'1998-01-01'").select("l_orderkey", "l_shipdate", "l_linestatus")
    return A.group(["l_linestatus"], A.count())(J.equi_join(l, o, ["l_orderkey"], ["o_orderkey"], residual=E.days_between(_date("o_orderdate"), _date("l_shipdate")) < 60))


@query("select round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*)::bigint as n from lineitem join part on p_partkey = l_partkey where (p_size < 10 and l_quantity between 1 and 11) or (p_size between 10 and 20 and l_quantity between 10 and 20) or (p_type = 'ECONOMY' and l_quantity > 40) having count(*) > 0")
def q19_like(spark, d):
    q = C("l_quantity")
    cond = P.any_of(P.all_of(C("p_size") < 10, P.between(q, 1, 11)), P.all_of(P.between(C("p_size"), 10, 20), P.between(q, 10, 20)), P.all_of(C("p_type") == "ECONOMY", q > 40))
    j = J.equi_join(_col_line(spark, d), table(spark, d, "part"), ["l_partkey"], ["p_partkey"], residual=cond)
    return A.group([], F.round(F.sum(_revenue()), 2).alias("revenue"), A.count())(j)


@query("select o_orderkey, o_orderdate::date as o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' and o_orderdate < date '1998-03-15' and l_shipdate > date '1998-03-15' group by 1, 2")
def nway_q3(spark, d):
    j = J.nway_join(
        {"c": table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey"), "o": table(spark, d, "orders").where("o_orderdate < timestamp_ntz'1998-03-15'").select("o_orderkey", "o_custkey", "o_orderdate"), "l": _col_line(spark, d).where("l_shipdate > timestamp_ntz'1998-03-15'").select("l_orderkey", "l_extendedprice", "l_discount")},
        [({"c", "o"}, C("c.c_custkey") == C("o.o_custkey")), ({"o", "l"}, C("o.o_orderkey") == C("l.l_orderkey"))],
    )
    return A.group({"o_orderkey": C("o_o_orderkey"), "o_orderdate": _date("o_o_orderdate")}, F.round(F.sum(C("l_l_extendedprice") * (1 - C("l_l_discount"))), 2).alias("revenue"))(j)


@query(f"select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue {Q5}")
def nway_q5(spark, d):
    j = J.nway_join(
        {
            "r": table(spark, d, "region").where("r_name = 'ASIA'").select("r_regionkey"), "n": table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "s": table(spark, d, "supplier").select("s_suppkey", "s_nationkey"),
            "l": _col_line(spark, d).select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"), "o": table(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1997-01-01' and o_orderdate < timestamp_ntz'1998-01-01'").select("o_orderkey", "o_custkey"), "c": table(spark, d, "customer").select("c_custkey", "c_nationkey"),
        },
        [({"r", "n"}, C("r.r_regionkey") == C("n.n_regionkey")), ({"n", "s"}, C("n.n_nationkey") == C("s.s_nationkey")), ({"s", "l"}, C("s.s_suppkey") == C("l.l_suppkey")), ({"l", "o"}, C("l.l_orderkey") == C("o.o_orderkey")), ({"o", "c"}, C("o.o_custkey") == C("c.c_custkey")), ({"s", "c"}, C("s.s_nationkey") == C("c.c_nationkey"))],
    )
    return A.group({"n_name": C("n_n_name")}, F.round(F.sum(C("l_l_extendedprice") * (1 - C("l_l_discount"))), 2).alias("revenue"))(j)


# windows over events

BEGIN = 1704067200  # 2024-01-01 UTC


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", C("ts").cast("timestamp"))


def _flat(df):
    """Instants as zone-free timestamps, as SQL has them."""
    return df.withColumns({c: C(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


TUMBLING = "select to_timestamp(floor(epoch(ts) / 3600) * 3600)::timestamp as window_start, (to_timestamp(floor(epoch(ts) / 3600) * 3600 + 3600))::timestamp as window_end, event_type, round(sum(value), 2) as total, count(*)::bigint as n from events group by 1, 2, 3"


@query(TUMBLING)
def window_tumbling_sum(spark, d):
    return _flat(Win.windowed(_events(spark, d), "ts", 3600, F.round(F.sum("value"), 2).alias("total"), A.count(), keys=["event_type"]))


@query("select to_timestamp(s)::timestamp as window_start, to_timestamp(s + 7200)::timestamp as window_end, round(sum(value), 2) as total, round(avg(value), 8) as mean from (select value, unnest([floor(epoch(ts) / 1800) * 1800 - 1800 * k for k in range(4)]) as s, epoch(ts) as e from events) where s <= e and e < s + 7200 group by 1, 2")
def window_sliding_sum(spark, d):
    return _flat(Win.windowed(_events(spark, d), "ts", 7200, F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 8).alias("mean"), slide=1800))


@query("select event_type, round(sum(value), 2) as total, count(*)::bigint as n from events group by 1")
def window_landmark(spark, d):
    return Win.landmark(_events(spark, d), F.round(F.sum("value"), 2).alias("total"), A.count(), keys=["event_type"])


@query(f"select wid, to_timestamp({BEGIN} + wid * 86400)::timestamp as window_start, to_timestamp({BEGIN} + wid * 86400 + 172800)::timestamp as window_end, count(*)::bigint as n from (select unnest(generate_series(floor((epoch(ts) - {BEGIN}) / 86400)::bigint + 1, floor((epoch(ts) + 172800 - {BEGIN}) / 86400)::bigint + 1)) as wid from events) group by 1")
def window_compat_ids(spark, d):
    return _flat(Win.numbered_windows(_events(spark, d), "ts", 172800, A.count(), slide=86400, origin=BEGIN))


def _views_clicks(spark, d):
    e = _events(spark, d)
    return e.where("event_type = 'view'").select(C("event_id").alias("v"), C("user_id").alias("u"), C("ts").alias("vt")), e.where("event_type = 'click'").select(C("event_id").alias("c"), C("user_id").alias("w"), C("ts").alias("ct"))


SLIDING = "select a.event_id as v, b.event_id as c from events a join events b on a.user_id = b.user_id and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000 where a.event_type = 'view' and b.event_type = 'click'"


@query(SLIDING)
def join_sliding(spark, d):
    v, c = _views_clicks(spark, d)
    return J.sliding_join(v, c, "vt", "ct", 3600, on=[("u", "w")]).select("v", "c")


@query("select a.event_id as v, b.event_id as c from events a join events b on a.user_id = b.user_id and floor(epoch(a.ts) / 7200) = floor(epoch(b.ts) / 7200) where a.event_type = 'view' and b.event_type = 'click'")
def join_tumbling(spark, d):
    v, c = _views_clicks(spark, d)
    return J.tumbling_join(v, c, "vt", "ct", 7200, on=[("u", "w")]).select("v", "c")


@query("select a.user_id as u, count(*)::bigint as n from events a join events b on a.user_id = b.user_id where a.event_type = 'view' and b.event_type = 'click' group by 1")
def join_full_history(spark, d):
    v, c = _views_clicks(spark, d)
    return J.preaggregated_join(v.select(C("u").alias("k"), "u"), c.select(C("w").alias("k")), "k", ["u"])


@query("select event_type, ts, event_id, round(value, 2) as delta from events where value is not null")
def delta_stream(spark, d):
    e = table(spark, d, "events").where("value is not null")
    return A.deltas(e, ["event_type"], "ts", C("value"), tie="event_id").withColumn("delta", F.round("delta", 2))


@query(
    "with r as (select event_type, ts, event_id, round(value * 100)::bigint as v, sum(round(value * 100)::bigint) over (partition by event_type order by ts, event_id) as s, row_number() over (partition by event_type order by ts, event_id) as k from events where value is not null) "
    "select event_type, ts, event_id, s::bigint as total, 1 as multiplicity from r union all select event_type, ts, event_id, (s - v)::bigint, -1 from r where k > 1"
)
def retraction_stream(spark, d):
    e = table(spark, d, "events").where("value is not null")
    return A.retractions(e, ["event_type"], "ts", F.round(C("value") * 100).cast("bigint"), tie="event_id")


@query("select event_type, event_id, (sum(round(value * 100)::bigint) over (partition by event_type order by ts, event_id))::bigint as new_total, (sum(round(value * 100)::bigint) over (partition by event_type order by ts, event_id rows between unbounded preceding and 1 preceding))::bigint as old_total from events where value is not null")
def running_totals(spark, d):
    e = table(spark, d, "events").where("value is not null").select("event_type", "event_id", "ts", "value")
    return A.running(e, ["event_type"], "ts", F.round(C("value") * 100).cast("bigint"), tie="event_id").select("event_type", "event_id", "new_total", "old_total")


@query("select true as near, true as part_of, 600::bigint as asked from events limit 1")
def sample_rate(spark, d):
    """A sample of three tenths has about as many rows, all of the table; buckets ask for a hundred rows each."""
    e = table(spark, d, "events").select("event_id")
    total = e.count()
    n, known = R.sample(0.3, 7)(e).join(e.select(C("event_id").alias("k")), C("event_id") == C("k"), "left").agg(F.count("event_id"), F.count("k")).first()
    six = R.sample_for_buckets(total, 6)(e).count()
    off = lambda got, share: abs(got - total * share) <= 6 * (total * share * (1 - share)) ** 0.5
    return spark.range(1).select(F.lit(off(n, 0.3) and off(six, min(1.0, 600 / total))).alias("near"), F.lit(n == known).alias("part_of"), F.lit(600).cast("bigint").alias("asked"))


@query("select user_id, count(*)::bigint as n from events group by 1 having count(*) >= 70")
def heavy_hitters(spark, d):
    return A.heavy_hitters(table(spark, d, "events"), "user_id", 70)


# front ends


@query("select c_mktsegment, count(*)::bigint as n from customer join orders on c_custkey = o_custkey where o_orderdate < date '1998-01-01' group by 1")
def sql_implicit_group(spark, d):
    _sources(spark, d).views("customer", "orders")
    return sql.run(spark, "# orders by segment\nSELECT C_MKTSEGMENT AS c_mktsegment, COUNT(*) AS n FROM customer JOIN orders ON C_CUSTKEY = O_CUSTKEY WHERE O_ORDERDATE < {d '1998-01-01'}")


@query("select year(o_orderdate)::int as y, sum(trunc(o_totalprice / 1000)::int)::bigint as k from orders join customer on o_custkey = c_custkey where contains(c_mktsegment, 'BUILD') group by 1")
def sql_compat(spark, d):
    _sources(spark, d).views("customer", "orders")
    return sql.run(spark, "SELECT EXTRACT_YEAR(o_orderdate) AS y, SUM(o_totalprice / 1000) AS k FROM orders INNER JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment LIKE '%BUILD%' GROUP BY o_orderdate ORDER BY y LIMIT 3", compat=True)


@query("select o_orderpriority, l_returnflag, count(o_orderpriority)::bigint as n from orders join lineitem on o_orderkey = l_orderkey where (o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH' or o_orderpriority = '3-MEDIUM' or o_orderpriority = '5-LOW') and (l_returnflag = 'R' or l_returnflag = 'A') and l_shipdate >= date '1997-01-01' and l_shipdate < date '1998-10-01' and o_orderdate < l_shipdate group by 1, 2")
def sql_tpch12(spark, d):
    _sources(spark, d).views("orders", "lineitem")
    return sql.run(spark, "SELECT O_ORDERPRIORITY AS o_orderpriority, L_RETURNFLAG AS l_returnflag, COUNT(ORDERS.O_ORDERPRIORITY) AS n FROM ORDERS inner join LINEITEM on ORDERS.O_ORDERKEY = LINEITEM.L_ORDERKEY WHERE (O_ORDERPRIORITY = '1-URGENT' OR O_ORDERPRIORITY = '2-HIGH' or O_ORDERPRIORITY = '3-MEDIUM' or O_ORDERPRIORITY = '5-LOW') AND (L_RETURNFLAG = 'R' OR L_RETURNFLAG = 'A') AND L_SHIPDATE >= {d '1997-01-01'} AND L_SHIPDATE < {d '1998-10-01'} AND O_ORDERDATE < L_SHIPDATE GROUP BY L_RETURNFLAG", compat=True)


@query("select round(sum(p_size * (1.0 - l_discount)), 2) as total from lineitem join part on l_partkey = p_partkey where p_type = 'ECONOMY' or p_type = 'PROMO' or p_brand = 'Brand#12' or p_size = 7 having count(*) > 0")
def sql_tpch19(spark, d):
    _sources(spark, d).views("lineitem", "part")
    return sql.run(spark, "SELECT ROUND(SUM(PART.P_SIZE * (1.0e0 - LINEITEM.L_DISCOUNT)), 2) AS total FROM LINEITEM INNER JOIN PART ON LINEITEM.L_PARTKEY = PART.P_PARTKEY WHERE (PART.P_TYPE = 'ECONOMY') OR (PART.P_TYPE = 'PROMO') OR (PART.P_BRAND = 'Brand#12') OR (PART.P_SIZE = 7)", compat=True)


@query("select c_mktsegment, count(distinct o_custkey)::bigint as n from customer join orders on c_custkey = o_custkey group by 1")
def sql_distinct(spark, d):
    _sources(spark, d).views("customer", "orders")
    return sql.run(spark, "SELECT c_mktsegment, COUNT(DISTINCT o_custkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey", compat=True)


@query("select a.n_name as one, count(*)::bigint as n from nation a join nation b on a.n_regionkey = b.n_regionkey group by 1")
def sql_self_join(spark, d):
    _sources(spark, d).views("nation")
    return sql.run(spark, "SELECT A.n_name AS one, COUNT(*) AS n FROM nation A INNER JOIN nation B ON A.n_regionkey = B.n_regionkey", compat=True)


@query("select o_orderkey, trunc(o_orderkey * 3 / 2.0)::int + 1 as k, trunc(o_custkey / 7.0)::int * 2 - o_orderkey as j from orders where o_orderkey > 150.0")
def sql_precedence(spark, d):
    _sources(spark, d).views("orders")
    return sql.run(spark, "SELECT o_orderkey, o_orderkey * 3 / 2 + 1 AS k, o_custkey / 7 * 2 - o_orderkey AS j FROM orders WHERE o_orderkey > 1.5e2", compat=True)


@query("select c_custkey, c_name || '/' || c_mktsegment as label from customer order by 1 limit 40")
def sql_default_clauses(spark, d):
    """The default mode keeps what the dialect leaves out."""
    _sources(spark, d).views("customer")
    return sql.run(spark, "SELECT c_custkey, c_name || '/' || c_mktsegment AS label FROM customer ORDER BY c_custkey LIMIT 40")


@query(SEGMENT_COUNT)
def fn_hyracks(spark, d):
    src = _sources(spark, d)
    orders = Stream.source(src, "orders").map(lambda t: {"o_custkey": t.o_custkey})
    return Stream.source(src, "customer").join(orders, lambda c: c.c_custkey, lambda o: o.o_custkey).group_by_key(lambda t: 1, lambda t: {"c_mktsegment": t.c_mktsegment}).to_df("n")


@query("select o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' and l_shipdate > date '1998-03-15' group by 1")
def fn_q3(spark, d):
    src = _sources(spark, d)
    c = Stream.source(src, "customer").filter(lambda t: t.c_mktsegment == "BUILDING")
    l = Stream.source(src, "lineitem").filter(lambda t: t.l_shipdate > F.expr("timestamp_ntz'1998-03-15'"))
    j = c.join(Stream.source(src, "orders"), lambda t: t.c_custkey, lambda t: t.o_custkey).join(l, lambda t: t.o_orderkey, lambda t: t.l_orderkey)
    return j.group_by_key(lambda t: t.l_extendedprice * (1 - t.l_discount), lambda t: {"o_orderkey": t.o_orderkey}).to_df("revenue").withColumn("revenue", F.round("revenue", 2))


@query(f"select to_timestamp(floor(epoch(l_shipdate) / 7776000) * 7776000)::timestamp as window_start, to_timestamp(floor(epoch(l_shipdate) / 7776000) * 7776000 + 7776000)::timestamp as window_end, n1.n_name as supp_nation, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue {Q7} group by 1, 2, 3")
def fn_q7_windowed(spark, d):
    s = Stream(_q7(spark, d)).group_by_key(lambda t: t.l_extendedprice * (1 - t.l_discount), lambda t: {"supp_nation": t.supp_nation}).on_tumbling_window("l_shipdate", 7776000).to_df("revenue")
    return _flat(s.withColumn("revenue", F.round("revenue", 2)))


@query("select event_type as kind, count(*)::bigint as n from events where value > 50 group by 1")
def fn_flat_map(spark, d):
    s = Stream.source(_sources(spark, d), "events").filter(lambda t: t.value > 50).flat_map(lambda t: F.array(t.event_type), "kind")
    return s.group_by_key(lambda t: 1, lambda t: {"kind": t.kind}).to_df("n")


@query("select word, count(*)::bigint as n from (select unnest(string_split(p_name, ' ')) as word from part where p_size > 10) group by 1")
def fn_flat_map_words(spark, d):
    s = Stream.source(_sources(spark, d), "part").filter(lambda t: t.p_size > 10).flat_map(lambda t: F.split(t.p_name, " "), "word")
    return s.group_by_key(lambda t: 1, lambda t: {"word": t.word}).to_df("n")


@query(
    "with j as (select l_shipdate, n_name, l_extendedprice * (1 - l_discount) as v from lineitem join orders on l_orderkey = o_orderkey and abs(date_diff('day', o_orderdate, l_shipdate)) <= 20 join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey), "
    "w as (select n_name, v, epoch(l_shipdate) as e, unnest([floor(epoch(l_shipdate) / 432000) * 432000 - 432000 * k for k in range(4)]) as s from j) "
    "select to_timestamp(s)::timestamp as window_start, to_timestamp(s + 1728000)::timestamp as window_end, n_name, round(sum(v), 2) as revenue from w where s <= e and e < s + 1728000 group by 1, 2, 3"
)
def fn_q7_sliding(spark, d):
    """Line items shipped within 20 days of their order, in windows of 20 days every 5, by the supplier's nation."""
    src = _sources(spark, d)
    l = Stream.source(src, "lineitem").map(lambda t: {c: t[c] for c in ("l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount")})
    o = Stream.source(src, "orders").map(lambda t: {"o_orderkey": t.o_orderkey, "o_orderdate": t.o_orderdate})
    s = Stream.source(src, "supplier").join(Stream.source(src, "nation"), lambda t: t.s_nationkey, lambda t: t.n_nationkey).map(lambda t: {"s_suppkey": t.s_suppkey, "n_name": t.n_name})
    near = l.on_sliding_window(o, "l_shipdate", "o_orderdate", 20 * 86400, on=[("l_orderkey", "o_orderkey")]).join(s, lambda t: t.l_suppkey, lambda t: t.s_suppkey)
    out = near.group_by_key(lambda t: t.l_extendedprice * (1 - t.l_discount), lambda t: {"n_name": t.n_name}).on_window("l_shipdate", 20 * 86400, 5 * 86400).to_df("revenue")
    return _flat(out.withColumn("revenue", F.round("revenue", 2)))


@query(SLIDING)
def fn_sliding_window(spark, d):
    v, c = _views_clicks(spark, d)
    return Stream(v).on_sliding_window(Stream(c), "vt", "ct", 3600, on=[("u", "w")]).to_df().select("v", "c")


@query(SEGMENT_COUNT)
def plan_builder(spark, d):
    ctx = Context(spark)
    ctx.sources.register_parquet(d)
    plan = ctx.plan()
    customer = plan.source("customer").add(R.project("c_custkey", "c_mktsegment")).output_key(0)
    orders = plan.source("orders").add(R.project(1)).output_key("o_custkey")
    plan.equi_join(customer, orders).add(A.group(["c_mktsegment"], A.count()))
    return plan.result()


@query("select n_name, s_suppkey from nation join supplier on n_nationkey = s_nationkey where s_acctbal > 0")
def plan_builder_nway(spark, d):
    plan = Context(spark).plan()
    plan.sources.register_parquet(d)
    n, s = plan.source("n", "nation"), plan.source("s", "supplier").add(R.select(C("s_acctbal") > 0))
    plan.nway_join([n, s], [({"n", "s"}, C("n.n_nationkey") == C("s.s_nationkey"))]).add(R.project(C("n_n_name").alias("n_name"), C("s_s_suppkey").alias("s_suppkey")))
    return plan.result()


# sources and sinks


@query("select n_nationkey, n_name, n_regionkey from nation")
def sink_delimited_roundtrip(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = passing_path(spark, "nation-text")
    K.materialize(path)(n)
    return delimited(spark, path, T.StructType.fromDDL("n_nationkey int, n_name string, n_regionkey int"))


@query("select r_name, count(*)::bigint as n from region join nation on r_regionkey = n_regionkey group by 1")
def sink_store_view(spark, d):
    j = J.equi_join(table(spark, d, "nation"), table(spark, d, "region"), ["n_regionkey"], ["r_regionkey"])
    R.chain(A.group(["r_name"], A.count()), K.store("stored_counts"))(j)
    return spark.sql("SELECT r_name, n FROM stored_counts")


# streams


@query(TUMBLING)
def stream_tumbling_sum(spark, d):
    e = streaming.events_stream(spark, f"{d}/events.parquet", "ts")
    return _flat(streaming.finished(streaming.window_totals(e, "ts", 3600, F.round(F.sum("value"), 2).alias("total"), A.count(), keys=["event_type"]), "complete"))


@query("select event_type, count(*)::bigint as n from events group by 1")
def stream_landmark_count(spark, d):
    e = streaming.events_stream(spark, f"{d}/events.parquet", "ts", late=None)
    return streaming.latest_by_key(streaming.finished(A.group(["event_type"], A.count())(e), "update"), ["event_type"])


@query(SLIDING)
def stream_sliding_join(spark, d):
    def side(kind, names):
        e = streaming.events_stream(spark, f"{d}/events.parquet", "ts").where(C("event_type") == kind)
        return e.select(*[C(a).alias(b) for a, b in names.items()])

    v, c = side("view", {"event_id": "v", "user_id": "u", "ts": "vt"}), side("click", {"event_id": "c", "user_id": "w", "ts": "ct"})
    return streaming.finished(streaming.interval_join(v, c, "vt", "ct", 3600, [("u", "w")])).select("v", "c")


@query("select distinct user_id from events")
def stream_distinct(spark, d):
    return streaming.finished(streaming.events_stream(spark, f"{d}/events.parquet", "ts", late=None).select("user_id").dropDuplicates(["user_id"]))


@query("select a.event_id as v, b.event_id as c from events a join events b on a.user_id = b.user_id where a.event_type = 'view' and b.event_type = 'click'")
def stream_full_history_join(spark, d):
    """Every pair of the whole history: a stream-stream join without watermark, whose state grows with the streams."""

    def side(kind, names):
        e = streaming.events_stream(spark, f"{d}/events.parquet", "ts", late=None).where(C("event_type") == kind)
        return e.select(*[C(a).alias(b) for a, b in names.items()])

    return streaming.finished(side("view", {"event_id": "v", "user_id": "u"}).join(side("click", {"event_id": "c", "user_id": "w"}), C("u") == C("w"))).select("v", "c")
