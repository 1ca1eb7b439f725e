"""Relational operators, windows, front ends, sources and streams on small fixtures."""

import random

import pytest
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
from rivulet.plans import builder, sql
from rivulet.plans.builder import Context
from rivulet.plans.pipeline import Stream
from rivulet.sources import Sources, delimited, parse_schema


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def two(spark):
    rng = random.Random(7)
    l = [(k, rng.choice([rng.randrange(60), None, 5])) for k in range(150)]
    r = [(k, rng.choice([rng.randrange(60), None, 5])) for k in range(120)]
    return l, r, spark.createDataFrame(l, "a int, x int"), spark.createDataFrame(r, "b int, y int")


@pytest.mark.parametrize("d, closed, salt", [(2, True, 1), (2, False, 1), (1.5, True, 3), (0, True, 1), (0, False, 1), (7, True, 5)])
def test_band_join_equals_brute_force(two, d, closed, salt):
    l, r, dl, dr = two
    got = J.band_join(dl, dr, F.col("x"), F.col("y"), d, closed=closed, slices=salt)
    near = lambda x, y: x is not None and y is not None and (abs(x - y) <= d if closed else abs(x - y) < d)
    assert sorted((t.a, t.b) for t in got.collect()) == sorted((a, b) for a, x in l for b, y in r if near(x, y))
    if d:
        assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_inequality_joins_equal_brute_force(spark, op):
    rng = random.Random(5)
    l = [(k, rng.choice([None, rng.randrange(40), 7])) for k in range(150)]
    r = [(k, rng.choice([None, rng.randrange(40), 7])) for k in range(80)]
    dl, dr = spark.createDataFrame(l, "a int, x int"), spark.createDataFrame(r, "b int, y int")
    ok = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    want = sorted((a, b) for a, x in l for b, y in r if None not in (x, y) and ok(x, y))
    got = J.inequality_join(dl, dr, F.col("x"), op, F.col("y"))
    assert sorted((t.a, t.b) for t in got.collect()) == want
    counts = J.inequality_count(dl, dr, F.col("x"), op, F.col("y"))
    assert {t.a: t.n for t in counts.collect()} == {a: sum(p == a for p, _ in want) for a, _ in l}
    assert "NestedLoop" not in plan_of(got) + plan_of(counts) and "Cartesian" not in plan_of(got) + plan_of(counts)
    none = dr.where("false")
    assert J.inequality_join(dl, none, F.col("x"), op, F.col("y")).count() == 0
    assert {t.n for t in J.inequality_count(dl, none, F.col("x"), op, F.col("y")).collect()} == {0}


@pytest.mark.parametrize("op, left, right", [(">", 3000, 5000), ("<=", 3000, 5000), (">=", 5000, 3000), ("<", 5000, 3000)])
def test_inequality_join_spreads_its_pairs_over_tasks(spark, op, left, right):
    l, r = spark.range(left).select((F.col("id") * 7 % 1000).alias("x"), F.lit(1).alias("a")), spark.range(right).select((F.col("id") * 3 % 1000).alias("y"), F.lit(2).alias("b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for larger tables
    try:
        each = [n for _, n in J.inequality_join(l, r, F.col("x"), op, F.col("y")).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(each) == left * right * (1001 if "=" in op else 999) // 2000  # every number as often on each side
    assert max(each) <= 0.4 * sum(each)


def test_skewed_join_equals_plain_join(spark):
    rng = random.Random(3)
    l = spark.createDataFrame([(rng.choice([1, 1, 1, 2, None, rng.randrange(99)]), k) for k in range(300)], "k int, a int")
    r = spark.createDataFrame([(rng.choice([1, 2, 3, None]), k) for k in range(30)], "j int, b int")
    want = sorted(map(tuple, l.join(r, l.k == r.j).collect()))
    for share in (4, 100, 1):
        assert sorted(map(tuple, J.skewed_join(l, r, "k", "j", slices=share).collect())) == want
    assert J.skewed_join(l.where("false"), r, "k", "j").count() == 0


def test_equi_join_drops_right_key_and_nulls(two):
    _, _, dl, dr = two
    j = J.equi_join(dl, dr, ["x"], ["y"])
    assert j.columns == ["a", "x", "b"] and j.where("x is null").count() == 0
    assert J.equi_join(dl, dr, ["x"], ["y"], keep_right=True).columns == ["a", "x", "b", "y"]


def test_nway_join_keeps_declared_order(spark):
    a, b, c = (spark.createDataFrame([(1, 10), (2, 20)], "k int, v int") for _ in range(3))
    j = J.nway_join({"a": a, "b": b, "c": c}, [({"c", "b"}, F.col("c.k") == F.col("b.k")), ({"a", "c"}, F.col("a.k") == F.col("c.k")), ({"a"}, F.col("a.v") > 10)])
    assert j.columns == ["a_k", "a_v", "b_k", "b_v", "c_k", "c_v"] and [tuple(r) for r in j.collect()] == [(2, 20, 2, 20, 2, 20)]
    with pytest.raises(ValueError):
        J.nway_join({"a": a}, [({"a", "z"}, F.lit(True))])


def test_tumbling_join_end(spark):
    l = spark.sql("select timestamp_seconds(s) as t from values (0), (9), (10) v(s)")
    r = spark.sql("select timestamp_seconds(s) as u from values (10), (5) v(s)")
    pairs = lambda **kw: sorted((x.t.second, x.u.second) for x in J.tumbling_join(l, r, "t", "u", 10, **kw).collect())
    assert pairs() == [(0, 5), (9, 5), (10, 10)]
    assert pairs(end_included=True) == [(0, 5), (0, 10), (9, 5), (9, 10), (10, 10)]


def test_expressions(spark):
    df = spark.sql("select date'2024-01-31' as d, 7 as i, 12.5D as x, '12-345' as p, '3abc' as s, '12.5' as t")
    row = df.select(
        E.divide_int(F.lit(-7), F.lit(2)).alias("q"), E.divide_int(F.lit(1), F.lit(0)).alias("z"), E.date_plus(F.col("d"), "month", 1).cast("string").alias("m"), E.date_int(F.col("d")).alias("di"), E.date_of_int(F.lit(20240131)).cast("string").alias("dd"),
        E.cents(F.col("x")).alias("c"), E.digits(F.col("t")).alias("g"), E.phone_number(F.col("p")).alias("ph"), E.phone_number(F.col("p"), 2).alias("p2"), E.key_of_int_text(F.col("i"), F.col("s")).alias("k"), E.add(F.col("i"), F.lit(1), F.lit(2)).alias("a"), E.col_at(df, 1).alias("at"),
    ).first()
    assert tuple(row) == (-3, None, "2024-02-29", 20240131, "2024-01-31", 1250, 125, 12345, 12, 300000007, 10, 7)


def test_predicates(spark):
    df = spark.sql("select 5 as a, 7 as b, date'2024-01-31' as d, date'2024-02-01' as e, 'xa%by' as s")
    ps = [P.compare(o, F.col("a"), F.col("b")) for o in P.COMPARISONS] + [P.within(F.col("a"), F.col("b"), 2), P.within(F.col("a"), F.col("b"), 2, closed=False), P.within(F.col("d"), F.col("e"), 1, dates=True), P.shifted("less", F.col("a"), F.col("b"), 2), P.like_contains(F.col("s"), "%a%b%"), P.always(False)]
    assert list(df.select(*ps).first()) == [False, True, True, False, False, True, True, False, True, True, False, False]


def test_global_aggregate_of_nothing(spark):
    df = spark.createDataFrame([], "x int")
    assert A.group([], F.sum("x").alias("s"))(df).count() == 0
    assert A.group([], F.sum("x").alias("s"), empty_row=True)(df).count() == 1


@pytest.mark.parametrize("slices", [1, 2, 7])
def test_running_sums_equal_brute_force(spark, slices):
    rng = random.Random(slices)
    rows = [(rng.choice("aab"), rng.randrange(20), k, rng.randrange(-5, 9)) for k in range(120)]
    got = A.running(spark.createDataFrame(rows, "k string, t int, id int, v int"), ["k"], "t", F.col("v"), tie="id", slices=slices)
    total, want = {}, []
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want.append((k, i, total.get(k), total.get(k, 0) + v))
        total[k] = total.get(k, 0) + v
    assert sorted((r.k, r.id, r.old_total, r.new_total) for r in got.collect()) == sorted(want, key=lambda w: (w[0], w[1]))


def test_retractions_sum_to_the_total(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 1)], "k string, t int, v int")
    r = A.retractions(df, ["k"], "t", F.col("v"))
    assert sorted(map(tuple, r.groupBy("k").agg(F.sum(F.col("total") * F.col("multiplicity"))).collect())) == [("a", 11), ("b", 1)]
    assert sorted((x.k, x.t, x.delta) for x in A.deltas(df, ["k"], "t", F.col("v")).collect()) == [("a", 1, 5), ("a", 2, 6), ("b", 1, 1)]


def test_distinct_over_all_and_per_group(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("b", 2)], "g string, x int")
    assert sorted(map(tuple, A.distinct_group(["g"], ["x"], A.count())(df).collect())) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, A.distinct_group(["g"], ["x"], A.count(), over_all=True)(df).collect())) == [("a", 1), ("b", 1)]


def test_row_operators(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "i int, s string")
    assert [tuple(r) for r in R.chain(R.select(lambda t: t.i > 1), R.map_rows(lambda t: (t[0] + 1, t.s)))(df).collect()] == [(3, "c")]
    assert sorted(r.w for r in R.flat_map(lambda t: F.split(t.s, " "), "w")(df).collect()) == ["a", "b", "c"]
    assert R.union(df, df).count() == 4 and R.sample(1.0)(df).count() == 2 and R.sample_for_buckets(10**9, 1)(df).count() <= 2
    with pytest.raises(AttributeError):
        R.select(lambda t: t.missing > 1)(df)
    with pytest.raises(Exception):
        R.select(lambda t: t.i > 1 and t.i < 3)(df)


def test_numbered_windows(spark):
    df = spark.sql("select timestamp_seconds(s) as t from values (0), (9), (10) v(s)")
    assert sorted((r.wid, r.n) for r in Win.numbered_windows(df, "t", 10, A.count()).collect()) == [(1, 2), (2, 3), (3, 1)]
    assert sorted(r.n for r in Win.windowed(df, "t", 10, A.count()).collect()) == [1, 2]


@pytest.mark.parametrize(
    "text, compat, want",
    [
        ("SELECT a, SUM(b) FROM t", False, "SELECT a, SUM ( b )\nFROM t\nGROUP BY a"),
        ("SELECT a, SUM(b) FROM t GROUP BY c LIMIT 3", True, "SELECT a, SUM ( b )\nFROM t\nGROUP BY a"),
        ("SELECT a FROM t WHERE d < {d '1995-01-01'}", False, "SELECT a\nFROM t\nWHERE d < DATE '1995-01-01'"),
        ("SELECT a FROM t WHERE s LIKE '%x%'", True, "SELECT a\nFROM t\nWHERE contains(s, 'x')"),
        ("SELECT f(a) / (b + 1) FROM t", True, "SELECT CAST(CAST(f ( a ) AS DOUBLE) / CAST(( b + 1 ) AS DOUBLE) AS INT)\nFROM t"),
        ("SELECT a * b / c - -1.5e3 FROM t", True, "SELECT CAST(CAST(a * b AS DOUBLE) / CAST(c AS DOUBLE) AS INT) - - 1.5e3\nFROM t"),
        ("SELECT DISTINCT TOP 3 a FROM t LEFT OUTER JOIN u ON t.a = u.b AND t.c = u.d, v", True, "SELECT a\nFROM t JOIN u ON t.a = u.b AND t.c = u.d , v"),
        ("SELECT COUNT(DISTINCT a) AS n, b FROM t WHERE (a = 1 OR NOT b < .5) AND c >= {d '1995-01-01'}", True, "SELECT COUNT ( DISTINCT a ) AS n, b\nFROM t\nWHERE ( a = 1 OR NOT b < .5 ) AND c >= DATE '1995-01-01'\nGROUP BY b"),
        ("SELECT a || 'x' FROM t WHERE b > 1.5e-3", False, "SELECT a || 'x'\nFROM t\nWHERE b > 1.5e-3"),
    ],
)
def test_sql_translation(text, compat, want):
    assert sql.translate(text, compat) == want


@pytest.mark.parametrize("text", ["SELECT a FROM t WHERE a IN (1)", "SELECT a FROM t UNION SELECT a FROM u", "SELECT a FROM (SELECT a FROM t)", "SELECT a FROM t JOIN u ON a < b", "SELECT a FROM t JOIN u ON a = b OR c = d", "SELECT a || b FROM t", "SELECT a + FROM t", "SELECT (a FROM t"])
def test_sql_refusals(text):
    with pytest.raises(ValueError):
        sql.translate(text, compat=True)


def test_three_front_ends_agree(spark):
    c = spark.createDataFrame([(1, "x"), (2, "y")], "k int, seg string")
    o = spark.createDataFrame([(1,), (1,), (2,), (3,)], "ck int")
    src = Sources(spark).register_table("c", c).register_table("o", o)
    src.views("c", "o")
    want = [("x", 2), ("y", 1)]
    assert sorted(map(tuple, sql.run(spark, "SELECT seg, COUNT(*) FROM c JOIN o ON k = ck").collect())) == want
    assert sorted(map(tuple, Stream.source(src, "c").join(Stream.source(src, "o"), lambda t: t.k, lambda t: t.ck).group_by_key(lambda t: 1, lambda t: t.seg).to_df().collect())) == want
    ctx = Context(spark)
    ctx.sources = src
    plan = ctx.plan()
    plan.equi_join(plan.source("c").output_key(0), plan.source("o").output_key(0)).add(A.group(["seg"], A.count()))
    assert sorted(map(tuple, plan.result().collect())) == want
    assert plan.stage("all", plan.source("o"), plan.source("o", "o")).to_df().count() == 8


def test_sources(spark, tmp_path):
    src = Sources(spark)
    with pytest.raises(LookupError):
        src.load("x")
    one, two_ = spark.range(1).toDF("i"), spark.range(2).toDF("i")
    src.register_table("t", one).register_table("t", two_).register_table("t.tbl", one)
    assert src.load("t").count() == 2 and src.load("t", ".tbl").count() == 1
    one.write.parquet(str(tmp_path / "p.parquet"))
    assert src.register_parquet(str(tmp_path)).load("p").count() == 1


def test_schema_text():
    t = parse_schema("# tables\nCUSTOMER [150000:S] ( CUSTKEY LONG [MIN=1] [DISTINCT=150000:S], NAME STRING, D DATE [MAX={d '1998-01-01'}] )\nR (A DOUBLE)", scale=0.1)
    assert list(t) == ["CUSTOMER", "R"] and t["CUSTOMER"].rows == 15000 and t["CUSTOMER"].stats["CUSTKEY"] == {"MIN": 1.0, "DISTINCT": 15000.0}
    assert t["CUSTOMER"].schema["CUSTKEY"].dataType == T.LongType() and t["R"].schema["A"].dataType == T.DoubleType()
    with pytest.raises(ValueError):
        parse_schema("R (A BLOB)")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b|c")], "i int, s string")
    path = str(tmp_path / "out")
    R.chain(K.print_to(path), K.store("stored"), K.materialize(path, rows_per_file=1))(df)
    assert sorted(map(tuple, delimited(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect())) == sorted(map(tuple, spark.sql("select * from stored").collect()))
    (tmp_path / "x.tbl").write_text("1|a|\n2|b|\n")
    assert delimited(spark, str(tmp_path / "x.tbl"), df.schema, trailing=True).count() == 2
    sent = spark.sparkContext.accumulator(0)
    K.publish(lambda rows: sent.add(sum(1 for _ in rows)))(df)
    assert sent.value == 2
    assert K.key_values(df, 1) == ["1 = a", "2 = b|c"]


def test_streams_equal_batch(spark, tmp_path):
    rng = random.Random(1)
    for k in range(3):  # several files, read in several batches
        rows = [(k * 100 + i, k * 4000 + rng.randrange(4000), rng.choice("ab"), 1.0) for i in range(100)]
        spark.createDataFrame(rows, "id long, s int, k string, v double").selectExpr("id", "timestamp_seconds(s) as ts", "k", "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    path = str(tmp_path / "e")
    batch = spark.read.parquet(path)
    events = streaming.events_stream(spark, path, "ts", late="1 hour", files_per_trigger=1)
    got = streaming.finished(streaming.window_totals(events, "ts", 600, F.sum("v").alias("v"), slide=300, keys=["k"]), "complete")
    assert sorted(map(str, got.collect())) == sorted(map(str, Win.windowed(batch, "ts", 600, F.sum("v").alias("v"), slide=300, keys=["k"]).collect()))
    counts = streaming.finished(A.group(["k"], A.count())(streaming.events_stream(spark, path, "ts", late=None, files_per_trigger=1)), "update")
    assert sorted(map(tuple, streaming.latest_by_key(counts, ["k"]).collect())) == sorted(map(tuple, A.group(["k"], A.count())(batch).collect()))
    q = streaming.live(A.group(["k"], A.count())(streaming.events_stream(spark, path, "ts", late=None)), "live_counts", every="1 second")
    ctx = Context(spark)
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.sql("select * from live_counts").collect())) == sorted(map(tuple, A.group(["k"], A.count())(batch).collect()))
        assert "live_counts" in ctx.queries()
    finally:
        assert ctx.stop("live_counts") and not ctx.stop("live_counts")
    signed = streaming.changes_of(counts, ["k"], "n").groupBy("k").agg(F.sum(F.col("n") * F.col("multiplicity")).alias("n"))
    assert sorted(map(tuple, signed.collect())) == sorted(map(tuple, A.group(["k"], A.count())(batch).collect()))
    a = events.where("k = 'a'").select(F.col("id").alias("a"), F.col("ts").alias("t"), F.col("v").alias("x"))
    b = streaming.events_stream(spark, path, "ts", files_per_trigger=1).where("k = 'b'").select(F.col("id").alias("b"), F.col("ts").alias("u"), F.col("v").alias("y"))
    pairs = streaming.finished(streaming.interval_join(a, b, "t", "u", 60, [("x", "y")]))
    ba, bb = batch.where("k = 'a'").select(F.col("id").alias("a"), F.col("ts").alias("t")), batch.where("k = 'b'").select(F.col("id").alias("b"), F.col("ts").alias("u"))
    assert sorted((r.a, r.b) for r in pairs.collect()) == sorted((r.a, r.b) for r in J.sliding_join(ba, bb, "t", "u", 60).collect())


def test_options(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "three.parquet"))
    settings = builder.options(f"# a plan\n\nDIP_DATA_PATH {tmp_path}\nA_PAR 1\nA_PAR 3\nB_PAR 2\nDIP_ACK_EVERY\n")
    assert settings == {"DIP_DATA_PATH": str(tmp_path), "A_PAR": "3", "B_PAR": "2", "DIP_ACK_EVERY": ""}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        context = builder.Context(spark, settings)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        assert context.plan().source("three").to_df().count() == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_publish_every_so_many(spark):
    sent = spark.sparkContext.accumulator(0)
    K.publish(lambda rows: sent.add(sum(1 for _ in rows)), every=10)(spark.range(95).coalesce(1))
    assert sent.value == 10
