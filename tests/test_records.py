"""Wide tables, quarantine, history and eager aggregation on small fixtures."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from rivulet.functions import spellings as S
from rivulet.operators import eager, history, quarantine, wide

LOG = "c0 bigint, c1 bigint, c2 string, c3 string, c4 int, arrival bigint"
NAMES = {i: base64.b64encode(bytes([i]) * 32).decode() for i in range(1, 5)}
KINDS = {1: "integer", 2: "real", 3: "boolean", 4: "hash"}


def types(spark):
    return spark.createDataFrame([(i, NAMES[i], KINDS[i]) for i in NAMES], "attr_id int, attr_name string, value_type string")


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def found(spark, rows):
    t = types(spark)
    return {(r[0], r[1]): r[2] for r in wide.cells(wide.wide_table(log(spark, rows), t, fan_in=2), S.catalogue(t)).collect()}


@pytest.mark.parametrize(
    "kind, spelled, value",
    [
        ("integer", ' "007" ', "7"), ("integer", "-4.00", "-4"), ("integer", "57.", "57"), ("integer", "1,259", "1259"), ("integer", "+4", "4"), ("integer", "1e3", "1000"), ("integer", "3.7", None), ("integer", "1;2", None), ("integer", "4x", None), ("integer", "", None), ("integer", "12,34", None), ("integer", "-0", "0"),
        ("real", "5.000e+00", "5.0"), ("real", ".250", "0.25"), ("real", "+2", "2.0"), ("real", "0.5.1", None), ("real", "NaN", None), ("real", "Infinity", None), ("real", "-0.0", "0.0"), ("real", "1,259.5", "1259.5"),
        ("boolean", " TRUE", "true"), ("boolean", "N", "false"), ("boolean", "1", "true"), ("boolean", "2", None), ("boolean", "tru e", None),
        ("hash", NAMES[1].rstrip("="), NAMES[1]), ("hash", NAMES[4].replace("+", "-").replace("/", "_"), NAMES[4]), ("hash", "02" * 32, NAMES[2]), ("hash", "short", None), ("hash", None, None),
    ],
)
def test_spellings(spark, kind, spelled, value):
    df = spark.createDataFrame([(spelled, kind)], "c string, t string")
    assert df.select(S.value_text(F.col("c"), F.col("t"))).first()[0] == value


def test_catalogue_limit(spark):
    with pytest.raises(ValueError):
        S.catalogue(types(spark), limit=3)


def test_wide_last_usable_statement_decides(spark):
    rows = [
        (5, 1, NAMES[1], "10", 0, 1), (5, 1, NAMES[1], "11", 0, 2),  # one moment: the last received
        (9, 1, NAMES[1], "x", 0, 3),  # unusable
        (7, 1, f'"{NAMES[2]}"', "2.5", 0, 4), (8, 1, NAMES[2], None, 1, 5),  # deleted
        (1, 2, NAMES[3], "yes", None, 6), (1, 2, NAMES[4].rstrip("="), NAMES[2], 0, 7),
        (1, 3, "unknown", "1", 0, 8), (1, None, NAMES[1], "1", 0, 9), (None, 4, NAMES[1], "1", 0, 10), (1, 2, None, "1", 0, 11),
    ]
    assert found(spark, rows) == {(1, 1): "11", (2, 3): "true", (2, 4): NAMES[2]}
    w = wide.wide_table(log(spark, rows).withColumn("a1", F.lit("clash")), types(spark))
    assert dict(w.dtypes) == {"c1": "bigint", "a1": "decimal(38,0)", "a2": "double", "a3": "boolean", "a4": "string"}
    assert sorted(r[0] for r in w.select("c1").collect()) == [1, 2, 3]


def test_wide_empty(spark):
    assert found(spark, []) == {}
    none = types(spark).where("false")
    assert wide.cells(wide.wide_table(log(spark, [(1, 1, NAMES[1], "1", 0, 1)]), none), []).count() == 0


def brute_history(rows):
    usable = {}
    by_name = {n: i for i, n in NAMES.items()}
    for c0, c1, c2, c3, c4, arrival in rows:
        if c2 in by_name and (c4 == 1 or (c3 or "").lstrip("-").isdigit()):
            k = (c1, by_name[c2], c0)
            if k not in usable or usable[k][0] < arrival:
                usable[k] = (arrival, None if c4 == 1 else c3)
    out, held = [], {}
    for (c1, a, c0), (_, v) in sorted(usable.items()):
        now = held.get((c1, a))
        if (now[0] if now else None) == v:
            continue
        if now:
            out.append((c1, a, now[1], c0))
        held[c1, a] = (v, c0) if v is not None else None
    return sorted(out + [(c1, a, s, -1) for (c1, a), now in held.items() if now for _, s in [now]])


@pytest.mark.parametrize("seed, machines", [(1, 3), (2, 150), (3, 1)])
def test_history_equals_brute_force(spark, seed, machines):
    rng = random.Random(seed)
    rows = [(rng.randrange(60), rng.randrange(machines), NAMES[1], rng.choice(["1", "2", "3", "x", None]), int(rng.random() < 0.2), k) for k in range(500)]
    sats = history.satellites(log(spark, rows), types(spark), fast_rate=1.0, slices=5)
    got = history.versions(sats["fast"]).unionByName(history.versions(sats["slow"])).select("c1", "attr_id", "valid_from", "valid_to")
    assert sorted(map(tuple, got.collect())) == brute_history(rows)


def test_history_empty(spark):
    sats = history.satellites(log(spark, []), types(spark))
    assert history.versions(sats["fast"]).count() == history.versions(sats["slow"]).count() == 0


def test_history_append(spark):
    first = [(1, 1, NAMES[1], "5", 0, 1), (2, 1, NAMES[1], "5", 0, 2)]
    later = [(3, 1, NAMES[1], "5", 0, 3), (4, 1, NAMES[1], "6", 0, 4), (5, 1, NAMES[1], None, 1, 5)]
    sat = history.changes(log(spark, first), types(spark))
    both = sat.unionByName(history.appended(sat, log(spark, later), types(spark)))
    assert sorted(map(tuple, history.versions(both).select("c1", "attr_id", "valid_from", "valid_to").collect())) == brute_history(first + later)
    gone = history.appended(sat, log(spark, [(7, 1, NAMES[1], None, 1, 9)]), types(spark))
    assert [(r.valid_from, r.hash_diff) for r in gone.collect()] == [(7, None)]


def test_history_of_hot_entities_is_even_work(spark):
    """One entity with 60 % of the rows, one with 0.9 %: no task has over twice the median, and there are few files."""
    rng = random.Random(7)
    n = 20000
    machine = lambda k: 1 if k % 1000 < 600 else 2 if k % 1000 < 609 else rng.randrange(10, 3000)
    rows = [(k * k // 50, machine(k), NAMES[1 + k % 4], "1" if k % 4 < 3 else NAMES[1], 0, k) for k in range(n)]
    kept = log(spark, rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cut = history.Slices(kept, 8 * 4)
        stated = cut.added(history.statements(kept, S.catalogue(types(spark))))
        salt = F.pmod(F.xxhash64("c1", "slice"), history._salts(kept, S.catalogue(types(spark)), cut.rows))
        sizes = sorted(r[1] for r in stated.repartition("attr_id", salt).groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == n and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        per_slice = stated.where("c1 = 1").groupBy("slice").count().agg(F.max("count"), F.count("*")).first()
        assert per_slice[0] <= 2 * cut.rows and per_slice[1] >= 16
        assert stated.where("c1 = 2").select("slice").distinct().count() == 1  # 180 rows, less than a slice
        sats = history.satellites(kept, types(spark))
        files = {f for s in sats.values() for f in s.inputFiles()}
        assert len(files) <= 4 * (8 + 1)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_history_append_to_slices(spark):
    first = [(k, 1, NAMES[1], str(k // 7 % 3), 0, k) for k in range(400)]
    later = [(k, 1, NAMES[1], str(k // 5 % 3), int(k % 50 == 0), k) for k in range(400, 700)]
    sat = history.changes(log(spark, first), types(spark), slices=8)
    both = sat.unionByName(history.appended(sat, log(spark, later), types(spark)))
    assert sorted(map(tuple, history.versions(both).select("c1", "attr_id", "valid_from", "valid_to").collect())) == brute_history(first + later)


RAW = "rec_id bigint, feed string, line string"
ORDER = '5|7|O|10.50|1996-02-29|A|Desk|0|"a | ""b"" \n c"|'


@pytest.mark.parametrize(
    "feed, line, reason",
    [
        ("orders", ORDER, None), ("orders", ORDER[:-1], "column_count"), ("orders", ORDER.replace("1996-02-29", "1997-02-29"), "bad_value"), ("orders", ORDER.replace("10.50", "1O"), "bad_value"), ("orders", ORDER.replace("Desk", ""), "bad_value"), ("orders", '5|7|O|1|1996-02-29|A|Desk|0||', None), ("orders", ORDER.replace("Desk", 'De"sk'), "quoting"), ("orders", ORDER.replace("Desk", '"Desk'), "quoting"), ("orders", ORDER.replace("Desk", '""Desk""'), "quoting"), ("orders", ORDER.replace("Desk", '""'), "bad_value"), ("orders", "", "column_count"), ("orders", None, "column_count"), ("orders", '"', "quoting"),
        ("machine_attributes", f'1,2,"{NAMES[1]}",3,0', None), ("machine_attributes", f"1,2,{NAMES[1]},,1", None), ("machine_attributes", f"1,2,{NAMES[1]},x,1", "bad_value"), ("machine_attributes", f"1,2,{NAMES[1]},3,2", "bad_value"), ("machine_attributes", f"1.5,2,{NAMES[1]},3,0", "bad_value"), ("machine_attributes", f"1,2,{NAMES[1]},3,0,", "column_count"), ("machine_attributes", "1,2,other,3,0", "bad_value"),
        ("lineitems", "1|2|3|4|5.0|6.0|0.1|0.2|N|O|1995-01-01|1995-01-01|1995-01-01|A|B||", None), ("other", "x", "unknown_feed"), (None, "x", "unknown_feed"),
        ("orders", ORDER.replace("Desk", '"' + 'x""' * 40000 + '"'), None), ("orders", "|" * 100000, "column_count"), ("orders", '"' * 100001, "quoting"),
    ],
)
def test_quarantine_reason(spark, feed, line, reason):
    raw = spark.createDataFrame([(1, feed, line)], RAW).withColumn("d", F.lit("clash")).withColumn("f", F.lit(0))
    got = [r.reason for r in quarantine.rejected(raw, types(spark)).collect()]
    assert got == ([] if reason is None else [reason])


def test_quarantine_keeps_repeated_and_null_ids(spark):
    good, bad = ORDER, ORDER[:-1]
    raw = spark.createDataFrame([(1, "orders", good), (1, "orders", bad), (None, "orders", bad), (None, "orders", good), (2, "orders", bad), (2, "orders", bad)], RAW)
    assert sorted((r.rec_id or 0, r.reason) for r in quarantine.rejected(raw, types(spark)).collect()) == [(0, "column_count"), (1, "column_count"), (2, "column_count"), (2, "column_count")]
    row = quarantine.load(raw.where("rec_id = 1"), "orders", types(spark)).first()
    assert (row.orderkey, row.totalprice, str(row.orderdate), row.comment) == (5, 10.5, "1996-02-29", 'a | "b" \n c')
    assert quarantine.rejected(raw.where("false"), types(spark)).count() == 0


def test_eager_join_equals_plain_join(spark):
    rng = random.Random(4)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3, None]), rng.choice("ab"), rng.randrange(9)) for _ in range(200)], "k int, g string, x int")
    right = spark.createDataFrame([(rng.choice([1, 1, 2, 4, None]), rng.choice([1, 2, None])) for _ in range(150)], "k int, y int")
    l = eager.compact(left, {"k": F.col("k")}, {"g": F.col("g")}, {"x": F.col("x")}, n="ln")
    r = eager.compact(right, {"k": F.col("k")}, sums={"y": F.col("y")}, n="rn")
    got = eager.join_states(l, r, ["k"], ["g"], ["x"], ["y"])
    want = left.join(right, "k").groupBy("g").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_heavy_keys(spark):
    df = spark.createDataFrame([(1,)] * 5 + [(2,)] * 4 + [(None,)] * 30 + [(k,) for k in range(10, 71)], "k int")
    assert [tuple(r) for r in eager.heavy_keys([("t", "k", df)]).collect()] == [("t", "k", "1")]  # 5 of 100 rows
    assert eager.heavy_keys([("t", "k", df.where("false"))]).count() == 0


def test_loaded_values_are_typed(spark):
    names = [base64.b64encode(bytes([k] * 32)).decode() for k in range(4)]
    types = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(zip(names, ("integer", "real", "boolean", "hash")))], "attr_id int, attr_name string, value_type string")
    values = ["+57.", "1.5e1", "Yes", base64.urlsafe_b64encode(b"\xff" * 32).decode().rstrip("="), "", "3.7"]
    raw = spark.createDataFrame([(k, "machine_attributes", f"{k},1,{names[k % 4]},{v},0") for k, v in enumerate(values[:5])] + [(5, "machine_attributes", f"5,1,{names[0]},{values[5]},0")], "rec_id long, feed string, line string")
    got = quarantine.with_values(quarantine.load(raw, "machine_attributes", types), types).orderBy("rec_id").select("rec_id", "c3_integer", "c3_real", "c3_boolean", "c3_hash").collect()
    assert [tuple(r) for r in got] == [(0, 57, None, None, None), (1, None, 15.0, None, None), (2, None, None, True, None), (3, None, None, None, "/" * 42 + "8="), (4, None, None, None, None)]
