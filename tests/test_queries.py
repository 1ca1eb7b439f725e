import os

import pytest

from rivulet.plans import records, relational
from tests.oracle import DATA, check

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
ALL = {**relational.QUERIES, **records.QUERIES}
SQL = {**relational.ORACLE, **records.ORACLE}


@pytest.mark.parametrize("name", ALL)
def test_query_equals_sql(spark, name):
    assert name in SQL
    check(spark, ALL[name], SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0


def test_reachability_over_all_arcs(spark):
    arcs = {(r.l_partkey, r.l_suppkey) for r in spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    out: dict = {}
    for a, b in arcs:
        out.setdefault(a, []).append(b)
    paths = {a: sum(len(out.get(c, ())) for b in out[a] for c in out.get(b, ())) for a in out}
    assert dict(ALL["reachability_3hop_arcs"](spark, DATA).select("a", "n").collect()) == {a: n for a, n in paths.items() if n}


def test_band_checksum_is_summed_in_more_than_a_bigint(spark, tmp_path):
    """Sums on the way may pass a bigint, as in the SQL; a checksum that passes it is an error in both."""
    import duckdb

    def put(signs):
        spark.createDataFrame([(sign * 4_000_000_000, 3) for sign in signs] + [(None, 3), (5, None)], "s_suppkey bigint, s_nationkey int").write.mode("overwrite").parquet(f"{tmp_path}/supplier.parquet")
        spark.createDataFrame([(2_000_000_000, 4), (None, 2), (7, 9)], "c_custkey bigint, c_nationkey int").write.mode("overwrite").parquet(f"{tmp_path}/customer.parquet")

    sql = SQL["join_band_int"]
    for t in ("supplier", "customer"):
        sql = sql.replace(f"{'from' if t == 'supplier' else 'join'} {t} ", f"{'from' if t == 'supplier' else 'join'} '{tmp_path}/{t}.parquet/*.parquet' ")
    put([1] * 30 + [-1] * 29)
    want = duckdb.sql(sql).fetchall()
    assert [tuple(r) for r in ALL["join_band_int"](spark, str(tmp_path)).select("n", "checksum").collect()] == want == [(120, 8 * 10**18)]
    put([1, 1])
    with pytest.raises(duckdb.ConversionException):
        duckdb.sql(sql).fetchall()
    with pytest.raises(Exception, match="OVERFLOW"):
        ALL["join_band_int"](spark, str(tmp_path)).collect()
