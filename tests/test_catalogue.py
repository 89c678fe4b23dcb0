"""Every catalogue query against the checking engine on the same tables."""

import os

import pytest

from lakemill.operators import catalogue

duckdb = pytest.importorskip("duckdb")
FOUND = catalogue()


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        at = f"{data}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return con


def _rows(table):
    names = sorted(table.column_names)
    plain = lambda v: ("", 0.0, "") if v is None else ("n", float(v), "") if isinstance(v, int | float) and not isinstance(v, bool) else ("s", 0.0, str(v))
    return sorted(tuple(plain(r[c]) for c in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(FOUND))
def test_matches_oracle(spark, data, oracle, name):
    mine = FOUND[name].run(spark, data).toArrow()
    theirs = oracle.sql(FOUND[name].oracle).to_arrow_table()
    assert sorted(mine.column_names) == sorted(theirs.column_names)
    a, b = _rows(mine), _rows(theirs)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for (k, u, s), (k2, v, s2) in zip(x, y, strict=True):
            assert (k, s) == (k2, s2) and abs(u - v) <= 1e-6 + 1e-9 * abs(u)


def test_pushdown_reaches_the_scan(spark, data):
    plan = FOUND["tpch_q06"].run(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan
    schema = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert "l_comment" not in schema and "l_orderkey" not in schema


def test_topk_is_fused(spark, data):
    assert "TakeOrderedAndProject" in FOUND["topk"].run(spark, data)._jdf.queryExecution().executedPlan().toString()


def test_extract_from_date_reads_all_orders(spark, tmp_path):
    spark.sql("SELECT id AS o_orderkey, TIMESTAMP_NTZ '1995-06-01' + make_dt_interval(CAST(id AS INT)) AS o_orderdate FROM range(2000)").write.parquet(f"{tmp_path}/orders.parquet")
    got = FOUND["extract_from_date"].run(spark, str(tmp_path)).collect()
    assert sorted(r.o_orderkey for r in got) == list(range(2000)) and {r.y for r in got} == set(range(1995, 2001))


def test_date_partitions_hold_the_whole_table(spark, tmp_path):
    from lakemill.operators import scans

    spark.sql("SELECT id AS o_orderkey, TIMESTAMP_NTZ '1995-01-01' + make_dt_interval(CAST(id % 40 AS INT)) AS o_orderdate FROM range(200)").write.parquet(f"{tmp_path}/orders.parquet")
    got = scans._by_day(spark, str(tmp_path))
    assert dict(got.dtypes) == {"o_orderkey": "bigint", "day": "date"} and len(got.inputFiles()) >= 40
    want = spark.sql("SELECT id, DATE '1995-01-01' + CAST(id % 40 AS INT) FROM range(200)").collect()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_null_keys_join_over_the_whole_table(spark, tmp_path):
    spark.sql("SELECT id AS p_partkey, CAST(id % 50 + 1 AS INT) AS p_size FROM range(1, 601)").write.parquet(f"{tmp_path}/part.parquet")
    got = FOUND["join_null_keys"].run(spark, str(tmp_path)).collect()
    size = lambda key: key % 50 + 1
    want = [(a, b) for a in range(1, 601) for b in range(1, 601) if size(a) == size(b) > 25]
    assert sorted(map(tuple, got)) == want
