"""Joins whose keys repeat on both sides: the same rows, no pair made to be counted, none of the rest in few tasks."""

import pytest
from pyspark.sql import functions as F

from lakemill.api import Engine
from lakemill.operators import catalogue
from lakemill.plans import pairs

duckdb = pytest.importorskip("duckdb")


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 16)
    monkeypatch.setattr(pairs, "CELLS", 4)


def _joined(frame):
    """Most rows that a join of an executed plan made."""
    most = 0

    def walk(node):
        nonlocal most
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if "Join" in kind:
            most = max(most, node.metrics().get("numOutputRows").get().value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(frame._jdf.queryExecution().executedPlan())
    return most


def test_pairs_are_counted_unlisted(spark, tmp_path):
    spark.sql("SELECT id AS p_partkey, CAST(CASE WHEN id % 7 > 0 THEN id % 50 END AS INT) AS p_size FROM range(5000)").write.parquet(f"{tmp_path}/part.parquet")
    got = catalogue()["join_duplicate_keys"].run(spark, str(tmp_path))
    sizes = [k % 50 for k in range(5000) if k % 7]
    assert got.collect()[0].pairs == sum(sizes.count(x) ** 2 for x in range(50))
    assert _joined(got) <= 50
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in got.schema] == [("pairs", "bigint", False)]


TEXTS = [
    "SELECT COUNT(*) AS n, COUNT(*) AS m FROM {a} a JOIN {b} b ON a.k = b.j WHERE a.x > b.y",
    "SELECT COUNT(*) AS n FROM {a} a JOIN {b} b ON a.k = b.j WHERE a.i < b.h AND a.i <> 3",
    "SELECT a.k AS g, COUNT(*) AS n FROM {a} a JOIN {b} b ON a.k = b.j GROUP BY a.k",
    "SELECT b.h AS g, COUNT(*) AS n FROM {a} a JOIN {b} b ON b.j = a.k GROUP BY g HAVING COUNT(*) > 3 ORDER BY n DESC, g LIMIT 4",
    "SELECT a.i, SUM(b.h) AS s FROM {a} a JOIN {b} b ON a.k = b.j GROUP BY a.i",
    "SELECT COUNT(*) AS n FROM {a} a JOIN {b} b ON a.k = b.j WHERE a.i > 1000",
    "SELECT * FROM {a} a JOIN {b} b ON a.k = b.j",
    "SELECT i, h FROM {a} a JOIN {b} b ON b.j = a.k WHERE a.x < b.y AND a.i >= b.h",
    "SELECT i, h FROM {a} a JOIN {b} b ON a.x = b.y",
    "SELECT i, y FROM {a} a JOIN {b} b ON a.k = b.j WHERE b.y + 9e0 <= a.x AND a.i < 5 ORDER BY i, y LIMIT 100",
    "SELECT a.i, b.i AS o FROM {a} a JOIN {a} b ON a.k = b.k WHERE a.x > b.x",
]


@pytest.mark.parametrize(("text", "rows"), [*((t, 400) for t in TEXTS), (TEXTS[0], 0), (TEXTS[7], 0)])
def test_same_rows_as_sql(spark, tmp_path, small, text, rows):
    special = "CASE id % 11 WHEN 0 THEN NULL WHEN 1 THEN DOUBLE('NaN') WHEN 2 THEN -0.0D WHEN 3 THEN 0.0D WHEN 4 THEN DOUBLE('Infinity') ELSE DOUBLE(id % 13) END"
    spark.sql(f"SELECT CASE WHEN id % 5 > 0 THEN CONCAT('k', CASE WHEN id % 3 = 0 THEN id ELSE 1 END) END AS k, {special} AS x, id % 8 AS i FROM range({rows})").write.parquet(f"{tmp_path}/a")
    spark.sql(f"SELECT CONCAT('k', id % 4) AS j, {special} AS y, id % 6 AS h FROM range({rows // 2})").write.parquet(f"{tmp_path}/b")
    said = text.format(a=f"read_parquet('{tmp_path}/a')", b=f"read_parquet('{tmp_path}/b')")
    got = Engine(spark).sql(said, repeated_keys=True)
    plain = Engine(spark).sql(said)
    theirs = duckdb.sql(text.format(a=f"'{tmp_path}/a/*.parquet'", b=f"'{tmp_path}/b/*.parquet'")).fetchall()
    told = lambda found: sorted(tuple(map(repr, (0.0 if v == 0 else v for v in row))) for row in found)
    assert got.schema.simpleString() == plain.schema.simpleString()
    assert told(got.collect()) == told(theirs) == told(plain.collect())


def _shares(frame):
    """Rows of a result and those of the task that makes most."""
    found = [r["count"] for r in frame.groupBy(F.spark_partition_id().alias("at")).count().collect()]
    return sum(found), max(found)


def test_pairs_of_few_keys_are_dealt_out(spark, tmp_path, small):
    spark.sql("SELECT id AS p_partkey, CAST(IF(id % 3 = 0, NULL, 25 + id % 3) AS INT) AS p_size FROM range(900)").write.parquet(f"{tmp_path}/part.parquet")
    got = catalogue()["join_null_keys"].run(spark, str(tmp_path))
    total, most = _shares(got)
    assert total == 2 * 300**2 and most < total / 10
    assert sorted(map(tuple, got.collect())) == [(a, b) for a in range(900) for b in range(900) if a % 3 == b % 3 > 0]


def test_compared_pairs_are_narrowed_and_dealt_out(spark, tmp_path, small):
    spark.sql("SELECT id AS s_suppkey, CAST(id % 2 AS INT) AS s_nationkey, DOUBLE(id * 25) AS s_acctbal FROM range(400)").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("SELECT id AS c_custkey, CAST(id % 2 AS INT) AS c_nationkey, DOUBLE(id * 5) - 999 AS c_acctbal FROM range(2000)").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalogue()["join_post_filter"].run(spark, str(tmp_path))
    want = [(s, c) for s in range(400) for c in range(2000) if s % 2 == c % 2 and s * 25 > c * 5 - 999 + 9000]
    total, most = _shares(got)
    assert total == len(want) and most < total / 4
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(s_acctbal,8001.0)" in plan and "c_acctbal" in plan.split("< 9975.0")[0]
