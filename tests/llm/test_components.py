import numpy as np
import pyarrow as pa
import pytest

from lakemill.llm import components, store
from lakemill.llm.components import connected_components
from lakemill.llm.store import Workspace


def test_chain_star_and_ring(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 9)] + [(201, 200), (202, 201), (200, 202)] + [(5, 5)]
    got = dict(map(tuple, connected_components(Workspace(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[k] == 0 for k in range(41)) and all(got[100 + k] == 100 for k in range(9)) and {got[k] for k in (200, 201, 202)} == {200}


def test_none(spark):
    assert connected_components(Workspace(spark, "test"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_ids_near_the_ends_and_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(store, "HOT", 3)
    top = (1 << 63) - 1
    edges = [(top, top - 1), (top - 1, top - 2), (-top - 1, -top), (-top, 5), (-top - 1, top - 9)] + [(top - 2, top - 20 - k) for k in range(30)]
    got = dict(map(tuple, connected_components(Workspace(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[k] for k in (5, -top, -top - 1, top - 9)} == {-top - 1} and {got[k] for k in (top, top - 1, top - 2, top - 49)} == {top - 49}


def _joined(edges):
    low = {x: x for e in edges for x in e}
    while True:
        new = dict(low)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            return low
        low = new


def test_random_edges_over_partitions(spark):
    random = np.random.Generator(np.random.PCG64(11))
    edges = [tuple(map(int, e)) for e in random.integers(0, 700, (450, 2))] + [(1000 + k, 1001 + k) for k in random.permutation(80).tolist()]
    got = connected_components(Workspace(spark, "test"), spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()
    expected = _joined([e for e in edges if e[0] != e[1]])
    assert dict(map(tuple, got)) == expected and len(got) == len(expected)


def test_contraction_keeps_components(monkeypatch):
    monkeypatch.setattr(components, "CONTRACTED", 40)
    random = np.random.Generator(np.random.PCG64(12))
    edges = random.integers(-(1 << 62), 1 << 62, 300)[random.integers(0, 300, (260, 2))]
    batches = [pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"]) for x in np.array_split(edges, 13)]
    out = list(components._contract(iter(batches)))
    found = [tuple(e.values()) for batch in out for e in batch.to_pylist()]
    assert len(out) == 7 and all(a < b for a, b in found)
    expected = _joined([(a, b) for a, b in edges.tolist() if a != b])
    assert _joined(found) == expected


def _jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().nextJobId()


def test_stars_end_without_a_round(spark):
    """Edges that a task sees whole are stars at once, and no further round is run to find that nothing changes."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long").coalesce(1)
    before = _jobs(spark)
    assert connected_components(Workspace(spark, "test"), edges).count() == 61
    assert _jobs(spark) - before < 20


@pytest.mark.parametrize(("many", "broadcasts"), [([1] * 3000, 0), ([700, 800], 1), ([5000, 1, 1], 2)])
def test_hot_join_leaves_out_sides_without_keys(spark, many, broadcasts):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ws = Workspace(spark, "test")
        keyed = ws.put(spark.createDataFrame([(k, n, -k) for k, n in enumerate(many)], "k long, many long, value long"), "keyed")
        rows = ws.put(keyed.selectExpr("k", "explode(sequence(1L, many)) AS i"), "rows")
        joined = store.join_hot(rows, keyed, ["k"], "many")
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("BroadcastHashJoin") == broadcasts
        assert sorted(map(tuple, joined.select("k", "i", "value").collect())) == [(k, i + 1, -k) for k, n in enumerate(many) for i in range(n)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
