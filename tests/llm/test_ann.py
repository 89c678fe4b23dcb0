import numpy as np
from pyspark.sql import functions as F

from lakemill.llm import ann
from lakemill.llm.ann import Index, fit_tree, nearest_neighbours


def _table(spark, vectors, start=0):
    return spark.createDataFrame([(start + k, None if v is None else [None if x is None else float(x) for x in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")


def _brute(vectors, queries, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float32).astype(float)
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in queries:
        a = x[ids.index(q)]
        s = (x * a).sum(axis=1) / (norm * np.sqrt((a * a).sum()))
        out[q] = sorted(((-v, i) for v, i in zip(s, ids, strict=True) if i != q))[:k]
    return out


def test_edges(spark):
    odd = [None, [], [0, 0, 0], [1, None, 2], [float("nan"), 1, 1], [float("inf"), 1, 1], [1, 2]]
    good = [[1, 0, 0], [1, 0.1, 0], [0, 1, 0], [2, 0, 0]]
    got = nearest_neighbours(spark, _table(spark, good + odd), F.lit(True)).toArrow().to_pylist()
    assert {r["query_id"] for r in got} == {0, 1, 2, 3}
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))][:3] == [(1, 3), (2, 1), (3, 2)]
    assert nearest_neighbours(spark, _table(spark, []), F.lit(True)).count() == 0
    assert nearest_neighbours(spark, _table(spark, [[1, 2]]), F.lit(True)).count() == 0


def test_equal_vectors_and_ties(spark):
    rows = [[1, 2, 3]] * 50 + [[3, 2, 1]] * 3
    got = nearest_neighbours(spark, _table(spark, rows), F.col("vec_id") == 49).toArrow().to_pylist()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [0, 1, 2, 3, 4]


def test_recall(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in table.select("vec_id", "embedding").toArrow().to_pylist()}
    got = nearest_neighbours(spark, table, F.col("vec_id") % 50 == 0).toArrow().to_pylist()
    truth = _brute(vectors, [i for i in vectors if i % 50 == 0], 5)
    hits = sum((r["query_id"], r["vec_id"]) in {(q, i) for q, v in truth.items() for _, i in v} for r in got)
    assert hits >= 0.9 * 5 * len(truth)
    exact = {(q, i): -s for q, v in truth.items() for s, i in v}
    assert all(abs(exact[r["query_id"], r["vec_id"]] - r["score"]) < 1e-12 for r in got if (r["query_id"], r["vec_id"]) in exact)


def test_best_bins_visit_every_leaf_once():
    x = np.random.Generator(np.random.PCG64(2)).normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = fit_tree(x, 32)
    found = tree.best_bins(x[0], 10**6)
    assert sorted(found) == list(range(tree.leaves)) and found[0] == tree.place(x[:1])[0]


def test_calibration_widens(spark, data):
    index = Index(spark, spark.read.parquet(f"{data}/embeddings.parquet"), 5)
    queries = index.rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    visits = index.calibrate(queries, 1.0)
    listed = [(r["query_id"], bytes(r["vec"])) for r in queries.collect()]
    assert index.recall(index.search(queries, visits), index.exact(listed)) >= 0.99


def test_chunks_and_blocks_change_nothing(spark, data, monkeypatch):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    ask = lambda: sorted(map(tuple, nearest_neighbours(spark, table, F.col("vec_id") % 10 == 0, recall=1.0).collect()))
    whole = ask()
    monkeypatch.setattr(ann, "CHUNK_ROWS", 7)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    assert ask() == whole
