import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakemill.llm.language import fold
from lakemill.llm.toxicity import COUNTS, VOTERS, fit_label_model, learn_lexicons, op3_score_toxicity, score_toxicity, votes


def test_label_model_finds_accuracies_and_pairs():
    random = np.random.Generator(np.random.PCG64(1))
    y = random.random(20_000) < 0.3
    hit = lambda p, q: np.where(y, random.random(len(y)) < p, random.random(len(y)) < q)
    a, b, c = hit(0.9, 0.05), hit(0.8, 0.1), hit(0.6, 0.2)
    vote = np.stack([a, b, c, c], axis=1) * 2 - 1
    patterns, inverse, count = np.unique(vote, axis=0, return_inverse=True, return_counts=True)
    model = fit_label_model(patterns, count.astype(float))
    assert (2, 3) in model.blocks
    assert abs(model.prior - 0.3) < 0.05
    assert ((model.posterior(patterns)[inverse.ravel()] > 0.5) == y).mean() > 0.9


def test_every_feature_told_apart_is_used():
    n = 9000
    seen = [1000] * (n - 1) + [6, 100_000]
    table = pa.table({"feature": [*range(n), -1]} | {c: seen if c.startswith("n1") else [100] * (n - 1) + [0, 100_000] for c in COUNTS})
    lex = learn_lexicons(table)
    used = lex.index[:n]
    assert (used >= 0).sum() == n - 1 + (lex.ratio[0, n - 1] != 0) and len(set(used[used >= 0])) == (used >= 0).sum()


def test_shouting_is_a_share_of_the_letters_at_every_length():
    lex = learn_lexicons(pa.table({"feature": [-1]} | {c: [1] for c in COUNTS}))
    strides = "".join("a" if k % 4 == 0 else "B" for k in range(1600))
    texts = ["GO AWAY NOW", "go away", "A" * 240 + "b" * 559, "A" * 500 + "b" * 299, strides, strides.swapcase(), "ÉÀÜ ЖЩ", "12 !?", "", None]
    vote, _, _ = votes(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), lex)
    assert vote[:, VOTERS.index("shouting")].tolist() == [1, 0, 0, 1, 1, 0, 1, 0, 0, 0]


def test_edges(spark, nasty, empty):
    labels = spark.createDataFrame([(18, 1), (0, 0), (None, 1), (3, None), (18, 1)], "doc_id long, toxic int")
    got = score_toxicity(spark, nasty, labels, F.lit(True)).toArrow().to_pylist()
    assert len(got) == 21 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in score_toxicity(spark, nasty, none, F.lit(True)).toArrow().to_pylist()}
    assert got[18] == max(got.values())
    assert score_toxicity(spark, empty, none, F.lit(True)).count() == 0


def test_held_out(spark):
    at = "/root/testdata/sf0.01"
    try:
        labels = spark.read.parquet(f"{at}/labels.parquet")
    except Exception:
        pytest.skip("no test tables")
    got = op3_score_toxicity(spark, at).join(labels, "doc_id").where("held_out").toArrow().to_pylist()
    toxic, clean = [r["score"] for r in got if r["toxic"]], [r["score"] for r in got if not r["toxic"]]
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in clean] for a in toxic])
    assert auc > 0.8 and np.mean(np.array(clean) < 0.5) > 0.95
    assert {r.held_out for r in spark.range(50).withColumnRenamed("id", "doc_id").select((fold(5) == 0).alias("held_out")).collect()} == {True, False}
