import numpy as np
from pyspark.sql import functions as F

from lakemill.llm.language import fit_temperature, identify, ngram_counts, op7_identify_language


def test_ngrams_of_slices_are_those_of_the_whole(monkeypatch):
    from lakemill.llm import language

    text = "Der Fluß fließt, 12 Brücken! " * 50
    whole = ngram_counts(text)
    monkeypatch.setattr(language, "_SPAN", 101)
    found, counts = ngram_counts(text)
    assert len(np.setdiff1d(whole[0], found)) == 0
    assert len(ngram_counts(None)[0]) == len(ngram_counts("12 .!? 😀")[0]) == 0


def test_temperature():
    random = np.random.Generator(np.random.PCG64(3))
    logits = random.normal(size=(3000, 3))
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    y = np.array([random.choice(3, p=q) for q in p])
    assert abs(fit_temperature(3 * logits, y) - 3) < 0.4


def test_edges(spark, nasty, empty):
    got = identify(spark, nasty, F.lit(True)).toArrow().to_pylist()
    assert len(got) == 21
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["lang_score"] <= 1
    assert identify(spark, empty, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in identify(spark, nasty, F.lit(False)).toArrow().to_pylist()} == {"und"}


def test_every_language_is_learned(spark):
    names = [f"l{k:03d}" for k in range(230)]
    rows = []
    for k, name in enumerate(names):
        word = "".join(chr(0x4E00 + 5 * k + j) for j in range(5))
        rows += [(len(rows) + i, " ".join([word, word[i % 3 :], word]), name) for i in range(1 if k == 229 else 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(spark, docs, F.lit(True)).toArrow().to_pylist()
    assert {r["lang_pred"] for r in got} == set(names)
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_held_out(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    got = op7_identify_language(spark, data).join(docs, "doc_id").where("held_out").toArrow().to_pylist()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_clashing_names(spark, nasty):
    from lakemill.llm.language import fold, identify

    docs = nasty.selectExpr("*", "'old' AS lang_pred", "1 AS _order")
    out = identify(spark, docs, fold(4) != 2)
    assert out.columns == [*nasty.columns, "_order", "lang_pred", "lang_score"] and "old" not in {r[0] for r in out.select("lang_pred").collect()}
