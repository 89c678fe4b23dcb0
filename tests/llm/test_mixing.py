import pytest
from pyspark.sql import functions as F

from lakemill.llm.mixing import OP6_SQL, mix_documents, op6_mix_sources, plan_mix


def test_targets(spark):
    rows = [(i, s, " ".join(["w"] * 10)) for s, n in (("a", 30), ("b", 300), ("c", 5), (None, 100)) for i in range(len(s or "zz") * 1000 + ord((s or "n")[0]) * 1000, len(s or "zz") * 1000 + ord((s or "n")[0]) * 1000 + n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = plan_mix(spark, docs).toArrow().to_pylist()
    by = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        s = by.setdefault(r["source"], {"taken": 0, "target": r["target"], "size": r["source_size"]})
        s["taken"] += r["taken"]
    total = sum(s["size"] for s in by.values())
    assert abs(sum(s["target"] for s in by.values()) - total) < 1e-6
    assert by["a"]["target"] == 900 and by["c"]["target"] == 150
    assert all(abs(s["taken"] - s["target"]) <= 1 for s in by.values())


def test_edges(spark, nasty, empty):
    a, b = (sorted(map(str, plan_mix(spark, nasty).toArrow().to_pylist())) for _ in range(2))
    assert a == b and len(a) == 21
    assert plan_mix(spark, empty).count() == 0 and mix_documents(spark, empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "x", "")], "doc_id long, source string, text string")
    assert all(r["target"] == 0 and r["taken"] == 0 for r in plan_mix(spark, blank).toArrow().to_pylist())


def test_mixed_corpus_holds_the_plan(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = {r["doc_id"]: r["taken"] for r in plan_mix(spark, docs).toArrow().to_pylist()}
    mixed = mix_documents(spark, docs)
    assert mixed.columns == docs.columns
    words = mixed.groupBy("doc_id").agg(F.sum(F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in words if r.n} == {i: n for i, n in plan.items() if n}
    assert mixed.where("n_chars <> length(text)").count() == 0


def test_against_sql(spark, data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken", "virtual_finish"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({OP6_SQL}) ORDER BY ALL").fetchall()
    assert sorted(tuple(r[n] for n in names) for r in op6_mix_sources(spark, data).toArrow().to_pylist()) == want


def test_clashing_names_and_repeated_ids(spark):
    from pyspark.sql import functions as F

    from lakemill.llm.mixing import mix_documents, word_count

    names = ["doc_id", "text", "source", "n_chars", "_row", "_id", "_words", "_finish", "_body", "_tail", "_copy", "cell"]
    rows = [(k % 4 if k % 5 else None, " ".join(["w"] * (k % 7)), "ab"[k % 2], 1, *["x"] * 8) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names[4:]))
    out = mix_documents(spark, docs)
    assert out.columns == names and {r[0] for r in out.select("_tail").distinct().collect()} == {"x"}
    total = lambda d: d.agg(F.sum(word_count(F.col("text")))).first()[0]
    # a source's target is cut to whole words
    assert 0 <= total(docs) - total(out) < 2
