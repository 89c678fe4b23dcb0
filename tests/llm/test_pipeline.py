import zlib

import numpy as np
import public_tokenizers
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    first = docs.toArrow().to_pylist()
    tables = []
    from lakemill.llm.store import Workspace

    ws = Workspace(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        docs = ws.put(stage(spark, docs, data), name)
        tables.append(docs)
    assert all(t.columns == ["doc_id", "text", "lang", "source", "n_chars"] for t in tables[:-1])
    identified, kept, replaced, mixed, packed = (t.toArrow().to_pylist() for t in tables)
    letters = {r["doc_id"] for r in first if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in identified} <= letters and len(identified) > 0.95 * len(letters)
    assert {r["doc_id"] for r in replaced} == {r["doc_id"] for r in kept} and not any("example.com" in (r["text"] or "") for r in replaced)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = []
    for r in mixed:
        ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(r["doc_id"], s, zlib.crc32(ids[s : s + 1024].tobytes())) for s in range(0, len(ids), 1024)]
    assert sorted(want) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in packed)


def test_tables_without_rows(spark, data, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0


def _distinct_texts(n):
    return [" ".join(f"w{k}x{i}" for i in range(12)) for k in range(n)]


def test_null_and_repeated_ids_keep_their_documents(spark, data):
    texts = _distinct_texts(9)
    ids = [None, None, None, 5, 5, 6, 7, None, 8]
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(ids, texts, strict=True)]
    rows += [(None, texts[0], "en", "s", len(texts[0])), (5, texts[3], "en", "s", len(texts[3])), (9, texts[6], "en", "s", len(texts[6]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, data).toArrow().to_pylist()
    assert sorted(r["text"] for r in got) == sorted(texts)


def test_rows_of_one_id_are_mixed_apart(spark, data):
    texts = _distinct_texts(60)
    rows = [(None if k % 2 else 5, t + " more" * (k % 7), "a" if k < 20 else "b", "en") for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, s, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_sources(spark, docs, data).toArrow().to_pylist()
    words = {s: sum(len(t.split()) for _, t, source, _ in rows if source == s) for s in "ab"}
    mixed = {s: sum(len(r["text"].split()) for r in got if r["source"] == s) for s in "ab"}
    # a takes 5 parts, b 2, each at most three times its words
    a = min(3 * words["a"], sum(words.values()) * 5 / 7)
    assert abs(mixed["a"] - a) <= 1 and abs(mixed["b"] - (sum(words.values()) - a)) <= 1
