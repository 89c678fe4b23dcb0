import hashlib
import re
from collections import Counter

import pytest

from lakemill.llm.substrings import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("size", [3, 12, 35])
def test_against_brute_force(spark, nasty, listed, size):
    got = remove_repeats(spark, nasty, size=size, keep_text=True).toArrow().to_pylist()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute([(r[0], r[1]) for r in listed], size)
    for r in got:
        assert sum(s["to"] - s["from"] for s in r["intervals"]) == r["n_removed"]
        assert all(a["to"] < b["from"] for a, b in zip(r["intervals"], r["intervals"][1:], strict=False))


def test_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = remove_repeats(spark, docs).toArrow().to_pylist()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute([tuple(r) for r in docs.collect()], 35)


def test_empty_and_null_id(spark, empty):
    assert remove_repeats(spark, empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (1, "a b c e")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in remove_repeats(spark, rows, size=3).toArrow().to_pylist()) == [(0, 3), (1, 3)]


def test_shared_null_and_extreme_ids(spark):
    """Different texts under one id, or under none, keep to themselves."""
    words = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    low = -(1 << 63)
    rows = [(5, words(0, 10)), (5, words(100, 110)), (None, words(200, 210)), (None, words(0, 10)), (low, words(300, 310)), (7, words(300, 305)), (-1, words(200, 204))]
    got = remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), size=3).toArrow().to_pylist()
    plain = lambda rs: sorted((str(a), *rest) for a, *rest in rs)
    want = []
    for (i, _), (k, *rest) in zip(rows, sorted(brute([(k, t) for k, (_, t) in enumerate(rows)], 3)), strict=True):
        want.append((i, *rest))
    assert plain((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == plain(want)
