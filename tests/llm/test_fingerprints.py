import hashlib
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from lakemill.llm.fingerprints import CLASSES, HIGH, LOW, cuckoo, fingerprints, lexicon, likeness, op2_fingerprint_documents, with_next_text


def test_edges(spark, nasty, empty, listed):
    rows = fingerprints(nasty.select("doc_id", "text"), lexicon(nasty), {"f": "text"}).toArrow().to_pylist()
    by_text = {}
    texts = {r[0]: r[1] for r in listed}
    for r in rows:
        assert r["f"]
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["f"])
    assert all(len(f) == 1 for f in by_text.values())
    assert fingerprints(empty.select("doc_id", "text"), lexicon(empty), {"f": "text"}).count() == 0
    assert with_next_text(spark, empty).count() == 0


def xx(*parts):
    """Spark's xxhash64 of strings (bytes), 32-bit numbers (int) and lists of 64-bit ones."""
    seed = 42
    for part in parts:
        chunks = [part] if isinstance(part, bytes) else [part.to_bytes(4, "little")] if isinstance(part, int) else [h.to_bytes(8, "little", signed=True) for h in part]
        for chunk in chunks:
            seed = xxhash.xxh64(chunk, seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def brute(text, band):
    """The fingerprint as its definition has it, without tables or arrays of hashes."""
    used = sorted(h for h in {xx(w.encode()) for w in re.findall(r"[^\W_]+", text.lower())} if h in band)
    out, level = [], 0
    while 4 ** (level + 1) <= len(used):
        level += 1
    for k in (level, level + 1) if used else ():
        picked = [((h >> 4 << 4) + xx([h], k) % 4**k, xx([h], k) % 4**k) for h in used]
        for c in range(CLASSES):
            group = [e for e, subset in picked if subset == c]
            if group:
                out.append(f"{'abcdefgh'[k]}{c:x}{xx(group) & 0xFFFFFFFF:08x}")
    return " ".join(out) or f"~~{xx(text.encode()) & 0xFFFFFFFF:08X}"


def brute_likeness(a, b):
    if a == b:
        return 1.0
    sets = [{e[:2]: e for e in f.split(" ")} for f in (a, b)]
    best = 0.0
    for level in {e[0] for e in sets[0]} & {e[0] for e in sets[1]}:
        x, y = ({k: v for k, v in s.items() if k[0] == level} for s in sets)
        best = max(best, len(set(x.values()) & set(y.values())) / len(set(x) | set(y)))
    return best


def test_query_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").toArrow().to_pylist()
    df = Counter(h for d in docs for h in {xx(w.encode()) for w in re.findall(r"[^\W_]+", (d["text"] or "").lower())})
    band = {h for h, n in df.items() if LOW * len(docs) <= n <= max(1.0, HIGH * len(docs))}
    texts = [d["text"] or "" for d in sorted(docs, key=lambda d: d["doc_id"])]
    got = sorted(op2_fingerprint_documents(spark, data).toArrow().to_pylist(), key=lambda r: r["doc_id"])
    want = [brute(t, band) for t in texts]
    for k, (r, t) in enumerate(zip(got, texts, strict=True)):
        edited = brute(t[: len(t) - len(t) // 4] + texts[(k + 1) % len(texts)][: len(t) // 4], band)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (want[k], edited)
        assert r["near_edited"] == brute_likeness(want[k], edited) and r["near_next"] == brute_likeness(want[k], want[(k + 1) % len(want)])


def test_cuckoo():
    keys = [xx([k]) for k in range(1, 5000)]
    table = cuckoo(keys)
    assert sorted(k for k in table if k) == sorted(keys) and len(table) <= 8 * len(keys)
    assert all(k in (table[k & (len(table) - 1)], table[(k >> 32) & (len(table) - 1)]) for k in keys)
    assert cuckoo([]) == [0] * 4


def _next(spark, rows):
    got = Counter((r["doc_id"], r["text"], r["next_text"]) for r in with_next_text(spark, spark.createDataFrame(rows, "doc_id long, text string")).toArrow().to_pylist())
    order = sorted(((i, xx((t or "").encode()) % (1 << 64), t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    assert got == Counter((i, t, order[(k + 1) % len(order)][2]) for k, (i, _, t) in enumerate(order))


def test_next(spark, listed):
    _next(spark, [r[:2] for r in listed])


@pytest.mark.parametrize("run", [2, 1000])
def test_next_whatever_the_ids(spark, monkeypatch, run):
    """One outlying id, ids near the ends, null ones and one that many rows share; runs stay short."""
    from lakemill.llm import fingerprints as module

    monkeypatch.setattr(module, "RUN", run)
    top = (1 << 63) - 1
    rows = [(k, f"text {k}") for k in range(40)] + [(top, "last"), (-top - 1, "first"), (top - 1, None)]
    rows += [(None, f"null {k}") for k in range(30)] + [(17, f"shared {k}") for k in range(60)]
    _next(spark, rows)
    if run == 2:
        dealt, _ = module._runs(spark, spark.createDataFrame(rows, "doc_id long, text string"))
        assert dealt.groupBy("run").count().agg(F.max("count")).first()[0] <= 12


def test_query(spark, data):
    got = sorted(op2_fingerprint_documents(spark, data).toArrow().to_pylist(), key=lambda r: r["doc_id"])
    docs = sorted(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").toArrow().to_pylist(), key=lambda r: r["doc_id"])
    texts = [d["text"] or "" for d in docs]
    for k, (r, t) in enumerate(zip(got, texts, strict=True)):
        n, after = len(t), texts[(k + 1) % len(texts)]
        edited = t[: n - n // 4] + after[: n // 4]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    mean = lambda c: sum(r[c] for r in got) / len(got)
    assert mean("near_edited") > 0.4 > 0.05 > mean("near_next")


def test_no_python_on_the_way(spark, data):
    plan = op2_fingerprint_documents(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_likeness(spark):
    pairs = [("a0aaaaaaaa a1bbbbbbbb", "a0aaaaaaaa a1bbbbbbbb", 1.0), ("b0aaaaaaaa", "b1aaaaaaaa", 0.0), ("a0aaaaaaaa a1b", "a0aaaaaaaa a1c c1d", 0.5), ("~~1", "a01", 0.0)]
    got = spark.createDataFrame(pairs, "a string, b string, want double").select("want", likeness(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
