import re

import numpy as np
import pytest

from lakemill.llm import neardup, store
from lakemill.llm.neardup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {65 + k: 97 + k for k in range(26)}


def brute(rows, size, percent=80):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) or frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[root(k)] = min(low.get(root(k), i), i)
    return sorted((i, len(s), low[root(k)], i == low[root(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def _got(frame):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in frame.toArrow().to_pylist())


def _chain(n, seed):
    """Copies of one text with more and more words changed, so that links form chains, and a few far ones."""
    random = np.random.Generator(np.random.PCG64(seed))
    base = [f"w{k}" for k in random.integers(0, 5000, 120)]
    out, now = [], base
    for i in range(n):
        now = list(now if i % 3 else base)
        for k in random.integers(0, len(now), random.integers(0, 4)):
            now[k] = f"v{random.integers(0, 10**6)}"
        out.append((1000 + 7 * i % n + n * (i % 2), " ".join(now)))
    return out


def test_edges(spark, nasty, empty, listed):
    assert _got(near_duplicates(spark, nasty)) == brute([(r[0], r[1]) for r in listed], 4)
    assert near_duplicates(spark, empty).count() == 0


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_chains(spark, seed):
    """Large families with borderline links, copies within and beyond reach of the text they vary."""
    rows = _chain(80, seed) + [(i + 10_000, t) for i, t in _chain(50, seed + 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(near_duplicates(spark, docs)) == brute(rows, 4)


def test_joined_bases_and_hot_keys_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(store, "HOT", 4)
    rows = _chain(60, 9)
    assert _got(near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 4)


def test_extreme_null_and_shared_ids(spark):
    top = (1 << 63) - 1
    words = [f"w{k}" for k in range(60)]
    a, b, c = " ".join(words), " ".join(words[1:]), " ".join(words[::-1])
    rows = [(top, a), (top - 1, b), (-top - 1, c), (None, a), (None, "alone in the world it stands"), (7, a + " x"), (7, "quite another text under one id"), (8, c + " y")]
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).toArrow().to_pylist()
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str)
    low = -top - 1
    expected = [(top, 7, False), (top - 1, 7, False), (low, low, True), (None, 7, False), (None, None, True), (7, 7, True), (7, 7, True), (8, low, False)]
    assert got == sorted(expected, key=str)


def test_signatures_of_borderline_pairs_stay_within_reach():
    """Of 20,000 pairs of similarity 0.8, none is further apart than the threshold, and distances spread as ideal hashing has it."""
    random = np.random.Generator(np.random.PCG64(3))
    far = []
    for _ in range(20_000):
        n = int(random.integers(20, 60))
        shared = random.integers(0, 1 << 63, 8 * n, dtype=np.uint64)
        x, y = (np.concatenate([shared, random.integers(0, 1 << 63, n, dtype=np.uint64)]) for _ in range(2))
        sig = neardup._signatures([x, y])
        far.append(int((sig[0] != sig[1]).sum()))
    assert max(far) <= neardup.TAU and abs(np.mean(far) - 12.8) < 0.1 and abs(np.std(far) - 3.2) < 0.1
