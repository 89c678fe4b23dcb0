"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample of unit vectors (seeded, by hash) and
goes to every executor: at most `most_leaves` leaves, whatever the corpus. Every
vector is put in the leaf it descends to. A query walks the tree with a
priority queue of nodes, nearest centre first, and visits leaves until as many
are open as calibration asked for: a sample of queries is held against all rows
in blocks, and the visits are as many as its true neighbours' leaves need, in
the order of each query's walk, for the recall asked for, up to all leaves.

Equal vectors are one entry that carries its smallest k + 1 ids, which is all
that any query can return of them. Leaves are cut into blocks of bounded size,
so a leaf that holds a third of all vectors is many tasks' work, and the queries
that visit a leaf into chunks of bounded size.

Cases: vectors that are null, of another length than most, zero, or hold null
or non-finite components take no part; fewer candidates than k give all; ties
go to the smaller id; repeated rows count once; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .store import Workspace, power_of_two

#: Vectors that the tree is fitted on, queries that calibrate the search, and branches of a node.
SAMPLE, CALIBRATION, BRANCHES = 20_000, 200, 8
MOST_LEAVES = 4096
#: Vectors of a leaf on average, and of a block and queries of a chunk at most about.
LEAF_ROWS, BLOCK_ROWS, CHUNK_ROWS = 150, 2000, 4000
RECALL = 0.97
#: Leaves that a query visits in the first round, and how much wider each next one is.
FIRST_VISITS, WIDER = 8, 8


@dataclass
class Tree:
    """Nodes in one array: centres, first child and number of children (0: a leaf), and leaf numbers."""

    centres: np.ndarray
    first: np.ndarray
    children: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.children == 0).sum())

    def place(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector, by descent to the nearest centre."""
        node = np.zeros(len(unit), np.int64)
        while True:
            inner = np.flatnonzero(self.children[node] > 0)
            if not len(inner):
                return self.leaf[node]
            for n in np.unique(node[inner]):
                at = inner[node[inner] == n]
                kids = slice(self.first[n], self.first[n] + self.children[n])
                node[at] = self.first[n] + (unit[at] @ self.centres[kids].T).argmax(axis=1)

    def best_bins(self, unit: np.ndarray, visits: int) -> list[int]:
        """Leaves in the order of best-bin-first search: always the open node whose centre is nearest."""
        heap, found = [(-2.0, 0)], []
        while heap and len(found) < visits:
            _, n = heapq.heappop(heap)
            while self.children[n]:
                a = self.first[n]
                near = self.centres[a : a + self.children[n]] @ unit
                best = int(near.argmax())
                for k in range(len(near)):
                    if k != best:
                        heapq.heappush(heap, (-float(near[k]), int(a + k)))
                n = a + best
            found.append(int(self.leaf[n]))
        return found


def _kmeans(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: unit centres; empty ones are dropped."""
    centres = x[random.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == c].sum(axis=0) for c in np.unique(own)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit_tree(sample: np.ndarray, leaves: int, seed: int = 11) -> Tree:
    """Splits the largest leaf of the sample until there are about `leaves` leaves."""
    random = np.random.Generator(np.random.PCG64(seed))
    dim = sample.shape[1] if sample.ndim == 2 else 1
    centres, first, children = [np.zeros(dim)], [0], [0]
    heap = [(-len(sample), 0, np.arange(len(sample)))] if len(sample) else []
    count = 1
    while heap and count < leaves:
        size, n, rows = heapq.heappop(heap)
        if -size < 2 * BRANCHES:
            break
        found = _kmeans(sample[rows], BRANCHES, random)
        own = (sample[rows] @ found.T).argmax(axis=1)
        if len(np.unique(own)) < 2:
            continue
        first[n], children[n] = len(centres), len(found)
        for c in range(len(found)):
            heapq.heappush(heap, (-int((own == c).sum()), len(centres), rows[own == c]))
            centres.append(found[c])
            first.append(0)
            children.append(0)
        count += len(found) - 1
    kids = np.array(children)
    leaf = np.where(kids == 0, np.cumsum(kids == 0) - 1, -1)
    return Tree(np.array(centres), np.array(first), kids, leaf)


def _matrix(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes of doubles."""
    for batch in batches:
        ids, out = [], []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            if i is None or not v or any(c is None for c in v):
                continue
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any() and np.isfinite((x * x).sum()) and (x * x).sum() > 0:
                ids.append(i)
                out.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "vec"])


def _placing(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.value.place(_unit(_matrix(batch.column("vec").to_pylist()))) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("vec"), pa.array(leaf, pa.int64())], ["ids", "vec", "leaf"])

    return run


def _walking(tree, visits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column("vec").to_pylist()))
            found = [tree.value.best_bins(u, visits) for u in unit]
            ends = np.cumsum([0, *(len(f) for f in found)])
            leaves = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for f in found for x in f], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec"), leaves], ["query_id", "vec", "leaves"])

    return run


FOUND = "query_id long, vec_id long, score double"


def nearest(queries: list[tuple[int, bytes]], ids: list, vecs: list[bytes], k: int, least: list[float] | None = None) -> list[tuple[int, int, float]]:
    """The k nearest of each query among entries of equal vectors with their smallest ids; none below the query's least score."""
    if not queries or not len(ids):
        return []
    q, x = _matrix([v for _, v in queries]), _matrix(vecs)
    scores = (q @ x.T) / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :])
    out = []
    for (query, vec), row, bound in zip(queries, scores, least or [-2.0] * len(queries), strict=True):
        if row.max() < bound - 1e-12:
            continue
        # entries as good as the k-th and all their ids; a margin keeps ties that rounding parts
        low = np.partition(row, len(row) - min(len(row), k + 1))[len(row) - min(len(row), k + 1)] - 1e-12
        low = max(low, bound - 1e-12)
        at = np.flatnonzero(row >= low)
        a = np.frombuffer(vec, "<f8")
        exact = [cosine(a, np.frombuffer(vecs[j], "<f8")) for j in at]
        near = sorted((-s, int(i)) for j, s in zip(at, exact, strict=True) for i in ids[j] if i != query)
        out += [(query, i, -s) for s, i in near[:k] if -s >= bound]
    return out


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def _scoring(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        asked = list(zip(queries["query_id"].tolist(), queries["vec"].tolist(), strict=True))
        found = []
        for at in range(0, len(asked), 256):
            found += nearest(asked[at : at + 256], rows["ids"].tolist(), rows["vec"].tolist(), k, queries["low"].tolist()[at : at + 256])
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _against_all(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                found = nearest(queries.value, part.column("ids").to_pylist(), part.column("vec").to_pylist(), k)
                q, i, s = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


class Index:
    """A tree with every vector in its leaf's blocks."""

    def __init__(self, spark: SparkSession, vectors: DataFrame, k: int, seed: str = "ann"):
        self.spark, self.k, self.ws = spark, k, Workspace(spark, "ann")
        packed = vectors.select("vec_id", "embedding").mapInArrow(_pack, "vec_id long, vec binary")
        self.rows = self.ws.put(packed.distinct(), "vectors")
        length = self.rows.groupBy(F.length("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
        if length is not None:
            self.rows = self.rows.where(F.length("vec") == length["n"])
        # of equal vectors the k + 1 smallest ids; the rank is cut before the shuffle too
        least = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
        few = self.rows.withColumn("r", least).where(F.col("r") <= k + 1)
        entries = self.ws.put(few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
        self.n = entries.count()
        order = F.xxhash64(F.col("ids")[0], F.lit(seed))
        sample = [r["vec"] for r in entries.select("vec", order.alias("o"), F.col("ids")[0].alias("i")).orderBy("o", "i").limit(SAMPLE).collect()]
        leaves = power_of_two(self.n / LEAF_ROWS, 1, MOST_LEAVES)
        self.tree = fit_tree(_unit(_matrix(sample)) if sample else np.empty((0, 1)), leaves)
        self.shared = spark.sparkContext.broadcast(self.tree)
        placed = self.ws.put(entries.select("ids", "vec").mapInArrow(_placing(self.shared), "ids array<long>, vec binary, leaf long"), "placed")
        self.entries, self.placed = entries, placed
        blocks = placed.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / BLOCK_ROWS).alias("blocks"))
        self.blocks = self.ws.put(blocks, "blocks")

    def search(self, queries: DataFrame, visits: int) -> DataFrame:
        """query_id, vec_id, score, rank of queries (query_id, vec).

        Visits widen in rounds; after the first, only what is as near as the k-th found so far leaves a leaf."""
        walked = queries.mapInArrow(_walking(self.shared, visits), "query_id long, vec binary, leaves array<long>")
        walked = self.ws.put(walked, "walked")
        best = self.spark.createDataFrame([], FOUND)
        done, width = 0, FIRST_VISITS
        while done < visits:
            known = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
            known = known.select("query_id", F.when(F.col("n") >= self.k, F.col("low")).otherwise(F.lit(-2.0)).alias("low"))
            asked = walked.select("query_id", "vec", F.explode(F.slice("leaves", done + 1, width)).alias("leaf"))
            asked = asked.join(known, "query_id", "left").fillna(-2.0, ["low"]) if done else asked.withColumn("low", F.lit(-2.0))
            found = self._visit(asked, walked.select(F.explode(F.slice("leaves", done + 1, width)).alias("leaf")))
            best = self.ws.put(_best(best.unionByName(found), self.k).drop("rank"), "best")
            done, width = done + width, width * WIDER
        return _best(best, self.k)

    def _visit(self, asked: DataFrame, leaves: DataFrame) -> DataFrame:
        """What queries (query_id, vec, low) find in the leaves that they ask for."""
        visited = leaves.groupBy("leaf").count()
        # a row for each leaf that is visited: at most MOST_LEAVES
        dealt = visited.select("leaf", F.ceil(F.col("count") / CHUNK_ROWS).alias("chunks")).join(self.blocks, "leaf")
        dealt = F.broadcast(self.ws.put(dealt, "dealt"))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        chunk, block = F.pmod(F.xxhash64("query_id"), F.col("chunks")), F.pmod(F.xxhash64(F.col("ids")[0]), F.col("blocks"))
        asked = asked.join(dealt, "leaf").select("query_id", "vec", "low", "leaf", chunk.alias("chunk"), each("blocks").alias("block"))
        placed = self.placed.join(dealt, "leaf").select("ids", "vec", "leaf", each("chunks").alias("chunk"), block.alias("block"))
        both = asked.groupBy("leaf", "block", "chunk").cogroup(placed.groupBy("leaf", "block", "chunk"))
        return both.applyInPandas(_scoring(self.k), FOUND)

    def exact(self, queries: list[tuple[int, bytes]]) -> DataFrame:
        """A bounded list of queries against all rows, in blocks."""
        return _best(self.entries.select("ids", "vec").mapInArrow(_against_all(self.spark.sparkContext.broadcast(queries), self.k), FOUND), self.k)

    def recall(self, found: DataFrame, exact: DataFrame) -> float:
        truth = exact.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n"))
        hits = found.join(truth, "query_id").agg(F.sum((F.col("score") >= F.col("low") - 1e-12).cast("long"))).first()[0] or 0
        return hits / max(1, truth.agg(F.sum("n")).first()[0] or 0)

    def calibrate(self, queries: DataFrame, recall: float = RECALL) -> int:
        """Leaf visits that reach the recall on a sample of the queries, by the leaves that their true neighbours are in."""
        sample = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION).collect()
        if not sample:
            return 1
        truth = self.ws.put(self.exact([(r["query_id"], bytes(r["vec"])) for r in sample]).select("query_id", "vec_id"), "truth")
        # at most k rows a calibration query
        near = self.rows.join(F.broadcast(truth), "vec_id").select("query_id", "vec_id", "vec").collect()
        if not near:
            return 1
        leaf = self.tree.place(_unit(_matrix([r["vec"] for r in near])))
        order = {r["query_id"]: np.argsort(self.tree.best_bins(u, self.tree.leaves)) for r, u in zip(sample, _unit(_matrix([r["vec"] for r in sample])), strict=True)}
        needed: dict[tuple[int, int], int] = {}
        for r, at in zip(near, leaf, strict=True):
            key, visits = (r["query_id"], r["vec_id"]), int(order[r["query_id"]][at]) + 1
            needed[key] = min(visits, needed.get(key, visits))
        widening = sorted(needed.values())
        return widening[max(0, ceil(recall * len(widening)) - 1)]


def nearest_neighbours(spark: SparkSession, vectors: DataFrame, is_query: Column, *, k: int = 5, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score; the queries are those of the vectors where is_query holds."""
    index = Index(spark, vectors, k)
    queries = index.ws.put(index.rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vec"), "queries")
    visits = index.calibrate(queries, recall)
    return index.search(queries, visits).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
