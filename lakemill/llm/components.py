"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace, join_hot

#: Edges that a task contracts at a time.
CONTRACTED = 1 << 20


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the same components as these: from the smallest node of each to its others."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        # the label of a node is the root of its tree; roots go below the least root across an edge
        low, new = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[rest]], nodes[rest]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        sides = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in "ab")
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(*sides)], ["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= CONTRACTED:
            yield flush()
            held = []
    if held:
        yield flush()


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); component is the smallest node reachable.

    Each round joins neighbours to the smallest node known in their
    neighbourhood, so a chain of n nodes takes about log n rounds. Between
    rounds a task replaces the edges it has by stars of the same components.
    Rounds end when all edges form stars: every node with a smaller neighbour
    has no other. Only minima and maxima are aggregated, which combine before
    the shuffle, a node with many edges meets them by broadcast, and a round's
    edges are written before the next reads them.
    """
    shape = "a long, b long"
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    now = ws.put(now.mapInArrow(_contract, shape), "edges")
    while True:
        # large star: every larger neighbour moves to the smallest node in sight
        near = now.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        low = ws.put(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.max("v").alias("top"), F.count("*").alias("many")), "low")
        if low.where("m < u AND top > m").isEmpty():
            ws.drop(low)
            break
        large = join_hot(near, low.drop("top"), ["u"], "many").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        large = ws.put(large, "large")
        ws.drop(now, low)
        # small star: the node and its smaller neighbours move to the smallest of them
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = ws.put(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many")), "low")
        small = join_hot(down, low, ["u"], "many").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a < b").distinct()
        now = ws.put(small.mapInArrow(_contract, shape), "small")
        ws.drop(large, low)
    roots = now.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "node")
    return roots.union(now.select("a", F.col("a").alias("component")).distinct())
