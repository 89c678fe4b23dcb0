"""Near-duplicate groups by a multi-index Hamming join over MinHash signatures.

A document's set holds its distinct shingles of `size` words. Its signature is
K minima under K hash functions, b = 16 bits kept of each. Two signatures
differ in about K * (1 - J) places. The signature is split into chunks by
pigeonhole: within distance TAU, some chunk has at most one differing place.
For each chunk every choice of that place is enumerated, and the other values
form a key, so all pairs within TAU share a key. With K = 64 and 16 chunks of
4, TAU is 31; a pair at J = 0.8 exceeds it with probability 2e-7.

Not all pairs of a key are listed. Documents with equal sets are one class, and
classes that keys connect are a family (a component of the links from each
member of a key to its smallest), so every pair within TAU lies in one family.
Inside a family the links are found exactly, on full sets:

Let a family's base be the shingles of more than half its members, and D(x) what
x has beyond the base or lacks of it, so that two sets differ by D(x) ^ D(y),
base or no base. With similarity at least p %, sets differ by at most
(100 - p) / (100 + p) of their summed sizes. So with

    v(x) = (100 + p) |D(x)| - (100 - p) |x|

a pair with v(x) + v(y) <= 0 is linked whatever its differences are, and any
other linked pair has at least (v(x) + v(y)) / 2 (100 + p) of its differences in
common. The first kind is linked with the family's least v as well, so one test
a document finds them all: they are the core. For the second kind, differences
are put in order, rarest first, and pairs meet in those that come before the
overlap they need is out of reach (prefix and position filters); the pair's
member of smaller v is looked up by its short prefix, the other, never of the
core, looks up by its longer one. Pairs that meet are confirmed by counting the
differences they share. So no pair is listed among copies that vary around one
text, however many there are, nor among those that vary too far.

Cases: null or empty text, or text without words: empty set, linked with
nothing; fewer than `size` words: the whole sequence is the one shingle;
repeated rows: each row is returned, with the component of its set; a null
doc_id names no component: such a row takes that of its set where another row
has the set, and is then not kept, else it has none and is kept; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .batches import combined, text_slices
from .components import connected_components
from .store import Workspace, join_hot

K = 64
CHUNKS = (4,) * 16
TAU = 2 * len(CHUNKS) - 1

_RNG = np.random.Generator(np.random.PCG64(20240917))
_MULTIPLY = _RNG.integers(0, 1 << 32, K, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, K, dtype=np.uint32)

#: Shingles of all bases together that are sent to every executor (8 bytes each); beyond that bases are joined.
BROADCAST_SHINGLES = 1_000_000


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), K), np.uint16)
    some = np.flatnonzero(sizes)
    if len(some):
        low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        start = (np.cumsum(sizes) - sizes)[some]
        for k in range(K):
            least = np.minimum.reduceat(low * _MULTIPLY[k] + _ADD[k], start)
            out[some, k] = (least ^ (least >> np.uint32(16))).astype(np.uint16)
    return out


def _identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell the set; order-free."""
    from .wordhash import mix

    a = mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    b = mix(s * np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .wordhash import Words, buffers, shingle_sets

        for batch in text_slices(batches):
            sets = shingle_sets(Words(*buffers(combined(batch, "text")), lower=True), size)
            same = [_identity(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("t"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([x for x, _ in same], pa.int64()),
                    pa.array([x for _, x in same], pa.int64()),
                    pa.array([x.tobytes() for x in _signatures(sets)], pa.binary()),
                ],
                ["doc_id", "t", "n", "s1", "s2", "signature"],
            )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .wordhash import mix

    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(-1, K).astype(np.uint64)
            keys, first = [], 0
            for c, width in enumerate(CHUNKS):
                for error in range(width):
                    h = np.full(len(sig), (c << 8) + error + 1, np.uint64)
                    for place in range(width):
                        if place != error:
                            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, first + place])
                    keys.append(h)
                first += width
            doc = np.tile(part.column("doc").to_numpy(), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(doc)], ["key", "doc"])


def _shingles(size: int):
    """One row for each shingle of each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .wordhash import Words, buffers, shingle_sets

        for batch in text_slices(batches):
            sets = shingle_sets(Words(*buffers(combined(batch, "text")), lower=True), size)
            family = np.repeat(batch.column("family").to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(family), pa.array(np.concatenate(sets).view(np.int64))], ["family", "h"])

    return run


def _differences(size: int):
    """What each member has beyond its family's base or lacks of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .wordhash import Words, buffers, shingle_sets

        for batch in text_slices(batches):
            sets = shingle_sets(Words(*buffers(combined(batch, "text")), lower=True), size)
            base = combined(batch, "base")
            values, at = base.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(base.value_lengths().fill_null(0).to_numpy())])
            found = [np.setxor1d(s, values[a:b], assume_unique=True) for s, a, b in zip(sets, at, at[1:], strict=False)]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("family"), batch.column("doc"), pa.array([len(s) for s in sets], pa.int64()), lists], ["family", "doc", "n", "diff"])

    return run


def _families(ws: Workspace, classes: DataFrame) -> DataFrame:
    """(doc, family) of the classes that share a key with another, directly or through others."""
    keyed = classes.select("doc", "signature").mapInArrow(_keys, "key long, doc long")
    shared = ws.put(keyed.groupBy("key").agg(F.count("*").alias("many"), F.min("doc").alias("least")).where("many > 1"), "shared")
    edges = join_hot(keyed, shared, ["key"], "many").where("doc > least").select(F.col("least").alias("a"), F.col("doc").alias("b"))
    found = ws.put(connected_components(ws, edges).toDF("doc", "family"), "families")
    ws.drop(shared)
    return found


def _links(ws: Workspace, docs: DataFrame, classes: DataFrame, families: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of which at most one class is of its family's core, and the core's classes: (doc, label)."""
    first = classes.join(families, "doc").select("doc_id", "t", "doc", "family")
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").join(first, ["doc_id", "t"])
    texts = ws.put(texts.groupBy("doc", "family").agg(F.min("text").alias("text")), "texts")
    members = ws.put(texts.groupBy("family").agg(F.count("*").alias("many")), "members")
    count = texts.select("family", "text").mapInArrow(_shingles(size), "family long, h long").groupBy("family", "h").agg(F.count("*").alias("c"))
    count = ws.put(count.where("c > 1").join(members, "family").select("family", "h", "c", (F.col("c") * 2 > F.col("many")).alias("usual"), "many"), "count")
    # a base holds less than twice the shingles of its family's average member
    bases = ws.put(count.where("usual").groupBy("family").agg(F.collect_list("h").alias("base")), "bases")
    bases = members.join(bases, "family", "left")
    if count.where("usual").count() + members.count() <= BROADCAST_SHINGLES:
        based = texts.join(F.broadcast(bases.drop("many")), "family")
    else:
        based = join_hot(texts, ws.put(bases, "based"), ["family"], "many")
    based = based.select("family", "doc", "text", "base").mapInArrow(_differences(size), "family long, doc long, n long, diff array<long>")
    low, high = 100 - percent, 100 + percent
    v = F.lit(high) * F.size("diff") - F.lit(low) * F.col("n")
    diffs = ws.put(based.withColumn("d", F.size("diff").cast("long")).withColumn("v", v), "diffs")
    ws.drop(texts)

    least = ws.put(diffs.groupBy("family").agg(F.min("v").alias("v0"), F.count("*").alias("many")), "least")
    core = F.col("v") + F.col("v0") <= 0
    whole = join_hot(diffs.select("family", "doc", "v"), least, ["family"], "many")
    beyond = whole.groupBy("family").agg(F.first("v0").alias("v0"), F.min(F.when(~core, F.col("v"))).alias("w"), F.min(F.when(core, F.col("doc"))).alias("label"), F.count("*").alias("many"))
    beyond = ws.put(beyond, "beyond")
    whole = join_hot(diffs.select("family", "doc", "v"), beyond, ["family"], "many")
    cored = ws.put(whole.where(core).select("doc", "label"), "core")

    # documents of families with any beyond the core, their differences placed rarest first
    open_ = ws.put(join_hot(diffs, beyond.where("w IS NOT NULL"), ["family"], "many").withColumn("core", core), "open")
    rare = F.when(F.col("usual"), F.col("many") - F.col("c")).otherwise(F.col("c"))
    rarity = ws.put(count.select("family", "h", rare.alias("f")).where("f > 1").withColumn("many", F.col("f")), "rarity")
    single = open_.select("family", "doc", "n", "d", "v", "v0", "w", "core", F.explode("diff").alias("h"))
    single = join_hot(single, rarity, ["family", "h"], "many")
    # those of no other member come first and meet nobody
    last = W.partitionBy("doc").orderBy(F.desc("f"), F.desc("h"))
    placed = single.withColumn("i", F.col("d") - F.row_number().over(last))
    need = lambda s: F.greatest(F.lit(1), F.ceil(s / (2 * high)))
    far = F.floor(F.col("n") * low / percent)
    reach = lambda s: F.least(F.col("d") - need(s), far)
    placed = placed.withColumn("long", F.when(~F.col("core"), reach(F.col("v") + F.col("v0"))))
    placed = placed.withColumn("short", reach(F.col("v") + F.when(F.col("core"), F.col("w")).otherwise(F.col("v"))))
    placed = ws.put(placed.where("i <= greatest(short, long)"), "placed")
    index = placed.where("i <= short").select("family", "h", *[F.col(c).alias(f"{c}_a") for c in ("doc", "n", "d", "v", "i")])
    probe = placed.where("i <= long").select("family", "h", *[F.col(c).alias(f"{c}_b") for c in ("doc", "n", "d", "v", "i")])
    overlap = need(F.col("v_a") + F.col("v_b"))
    met = index.join(probe, ["family", "h"]).where(
        ((F.col("v_a") < F.col("v_b")) | ((F.col("v_a") == F.col("v_b")) & (F.col("doc_a") < F.col("doc_b"))))
        & (F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))
        & (F.col("i_a") + overlap <= F.col("d_a")) & (F.col("i_b") + overlap <= F.col("d_b"))
        & (F.lit(high) * (F.col("i_a") + F.col("i_b")) <= F.lit(low) * (F.col("n_a") + F.col("n_b")))
    )
    pairs = ws.put(met.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct(), "pairs")
    sides = [pairs.alias("p")] + [open_.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("d").alias(f"d_{x}"), F.col("diff").alias(f"diff_{x}")) for x in "ab"]
    full = sides[0].join(sides[1], "a").join(sides[2], "b")
    apart = F.col("d_a") + F.col("d_b") - 2 * F.size(F.array_intersect("diff_a", "diff_b"))
    linked = ws.put(full.where(F.lit(high) * apart <= F.lit(low) * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "linked")
    ws.drop(count, rarity, open_, placed, pairs, diffs)
    return linked, cored


def near_duplicates(spark: SparkSession, docs: DataFrame, *, size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    ws = Workspace(spark, "neardup")
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    signed = ws.put(hashed.mapInArrow(_sign(size), "doc_id long, t long, n long, s1 long, s2 long, signature binary"), "signed")
    # one class of equal sets, with its row of smallest doc_id; rows of one doc_id may be of several classes
    classes = signed.where("n > 0").groupBy("s1", "s2").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t"))).alias("r"), F.first("signature").alias("signature"), F.count("*").alias("many")
    )
    classes = ws.put(classes.select(F.monotonically_increasing_id().alias("doc"), "s1", "s2", "r.doc_id", "r.t", "signature", "many"), "classes")
    known = classes.where("doc_id IS NOT NULL")
    families = _families(ws, known)
    linked, core = _links(ws, docs, known, families, size, percent)
    # a family's core goes by one of its classes, so links among it needn't be listed
    names = core.toDF("doc", "label")
    for side in ("a", "b"):
        linked = linked.withColumnRenamed(side, "doc").join(names, "doc", "left").withColumn(side, F.coalesce("label", "doc")).drop("doc", "label")
    found = ws.put(connected_components(ws, linked).toDF("label", "comp"), "component")
    named = known.select("s1", "s2", "doc", "doc_id").join(names, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    named = ws.put(named.join(found, "label", "left").select("s1", "s2", "doc_id", F.coalesce("comp", "label").alias("comp")), "named")
    least = ws.put(named.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("many")), "least")
    sets = join_hot(named, least, ["comp"], "many").select("s1", "s2", "component_id")
    sets = ws.put(classes.select("s1", "s2", "many").join(sets, ["s1", "s2"], "left"), "sets")
    rows = signed.select("doc_id", "n", "s1", "s2")
    out = join_hot(rows.where("n > 0"), sets, ["s1", "s2"], "many").unionByName(rows.where("n = 0").withColumn("component_id", F.col("doc_id")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
