"""Substring de-duplication: repeated word windows, merged into maximal removal intervals.

Every window of `size` words has a Rabin-Karp hash. Only windows that can
repeat are sent to be counted: a window's anchor is the least of its 8-word
hashes, equal windows have equal anchors, so a window whose anchor occurs once
in the corpus occurs once. Anchors are a fourteenth of the windows; those that
occur more often are marked in a bitmap of fixed size, which at worst (full)
lets every window through. Hashes are 96 bits wide.

Occurrences are combined before the shuffle: of a window that a task meets
several times, one row goes to the count under its hash, the others are known
to repeat and are dealt out at random. So a passage in a third of all
documents sends at most one row a task to one place.

Cases: null text has no words; texts under `size` words keep all; a repeated
row repeats every window of its own; windows overlapping themselves inside one
text count as repeats; an empty table gives an empty result; doc_id may be null
or shared: inside, a row goes by 96 bits of its doc_id and text, and only rows
equal in both share their marks, which are equal too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .batches import combined, text_slices
from .store import Workspace

SIZE = 35
ANCHOR = 8
#: Bits of the bitmaps that go to every executor (16 MB), whatever the corpus.
BITS = 27
#: Candidate windows that a task holds before it combines them.
HELD = 3_000_000

def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least value in every run of `width` values."""
    v, p, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        right = v[step:] < v[:-step]
        v, p = np.where(right, v[step:], v[:-step]), np.where(right, p[step:], p[:-step])
        have += step
    return p


def _anchored(words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every window, the position of its anchor, and all 8-word hashes by first word."""
    h, at = words.windows(min(ANCHOR, size))
    hashes = np.zeros(len(words.hash), np.uint64)
    hashes[at] = h
    _, first = words.windows(size)
    if not len(first):
        return first, first, hashes
    # a window's anchors all start inside its text, so runs over the flat array are right for it
    least = _least(hashes, size - min(ANCHOR, size) + 1)
    return first, least[first], hashes


def _anchors(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .wordhash import Words, buffers

        for batch in text_slices(batches):
            _, anchor, hashes = _anchored(Words(*buffers(combined(batch, "text"))), size)
            found, n = np.unique(hashes[np.unique(anchor)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return run


def bitmap(spark: SparkSession, keys: DataFrame) -> Broadcast:
    """Bits of a table of distinct well-mixed longs (column `key`), at every executor. At most 2**(BITS - 6) rows come back."""
    words = keys.groupBy((F.shiftrightunsigned("key", 64 - BITS + 6)).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(key, {64 - BITS}) & 63 AS INT))")).alias("bits")
    )
    table = words.toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[table.column("w").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(out)


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    top = keys >> np.uint64(64 - BITS)
    return (bits[top >> np.uint64(6)] >> (top & np.uint64(63))) & np.uint64(1) == 1


def _candidates(size: int, bits: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .wordhash import WINDOW_BASES, Words, buffers, mix

        held: list[tuple[np.ndarray, ...]] = []

        def combine() -> pa.RecordBatch:
            h1, h2, row, part = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((h2, h1))
            same = np.zeros(len(h1), bool)
            same[1:] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
            more = np.zeros(len(h1), bool)
            more[order[same]] = True
            n = np.ones(len(h1), np.int8)
            n[order[np.flatnonzero(same) - 1]] = 2
            n[more] = 2
            away = mix((row[more].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ mix(part[more].view(np.uint64)))
            h1[more], h2[more] = away, (mix(away) >> np.uint64(32)).astype(np.uint32)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int32)), pa.array(row), pa.array(part), pa.array(n)], ["h1", "h2", "row", "part", "n"]
            )

        for batch in text_slices(batches):
            words = Words(*buffers(combined(batch, "text")))
            first, anchor, hashes = _anchored(words, size)
            if len(first):
                h1, _ = words.windows(size, WINDOW_BASES[0])
                h2, _ = words.windows(size, WINDOW_BASES[1])
                keep = _marked(bits.value, hashes[anchor])
                first = first[keep]
                owner = np.searchsorted(words.first, first, "right") - 1
                part = batch.column("more").to_numpy().astype(np.int64)[owner] << 32 | (first - words.first[owner])
                held.append((h1[keep], (h2[keep] >> np.uint64(32)).astype(np.uint32), batch.column("row").to_numpy()[owner], part))
            if sum(len(x[0]) for x in held) >= HELD:
                yield combine()
        if held:
            yield combine()

    return run


def _split(bits: Broadcast):
    """Results of texts that hold no mark; the text of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .wordhash import buffers, mix

        for batch in text_slices(batches):
            raw, at = buffers(combined(batch, "text"))
            marked = _marked(bits.value, mix(batch.column("row").to_numpy().view(np.uint64)))
            data, n, digest = raw.tobytes(), [], []
            for a, b, skip in zip(at[:-1].tolist(), at[1:].tolist(), marked.tolist(), strict=True):
                words = () if skip else data[a:b].split()
                n.append(len(words))
                digest.append(None if skip else hashlib.sha256(b" ".join(words)).hexdigest())
            text = pc.fill_null(combined(batch, "text"), "").take(pa.array(np.arange(len(marked)), mask=~marked))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "row", "more")), pa.array(n, pa.int64()), pa.array(digest, pa.string()), text],
                ["doc_id", "row", "more", "n_words", "kept_sha256", "text"],
            )

    return run


def _remove(size: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, digest, kept, spans = [], [], [], [], []
            for text, marks, words_before, sha in zip(*(batch.column(c) for c in ("text", "marks", "n_words", "kept_sha256")), strict=True):
                if not text.is_valid:
                    n.append(words_before.as_py())
                    removed.append(0)
                    digest.append(sha.as_py())
                    kept.append(None)
                    spans.append([])
                    continue
                words = text.as_py().encode().split()
                edge = np.zeros(len(words) + size + 1, np.int32)
                for mark in marks.as_py() or ():
                    start = mark["block"] * 64 + np.flatnonzero(np.unpackbits(np.array([mark["bits"]], "<i8").view(np.uint8), bitorder="little"))
                    start = start[start < len(words)]
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + size, -1)
                gone = np.cumsum(edge)[: len(words)] > 0
                flips = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                stay = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                n.append(len(words))
                removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(stay).hexdigest())
                kept.append(stay.decode() if keep_text else None)
                spans.append([{"from": int(a), "to": int(b)} for a, b in zip(flips[::2], flips[1::2], strict=True)])
            columns = [
                batch.column("doc_id").cast(pa.int64()),
                pa.array(n, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(digest, pa.string()),
                pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
            ]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "intervals"]
            if keep_text:
                columns.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, *, size: int = SIZE, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, intervals (words [from, to) taken out) of every row.

    With keep_text also kept_text: null where nothing was taken out of the text.
    """
    ws = Workspace(spark, "substrings")
    named = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", "text", F.xxhash64(*named).alias("row"), F.hash(*named).alias("more"))
    anchors = docs.select("text").mapInArrow(_anchors(size), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    bits = bitmap(spark, anchors.where("n > 1").select(F.col("anchor").alias("key")))
    windows = docs.mapInArrow(_candidates(size, bits), "h1 long, h2 int, row long, part long, n byte")
    repeated = windows.withColumn("all", F.sum("n").over(W.partitionBy("h1", "h2"))).where("all > 1")
    repeated = repeated.select("row", F.expr("CAST(part >> 32 AS INT)").alias("more"), F.expr("CAST(part & 4294967295L AS INT)").alias("pos"))
    block = F.shiftright("pos", 6).alias("block")
    marks = repeated.repartition("row").groupBy("row", "more", block).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    marks = ws.put(marks.groupBy("row", "more").agg(F.collect_list(F.struct("block", "bits")).alias("marks")), "marks")
    seen = bitmap(spark, marks.select("row").mapInArrow(_document_keys, "key long"))
    texts = docs.mapInArrow(_split(seen), "doc_id long, row long, more int, n_words long, kept_sha256 string, text string")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<`from`: long, `to`: long>>"
    return texts.join(marks, ["row", "more"], "left").mapInArrow(_remove(size, keep_text), out + ", kept_text string" * keep_text)


def _document_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .wordhash import mix

    for batch in batches:
        ids = batch.column("row").to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(mix(ids).view(np.int64))], ["key"])


def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")
