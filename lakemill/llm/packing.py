"""Packing documents into fixed-length sequences, shortest pack first over the length histogram.

Documents are cut into pieces of at most `capacity` ids. Full pieces are
sequences of their own. The histogram of the remaining lengths (fewer than
`capacity` entries, whatever the corpus) is packed on the driver: lengths are
placed longest first, each into the patterns with the most room, and only
counts of patterns are updated. Patterns go back to the pieces by rank: the
r-th piece of a length fills the r-th slot for that length.

Ranks are prefix sums over cells of (length, hash of the document), so a
length that a third of all pieces share is spread over many tasks.

Cases: null or empty text is one piece with the closing id alone; very long
texts become many pieces; equal rows are packed as often as they occur; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .batches import text_slices
from .store import Workspace, power_of_two

CAPACITY = 1024
#: Pieces of one cell, at the most likely.
CELL_PIECES = 50_000

PIECES = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.LongType(), False) for n in ("start", "length", "ids_crc32", "doc_tokens")]
)
PIECES_IDS = T.StructType([*PIECES.fields, T.StructField("ids", T.BinaryType(), False)])


def _cut(ranks_path: str, pattern: str, closing: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder
        from .wordhash import buffers

        schema = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
        for batch in text_slices(batches):
            ids, at = encoder(ranks_path, pattern).batch(*buffers(batch.column("text")))
            n = batch.num_rows
            size = np.diff(at) + 1
            stream = np.empty(int(size.sum()), "<u4")
            begin = np.cumsum(size) - size
            mask = np.ones(len(stream), bool)
            mask[begin + size - 1] = False
            stream[mask] = ids
            stream[~mask] = closing
            pieces = -(-size // capacity)
            doc = np.repeat(np.arange(n), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(capacity, size[doc] - start)
            view = memoryview(stream).cast("B")
            where = ((begin[doc] + start) * 4).tolist()
            spans = [view[a : a + 4 * k] for a, k in zip(where, length.tolist(), strict=True)]
            columns = [
                batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array([zlib.crc32(x) for x in spans], pa.int64()),
                pa.array(size[doc], pa.int64()),
            ]
            if keep_ids:
                columns.append(pa.array([bytes(x) for x in spans], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema)

    return run


def cut_documents(docs: DataFrame, ranks_path: str, pattern: str, closing: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document; with keep_ids also their ids as little-endian unsigned 32-bit."""
    run = _cut(ranks_path, pattern, closing, capacity, keep_ids)
    return docs.select("doc_id", "text").mapInArrow(run, PIECES_IDS if keep_ids else PIECES)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns as (count, {length: occurrences}) whose slots are exactly the histogram's lengths.

    Lengths go longest first into the patterns with the most room. A pattern
    that is needed only in part is split in two; what fits nowhere opens new
    patterns, each filled with the length as often as it goes in evenly.
    """
    by_room: list[dict[tuple[tuple[int, int], ...], int]] = [{} for _ in range(capacity + 1)]

    def place(pattern: tuple[tuple[int, int], ...], room: int, count: int) -> None:
        by_room[room][pattern] = by_room[room].get(pattern, 0) + count

    def extended(pattern: tuple[tuple[int, int], ...], length: int, times: int) -> tuple[tuple[int, int], ...]:
        grown = Counter(dict(pattern))
        grown[length] += times
        return tuple(sorted(grown.items()))

    for length in sorted((k for k in histogram if histogram[k] > 0), reverse=True):
        left = histogram[length]
        for room in range(capacity, length - 1, -1):
            while left and by_room[room]:
                pattern, count = by_room[room].popitem()
                times = min(room // length, max(1, left // count))
                used = min(count, left // times)
                if used < count:
                    place(pattern, room, count - used)
                place(extended(pattern, length, times), room - times * length, used)
                left -= used * times
            if not left:
                break
        while left:
            times = min(capacity // length, left)
            count = left // times
            place(((length, times),), capacity - times * length, count)
            left -= count * times
    return [(count, dict(p)) for room in by_room for p, count in room.items()]


def slot_rows(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, times, first sequence, offset): ranks [low, high) of a length
    fill `times` slots in a row, from `offset` on, in each of a pattern's sequences."""
    rows, used, sequence = [], Counter(), 0
    for count, pattern in sorted(patterns, key=lambda p: (sorted(p[1].items(), reverse=True), p[0])):
        offset = 0
        for length, times in sorted(pattern.items(), reverse=True):
            low = used[length]
            used[length] = low + count * times
            rows.append((length, low, used[length], times, sequence, offset))
            offset += length * times
        sequence += count
    return rows


def pack_pieces(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, start, length, ...) that is cheap to read again."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    patterns = shortest_pack_first({k: n for k, n in histogram.items() if k < capacity}, capacity)
    if histogram.get(capacity):
        patterns.append((histogram[capacity], {capacity: 1}))
    slots = spark.createDataFrame(
        slot_rows(patterns), "slot_length long, low long, high long, times long, first_sequence long, first_offset long"
    )
    cells = power_of_two(total / CELL_PIECES, 256, 1 << 20)
    cell = F.pmod(F.xxhash64("doc_id", "start"), F.lit(cells))
    placed = pieces.withColumn("_cell", cell)
    before = W.partitionBy("length").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy("length", "_cell").agg(F.count("*").alias("_n"))
    offsets = counts.select("length", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("length", "_cell").orderBy("doc_id", "start", "ids_crc32")
    ranked = placed.join(offsets, ["length", "_cell"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1)
    # at most one row for each length of each pattern, which the capacity bounds
    hit = (F.col("length") == F.col("slot_length")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high"))
    step = F.col("_rank") - F.col("low")
    return ranked.join(F.broadcast(slots), hit).select(
        *pieces.columns,
        (F.col("first_sequence") + F.expr("(_rank - low) div times")).alias("sequence_id"),
        (F.col("first_offset") + F.pmod(step, F.col("times")) * F.col("length")).alias("offset"),
    )


def pack_documents(
    spark: SparkSession, docs: DataFrame, *, ranks_path: str, pattern: str, closing: int = 0, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece (and ids)."""
    ws = Workspace(spark, "pack")
    pieces = ws.put(cut_documents(docs, ranks_path, pattern, closing, capacity, keep_ids), "pieces")
    return pack_pieces(spark, pieces, capacity)


def public_vocabulary() -> tuple[str, str]:
    """Ranks and pattern of the byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks_path, pattern = public_vocabulary()
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks_path=ranks_path, pattern=pattern)
