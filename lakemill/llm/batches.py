"""Arrow batches of bounded text size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time.
SLICE_BYTES = 1 << 20


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of about `most` bytes of text; one longer text is a batch of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def combined(batch: pa.RecordBatch, column: str) -> pa.Array:
    found = batch.column(column)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no other column has, whatever its case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
