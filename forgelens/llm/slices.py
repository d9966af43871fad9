"""Arrow batches cut by the bytes of their texts, so that what a worker holds doesn't follow the length of texts or the number of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts in a slice (one longer text is a slice of its own), and what a row counts besides its texts.
SLICE_BYTES, ROW_BYTES = 1 << 20, 64


def by_bytes(batches: Iterator[pa.RecordBatch], *columns: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches in their order; columns: the places of the text or binary columns that count. Empty batches go."""
    for b in batches:
        sizes = sum((pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns), np.full(b.num_rows, ROW_BYTES, np.int64))
        ends, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield b.slice(at, to - at)
            at = to
