"""Batches of rows cut by the bytes of their texts, so that a task's memory doesn't go by how many rows, or how long ones, a batch has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task takes at a time (a longer text is taken alone).
SLICE_BYTES = 1 << 20


def sliced(batches: Iterator[pa.RecordBatch], text: str, told: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `told` makes of consecutive rows of the batches."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < len(batch):
            past = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, past + SLICE_BYTES, "right")))
            yield told(batch.slice(begin, end - begin))
            begin = end
        # kept for the next batch otherwise
        pa.default_memory_pool().release_unused()
