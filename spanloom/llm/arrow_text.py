"""Views of Arrow string columns as bytes, for operators that work in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once where arrays several times as large are made of them.
WORK_BYTES = 1 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of the column in one array, and the n + 1 offsets of the texts in it (null: empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs_of_rows(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold about most_bytes; a longer text stands alone."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def small_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts hold about most_bytes together, so that what is made of them stays small."""
    for batch in batches:
        if batch.num_rows:
            _, offsets = text_bytes(batch.column("text"))
            for a, b in runs_of_rows(offsets, most_bytes):
                yield batch.slice(a, b - a)
