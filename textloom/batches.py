"""Arrow batches in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

SLICE = 1024  # rows that are Python objects at a time
SLICE_BYTES = 8 << 20  # and their size; a single longer row is a slice of its own


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows and `most` bytes, but for single rows that have more."""
    for batch in batches:
        todo = [batch.slice(k, rows) for k in range(0, batch.num_rows, rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > most:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part
