"""Arrow batches inside a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows whose Python objects a task holds at once, where each row becomes many of them.
PIECE_ROWS = 100


def pieces(batches: Iterable[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows: what is made of one is handed on before the next, so that a task's memory does
    not follow the size of Spark's batches. Pieces share their batch's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
