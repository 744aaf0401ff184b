"""Arrow batches of bounded size: what Spark hands over is taken in pieces, and results are sent on before they are many or large."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

SENT = 1024  # rows that are sent on at once
SENT_BYTES = 4 << 20  # or fewer, as soon as they hold so many bytes


def weight(value) -> int:
    """About the bytes of a value."""
    if isinstance(value, (bytes, bytearray, str)):
        return len(value)
    if isinstance(value, dict):
        return sum(map(weight, value.values()))
    if isinstance(value, (list, tuple)):
        return sum(map(weight, value))
    return getattr(value, "nbytes", 8)


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of batches in lists of at most SENT rows, and of about SENT_BYTES unless a row is larger."""
    for batch in batches:
        n = max(1, min(SENT, batch.num_rows * SENT_BYTES // max(batch.nbytes, 1)))
        for k in range(0, batch.num_rows, n):
            yield batch.slice(k, n).to_pylist()
        del batch  # before the next one is read
        pa.default_memory_pool().release_unused()


def sent(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches, each sent on as soon as it has SENT rows or SENT_BYTES."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += weight(row)
        if len(out) == SENT or size >= SENT_BYTES:
            yield from pa.Table.from_pylist(out, schema=schema).to_batches()
            out, size = [], 0
    if out:
        yield from pa.Table.from_pylist(out, schema=schema).to_batches()
