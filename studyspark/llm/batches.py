"""Slices of Arrow batches bounded by text size, so that long texts don't fill a worker's memory."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Arrays of so many characters stay in a processor's cache.
CHARS_PER_SLICE = 150_000


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHARS_PER_SLICE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive rows whose texts have about ``most`` characters in all (one text may have more); null texts become empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t) + 16
            if size >= most:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]
