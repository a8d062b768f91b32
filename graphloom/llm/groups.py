"""Groups of rows inside a task, read as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs_of_rows(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows of equal keys in sorted batches; one run is held at a time, so the caller bounds its size."""
    open_parts: list[pa.RecordBatch] = []
    open_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(c[a] for c in columns)
            if open_parts and key != open_key:
                yield pa.Table.from_batches(open_parts)
                open_parts = []
            open_parts.append(batch.slice(a, b - a))
            open_key = key
    if open_parts:
        yield pa.Table.from_batches(open_parts)
