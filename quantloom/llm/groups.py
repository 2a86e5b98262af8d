"""Consecutive rows of one key, for use inside Arrow tasks over sorted partitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of ``key`` (integers without nulls) as one table; equal values must follow each other."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        values = batch.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)] if len(values) else []
        for low, high in zip(edges, edges[1:]):
            if held and values[low] != at:
                yield pa.Table.from_batches(held)
                held = []
            at = values[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)
