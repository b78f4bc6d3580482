"""Runs of equal leading columns in a stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[pa.Array]]:
    """Columns of each run of rows with equal integer leading columns, runs that span batches included."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(n_keys)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[a])
            if held and key != last:
                yield _columns(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield _columns(held)


def _columns(held: list[pa.RecordBatch]) -> list[pa.Array]:
    return held[0].columns if len(held) == 1 else [c.combine_chunks() for c in pa.Table.from_batches(held).columns]
