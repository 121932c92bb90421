"""Sorted Arrow batches, cut into runs of equal key, so that a task holds no more of a group than it must."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Pieces of the batches within which all integer columns ``keys`` are constant, and their values. A run that
    spans batches comes in several pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows - 1, dtype=bool)
        for column in columns:
            changed |= column[1:] != column[:-1]
        bounds = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for start, end in zip(bounds, bounds[1:]):
            yield tuple(int(c[start]) for c in columns), batch.slice(start, end - start)


def unused_name(names: list[str], base: str = "_text") -> str:
    """A column name that none of ``names`` equals, whatever the case."""
    known = {n.lower() for n in names}
    while base in known:
        base += "_"
    return base
