"""Whole groups out of partitions that are sorted by their key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups, `rows` rows at least but for the last; the rows of a group must be adjacent."""
    held: list[pa.RecordBatch] = []

    def last(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(k)[i].as_py() for k in keys)

    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        cut = 0
        if n + b.num_rows >= rows:
            change = np.zeros(b.num_rows, bool)
            for k in keys:
                v = b.column(k).to_numpy(zero_copy_only=False)
                change[1:] |= v[1:] != v[:-1]
            change[0] = bool(held) and last(held[-1], held[-1].num_rows - 1) != last(b, 0)
            at = np.flatnonzero(change)
            cut = int(at[-1]) if len(at) else -1
            if cut >= 0 and (cut or held):
                yield pa.Table.from_batches([*held, b.slice(0, cut)] if cut else held)
                held, n = [], 0
            cut = max(cut, 0)
        held.append(b.slice(cut))
        n += b.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def bounds(*columns: np.ndarray) -> np.ndarray:
    """Where each group of equal adjacent rows begins, and the end."""
    change = np.ones(len(columns[0]), bool)
    change[1:] = False
    for v in columns:
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), len(change))
