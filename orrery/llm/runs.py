"""Rows of a sorted partition as whole groups, in bounded blocks."""

from __future__ import annotations

import pyarrow as pa


def grouped(batches, key: str):
    """Arrow tables that hold whole runs of ``key`` from batches in the order of ``key``; only the last run of a batch waits for the next one."""
    wait: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key)
        last = keys[-1]
        if keys[0] == last and (not wait or wait[-1].column(key)[-1] == last):
            wait.append(b)
            continue
        lo = first_of_last(keys)
        yield pa.Table.from_batches([*wait, b.slice(0, lo)])
        wait = [b.slice(lo)]
    if wait:
        yield pa.Table.from_batches(wait)


def first_of_last(keys: pa.Array) -> int:
    """Where the last run of equal keys begins."""
    import numpy as np

    k = keys.to_numpy(zero_copy_only=False)
    differ = np.nonzero(k != k[-1])[0]
    return int(differ[-1]) + 1 if len(differ) else 0
