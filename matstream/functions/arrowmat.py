"""Small helpers to move a batch of rows between Arrow and numpy inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_matrix(col: pa.Array, d: int | None = None) -> np.ndarray:
    """A list<double> Arrow column as an (n, d) float64 array (rows of equal width)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if col.null_count:
        raise ValueError("matrix holds null rows")
    offsets = col.offsets.to_numpy()
    widths = np.diff(offsets)
    if n and (widths.min() != widths.max() or (d is not None and widths[0] != d)):
        raise ValueError("rows have different widths")
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if d is None:
        d = int(widths[0]) if n else 0
    return flat.reshape(n, d)


def from_matrix(m: np.ndarray) -> pa.Array:
    """An (n, d) float64 array as a list<double> Arrow column."""
    m = np.ascontiguousarray(m, dtype=np.float64)
    n, d = m.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32) if n * d < 2**31
                       else np.arange(0, (n + 1) * d, d, dtype=np.int64))
    values = pa.array(m.reshape(-1))
    if offsets.type == pa.int64():
        return pa.LargeListArray.from_arrays(offsets, values).cast(pa.list_(pa.float64()))
    return pa.ListArray.from_arrays(offsets, values)
