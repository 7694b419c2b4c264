"""Arrow batches as NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix_of(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Columns as a matrix of doubles, missing values NaN; one array column gives the whole matrix."""
    if len(names) == 1 and pa.types.is_list(batch.column(names[0]).type):
        rows = batch.column(names[0])
        sizes = np.diff(rows.offsets.to_numpy())
        if rows.null_count or (sizes != sizes[:1]).any():
            raise ValueError(f"rows of {names[0]} differ in length")
        return rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names])
