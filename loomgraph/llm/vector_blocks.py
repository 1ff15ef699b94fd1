"""Whole-number vectors, packed in blocks."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A component x becomes floor(SCALE * x); one of LIMIT or more either way has no place in a long's sums of squares and products.
SCALE, LIMIT = 256, 1 << 25


def sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are, and are finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def in_range(vector: Column) -> Column:
    """Whether all scaled components are within LIMIT."""
    return F.forall(vector.cast("array<double>"), lambda x: F.abs(x) * SCALE < LIMIT)


def whole_numbers(column: pa.Array) -> np.ndarray:
    """(rows, length) of ``floor(SCALE * x)`` of vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat.reshape(len(column), len(flat) // max(1, len(column))) * SCALE).astype(np.int64)


def by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by the length of their vectors."""
    lengths = np.diff(batch.column(column).offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
    for n in np.unique(lengths).tolist():
        yield n, batch.filter(pa.array(lengths == n))
