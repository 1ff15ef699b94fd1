"""Messages of packed arrays that tasks send each other: (to, kind, a, b, c, d), ``to`` being the partition that gets it."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MESSAGE = "to int, kind int, a binary, b binary, c binary, d binary"
_NAMES = [x.split()[0] for x in MESSAGE.split(", ")]
_TYPES = (pa.int32(), pa.int32(), *[pa.binary()] * 4)


def batch(messages: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*messages, strict=True), _TYPES, strict=True)], _NAMES)


def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(to, kind, a, b, c, d) of every message; the binaries are buffers of the batch, not copies, or None."""
    for given in batches:
        to, kind = given.column(0).to_pylist(), given.column(1).to_pylist()
        for i in range(given.num_rows):
            yield (to[i], kind[i], *[given.column(c)[i].as_buffer() if given.column(c)[i].is_valid else None for c in range(2, 6)])


def send(rows: DataFrame, parts: int) -> DataFrame:
    """Every message in the partition it names."""
    return rows.repartitionById(parts, "to")


def planes(x: np.ndarray) -> bytes:
    """Sorted 64-bit values byte by byte: all first bytes, all second bytes, ... The leading bytes hardly change, and so shrink when compressed."""
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(raw) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def narrow(place: np.ndarray, n: int) -> bytes:
    """Places below ``n`` in two bytes each if they fit, else in four."""
    return place.astype(np.uint16 if n <= 1 << 16 else np.uint32).tobytes()


def wide(raw, count: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * count else np.uint32)
