"""Semi and anti joins behind a Bloom filter, so that rows without a partner are not shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a key of the filter, and its bits at most: 64 MB. Under LEAST bits a key a filter would pass nearly all.
BITS, MOST, LEAST = 12, 1 << 29, 3
#: Bits of a slice of the filter; slices are built by different tasks.
_SLICE = 1 << 20


@dataclass
class Bloom:
    """``size`` bits, of which each key has ``hashes``; ``bits`` are packed bytes."""

    bits: np.ndarray
    size: int
    hashes: int

    def places(self, key: np.ndarray) -> np.ndarray:
        return places(key, self.size, self.hashes)

    def holds(self, key: np.ndarray) -> np.ndarray:
        at = self.places(key)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def places(key: np.ndarray, size: int, hashes: int) -> np.ndarray:
    """(hashes, keys): the bits of 64-bit hashes of keys."""
    key = key.astype(np.int64).view(np.uint64)
    step = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17) | np.uint64(1)
    return np.stack([((key + np.uint64(i) * step) % np.uint64(size)).astype(np.int64) for i in range(hashes)])


def _hash(keys: list[str]) -> Column:
    """Of a row's keys; null if one is null."""
    sound = F.lit(True)
    for k in keys:
        sound = sound & F.col(f"`{k}`").isNotNull()
    return F.when(sound, F.xxhash64(*[F.col(f"`{k}`") for k in keys]))


def build_bloom(right: DataFrame, keys: list[str], n: int | None = None) -> Bloom | None:
    """A filter of the keys of ``right``, of BITS bits a row, MOST at most; None where that is under LEAST bits a row.

    Every task sets its rows' bits, by slices; a slice's bytes are joined by the task that has it. Only the filter, whose size is bounded, comes to the driver. Null keys are not in it.
    """
    hashed = right.select(_hash(keys).alias("key")).where("key is not null")
    n = hashed.count() if n is None else n
    size = min(max(64, BITS * n), MOST)
    size = -(-size // 64) * 64
    if size < LEAST * n:
        return None
    hashes = max(1, min(8, round(0.69 * size / max(n, 1))))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.unique(places(batch.column(0).to_numpy(), size, hashes))
            for s in np.unique(at // _SLICE).tolist():
                bits = slices.setdefault(s, np.zeros(_SLICE, bool))
                bits[at[at // _SLICE == s] - s * _SLICE] = True
        for s, bits in slices.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

    def join_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw, np.uint8)
                slices[s] = slices[s] | own if s in slices else own
        if slices:
            yield pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int64()), pa.array([b.tobytes() for b in slices.values()], pa.binary())], ["slice", "bits"])

    kind = "slice long, bits binary"
    found = hashed.mapInArrow(set_bits, kind).repartition("slice").mapInArrow(join_bits, kind).collect()
    bits = np.zeros(-(-size // _SLICE) * (_SLICE // 8), np.uint8)
    for s, raw in found:
        bits[s * (_SLICE // 8) : (s + 1) * (_SLICE // 8)] = np.frombuffer(raw, np.uint8)
    return Bloom(bits, size, hashes)


def _might(df: DataFrame, keys: list[str], bloom: Bloom) -> DataFrame:
    """``df`` with whether the filter may hold a row's keys; false for null ones."""
    shared = df.sparkSession.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def holds(key: pd.Series) -> pd.Series:
        return pd.Series(shared.value.holds(key.to_numpy()))

    # a null among the hashes would make doubles of all of them
    key = _hash(keys)
    return df.withColumn("_might", holds(F.coalesce(key, F.lit(0).cast("long"))) & key.isNotNull())


def bloom_semi_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``left`` that have a partner in ``right``, each once. Rows that the filter rules out are not shuffled; the others are joined exactly. Null keys have no partner."""
    bloom = build_bloom(right, keys)
    rows = left if bloom is None else _might(left, keys, bloom).where("_might").drop("_might")
    return rows.join(right.select(*keys), keys, "left_semi").select(*left.columns)


def bloom_anti_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``left`` without a partner in ``right``. Those that the filter rules out are in the result where they are; the others are joined exactly. Rows with a null key stay."""
    bloom = build_bloom(right, keys)
    if bloom is None:
        return left.join(right.select(*keys), keys, "left_anti").select(*left.columns)
    rows = _might(left, keys, bloom)
    sure = rows.where(~F.col("_might")).select(*left.columns)
    return sure.unionAll(rows.where("_might").join(right.select(*keys), keys, "left_anti").select(*left.columns))
