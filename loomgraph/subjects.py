"""Subjects: named tables whose batches and row order are part of their meaning."""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import state_path, store

BATCH, ROW = "_batch_id", "_row_id"
HIDDEN = (BATCH, ROW)


def visible(df: DataFrame) -> DataFrame:
    """``df`` without batch and row numbers."""
    return df.drop(*HIDDEN)


def same_schema(a: DataFrame, b: DataFrame) -> bool:
    """Equal names and types in equal order; nullability aside."""
    kinds = lambda df: [(f.name, f.dataType.simpleString()) for f in visible(df).schema]
    return kinds(a) == kinds(b)


def with_batches(df: DataFrame, batch: int = 0) -> DataFrame:
    """``df`` with batch and row numbers: one batch in its own order, if it has none yet."""
    if BATCH in df.columns:
        return df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())
    return df.withColumn(BATCH, F.lit(batch).cast("long")).withColumn(ROW, F.monotonically_increasing_id())


def last_batch(df: DataFrame) -> DataFrame:
    """The rows of the last batch. One small aggregate finds it and is broadcast, one row."""
    top = df.agg(F.max(BATCH).alias("_top"))
    return df.join(F.broadcast(top), F.col(BATCH) == F.col("_top")).drop("_top")


def first_batch(df: DataFrame) -> DataFrame:
    top = df.agg(F.min(BATCH).alias("_top"))
    return df.join(F.broadcast(top), F.col(BATCH) == F.col("_top")).drop("_top")


def first_row(df: DataFrame) -> DataFrame:
    order = [c for c in HIDDEN if c in df.columns]
    return df.orderBy(*order).limit(1) if order else df.limit(1)


def concat_batches(df: DataFrame) -> DataFrame:
    """All rows in one batch, in order, numbered from 0."""
    df = with_batches(df)
    return numbered(df.orderBy(*HIDDEN).drop(ROW), ROW).withColumn(BATCH, F.lit(0).cast("long")).select(*df.columns)


def replace_first_value(df: DataFrame, column: str, value: Column) -> DataFrame:
    """The first row with another value in ``column``, of its type."""
    return first_row(df).withColumn(column, value.cast(dict(df.dtypes)[column]))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its rows' places from 0 in its own order. It is stored, its partitions' sizes are summed up, and rows add where their partition begins."""
    rows, _ = store(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("_part", part).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return out.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def _running(target: int):
    """(batch, rows) in order to (batch, new batch, rows before it): two numbers cross from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = filled = before = 0
        for given in batches:
            sizes = given.column(1).to_pylist()
            to, at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for i, n in enumerate(sizes):
                to[i], at[i] = new, before
                filled, before = filled + n, before + n
                if filled >= target:
                    new, filled = new + 1, 0
            yield pa.RecordBatch.from_arrays([given.column(0), pa.array(to), pa.array(at)], [BATCH, "_new", "_before"])

    return run


def assign_batches(df: DataFrame, target: int, fetch: int | None = None) -> DataFrame:
    """Coalesce small batches: consecutive ones join until they have ``target`` rows or more; ``fetch`` limits the rows.

    Which batches join depends on all before them, so one task reads the batches' sizes, one
    number each, in order, and holds none; rows look up their new batch by a join.
    """
    df = with_batches(df)
    sizes = df.groupBy(BATCH).agg(F.count(F.lit(1)).alias("n")).repartition(1).sortWithinPartitions(BATCH)
    at = sizes.mapInArrow(_running(target), f"{BATCH} long, _new long, _before long")
    nth = F.col("_before") + F.row_number().over(Window.partitionBy(BATCH).orderBy(ROW))
    out = df.join(at, BATCH).withColumn(ROW, nth)
    if fetch is not None:
        out = out.where(F.col(ROW) <= fetch)
    return out.withColumn(BATCH, F.col("_new")).select(*df.columns)


@dataclass
class Subject:
    """A named table; ``df`` has batch and row numbers, ``next_batch`` is the first free one, ``paths`` the folders it was stored in, if it was."""

    name: str
    df: DataFrame
    next_batch: int = field(default=-1)
    paths: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        self.df = with_batches(self.df)
        if self.next_batch < 0:
            self.next_batch = (self.df.agg(F.max(BATCH)).first()[0] or 0) + 1

    @classmethod
    def stored(cls, name: str, df: DataFrame, before: "Subject | None" = None) -> "Subject":
        """A subject of the rows of ``df``, after those of ``before``: only rows that have no folder yet are written."""
        spark, paths = df.sparkSession, list(before.paths) if before is not None else []
        if before is not None and not paths:
            paths = [state_path(spark)]
            store(before.df, paths[0])
        paths.append(state_path(spark))
        store(df, paths[-1])
        return cls(name, spark.read.schema(df.schema).parquet(*paths), paths=tuple(paths))

    @property
    def data(self) -> DataFrame:
        return visible(self.df)

    @property
    def schema(self) -> T.StructType:
        return self.data.schema

    def count_rows(self) -> int:
        return self.df.count()

    def count_batches(self) -> int:
        return self.df.select(BATCH).distinct().count()

    def column_as_strings(self, name: str) -> list[str]:
        """A column's values in order, null as the empty string; for small control tables."""
        return [r[0] for r in self.df.orderBy(*HIDDEN).select(F.coalesce(F.col(name).cast("string"), F.lit(""))).collect()]
