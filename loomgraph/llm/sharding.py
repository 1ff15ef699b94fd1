"""Sharding by sampled splitters."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, parts_for

#: Ranges per partition of the exchange, expected samples per range, and times the mean size from which a range is subdivided.
RANGES, SAMPLES, OVERFULL = 4, 16, 2.0
_ROUNDS = 6


def record_key(text: str):
    """The first 60 bits of the text's MD5: equal texts are neighbours."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(text), F.lit(""))), 1, 15), 16, 10).cast("long")


def _ranges(splitters: list[tuple[int, int]]):
    """A column function: how many splitters a (key, id) has at or below it."""
    high = np.array([x[0] for x in splitters], np.int64)
    low = np.array([x[1] for x in splitters], np.int64)

    @F.pandas_udf("int")
    def place(key: pd.Series, own: pd.Series) -> pd.Series:
        k, d = key.to_numpy(), own.to_numpy()
        out = np.searchsorted(high, k, "left")
        ends = np.searchsorted(high, k, "right")
        for a in np.unique(out[ends > out]):
            rows = np.flatnonzero((out == a) & (ends > out))
            out[rows] = a + np.searchsorted(low[a : ends[rows[0]]], d[rows], "right")
        return pd.Series(out.astype(np.int32))

    return place


def range_partition(records: DataFrame, ranges: int) -> tuple[DataFrame, list]:
    """``records`` (key, id, weight: long) with its range (``part``), and the (part, weight, rows) of every range in order.

    Keys are drawn with odds proportional to weight by a hash of the record, so that reruns
    agree: about SAMPLES * ranges of them. Quantiles of the draw split the keys; only these, one
    per range, come to the driver. Ranges over OVERFULL times the mean are drawn from again, so
    much more densely, and subdivided, until none is left that has two different keys.
    """
    total = records.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    if not total:
        return records.withColumn("part", F.lit(0)), records.groupBy(F.lit(0).alias("part")).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("rows")).collect()
    splitters: list[tuple[int, int]] = []
    parts, over, sizes = records.withColumn("part", F.lit(0)), [(0, total)], []
    for turn in range(_ROUNDS):
        rate = SAMPLES * ranges / total
        luck = F.pmod(F.xxhash64("key", "id", F.lit(turn)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        drawn = parts.where(F.col("part").isin([p for p, _ in over]) & (luck < F.col("weight") * rate))
        cuts = records.sparkSession.createDataFrame([(part, max(2, round(weight * ranges / total))) for part, weight in over], "part int, cuts long")
        drawn = drawn.select("part", "key", "id").distinct().join(F.broadcast(cuts), "part")
        own = Window.partitionBy("part").orderBy("key", "id")
        drawn = drawn.select("key", "id", "cuts", (F.row_number().over(own) - 1).alias("nth"), F.count(F.lit(1)).over(Window.partitionBy("part")).alias("n"))
        # the first record of each quantile but the lowest
        fresh = [(r["key"], r["id"]) for r in drawn.where("nth * cuts div n > (nth - 1) * cuts div n and nth > 0").select("key", "id").collect()]
        before = len(splitters)
        splitters = sorted({*splitters, *fresh})
        parts = records.withColumn("part", _ranges(splitters)("key", "id"))
        sizes = sorted(parts.groupBy("part").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("rows")).collect())
        over = [(p, w) for p, w, n in sizes if w > OVERFULL * total / ranges and n > 1]
        if not over or (turn and len(splitters) == before):
            break
    return parts, sizes


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): every row of ``docs`` in one of ``shards`` shards of near equal bytes.

    A record's size is the text's UTF-8 bytes (null: none) plus ``overhead``. Records are
    ordered by (60 bits of the text's MD5, id), so equal texts are neighbours, and range-
    partitioned by sampled splitters. The bytes before a record, summed over ranges on the
    driver and inside its range by a window, say its shard: ``before * shards // total``. So a
    shard's bytes are off the mean by less than one record's, whatever the sample. ``slot``
    counts a shard's records from 0 in the same order. A group of copies that outgrows a range
    is split by id. Null ids come first; rows that repeat id and text are tied, take neighbouring
    slots and are alike, so reruns agree. No rows give none. The law is ``bytes``; grown_shard
    is null.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = F.col(id_col).cast("long")
    records = docs.select(record_key(text_col).alias("key"), F.coalesce(given, F.lit(-(1 << 63))).alias("id"), given.isNull().alias("none"), (F.octet_length(text) + overhead).cast("long").alias("weight"), F.crc32(text).alias("crc"))
    records = scratch.table(records, "records")
    ranges = RANGES * max(parts_for(records), shards)
    parts, sizes = range_partition(records, ranges)
    weight_at, rows_at = 0, 0
    starts = []
    for part, weight, n in sizes:
        starts.append((part, weight_at, rows_at))
        weight_at, rows_at = weight_at + weight, rows_at + n
    at = docs.sparkSession.createDataFrame(starts, "part int, weight_at long, rows_at long")
    inside = Window.partitionBy("part").orderBy("key", "none", "id", "weight", "crc").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("sum", F.sum("weight").over(inside)).withColumn("nth", F.count(F.lit(1)).over(inside)).join(F.broadcast(at), "part")
    number = F.expr(f"(weight_at + sum - weight) * {shards} div {max(weight_at, 1)}")
    placed = placed.select(F.when(~F.col("none"), F.col("id")).alias(id_col), F.col("weight").alias("size"), F.col("crc").alias("text_crc32"), number.cast("int").alias("shard"), (F.col("rows_at") + F.col("nth") - 1).alias("nth"))
    placed = scratch.table(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
