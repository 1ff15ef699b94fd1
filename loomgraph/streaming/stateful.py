"""Event-time state with timers: sessions that close when the watermark passes, and rows of which each is kept once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Buckets of keys; a stream goes on from its checkpoint with as many as it began with.
BUCKETS = 4096
_OPEN = pa.schema({"key": pa.string(), "first": pa.int64(), "last": pa.int64(), "events": pa.int64()})


def join_sessions(open_: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first, last, events) that are no more than ``gap`` apart, as one; rising."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(open_):
        if out and first <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


def _joined(rows: pa.Table, gap: int) -> pa.Table:
    """``join_sessions`` of many keys, (key, first, last, events), at once."""
    code = rows.column("key").combine_chunks().dictionary_encode("encode").indices.to_numpy()
    first, last, events = (rows.column(c).to_numpy() for c in ("first", "last", "events"))
    order = np.lexsort((first, code))
    code, first, last, events = code[order], first[order], last[order], events[order]
    upto = pd.Series(last).groupby(code).cummax().to_numpy()
    start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (first[1:] > upto[:-1] + gap)])
    return pa.table({"key": rows.column("key").take(pa.array(order[start])), "first": first[start], "last": np.maximum.reduceat(last, start), "events": np.add.reduceat(events, start)})


class _Sessions(StatefulProcessor):
    """The open sessions of a bucket of keys, (key, first, last, events) in microseconds, as one packed value; a timer a bucket, for the one that ends first."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "rows binary, timer bigint")

    def _held(self) -> tuple[pa.Table, int]:
        raw, timer = self.open.get() or (None, None)
        return (_OPEN.empty_table() if raw is None else pa.ipc.open_stream(bytes(raw)).read_all()), timer

    def _keep(self, sessions: pa.Table, timer: int | None) -> None:
        """``timer`` is the one that is set."""
        if not sessions.num_rows:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.open.clear()
            return
        # a timer has whole milliseconds
        due = -(-(int(sessions.column("last").to_numpy().min()) + self.gap) // 1000)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, sessions.schema) as out:
            out.write_table(sessions)
        self.open.update((sink.getvalue().to_pybytes(), due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        found = [held]
        for part in rows:
            # columns come in order, but made ones not under their names
            at = part.iloc[:, 3].to_numpy(np.int64)
            found.append(_joined(pa.table([pa.array(part.iloc[:, 1], pa.string(), from_pandas=True), at, at, np.ones(len(at), np.int64)], schema=_OPEN), self.gap))
        self._keep(_joined(pa.concat_tables(found), self.gap), timer)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = int(timerValues.getCurrentWatermarkInMs()) * 1000
        held, _ = self._held()
        done = held.column("last").to_numpy() + self.gap <= mark
        # the timer that has expired goes by itself
        self._keep(held.filter(pa.array(~done)), None)
        if done.any():
            yield held.filter(pa.array(done)).to_pandas()

    def close(self) -> None:
        pass


def _as_text(key: Column, kind: str) -> tuple[Column, Callable[[Column], Column]]:
    """A key as a text, and how it is read back."""
    if kind == "timestamp":
        return F.unix_micros(key).cast("string"), lambda c: F.timestamp_micros(c.cast("long"))
    if kind == "binary":
        return F.base64(key), F.unbase64
    if kind.startswith(("struct", "array")):
        return F.to_json(F.struct(key.alias("k"))), lambda c: F.from_json(c, f"k {kind}")["k"]
    return key.cast("string"), lambda c: c.cast(kind)


def use_rocks(spark: SparkSession) -> None:
    """State of a stream in RocksDB, which keeps it on disk and its changes in the checkpoint folder."""
    spark.conf.set(_STORE, ROCKS)


def session_stream(stream: DataFrame, key: str, time: str, gap_seconds: float, late: str = "10 minutes") -> DataFrame:
    """(key, first, last, events) of every session of a key, once, when the watermark, ``late`` behind the latest time, has passed its last event by ``gap_seconds``.

    ``time`` is a timestamp; first and last are microseconds since 1970. The open sessions are the state, in RocksDB (``use_rocks``): events may come in any order, and
    join sessions as a batch would, as long as they are not later than the watermark; later ones are dropped. A timer closes a session without another event. State and timers are in the
    checkpoint, so a restart goes on where it was. Keys are dealt to BUCKETS, whose open sessions are one packed value, so the state is read and written once a bucket and micro-batch, however many keys there are; it holds open sessions, not events. Null keys are one key; rows with a null time are dropped.
    """
    kind = stream.schema[key].dataType.simpleString()
    text, back = _as_text(F.col(f"`{key}`"), kind)
    rows = stream.where(F.col(time).isNotNull()).withWatermark(time, late).select(F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int").alias("_bucket"), text.alias("_key"), time, F.unix_micros(time).alias("_at"))
    made = rows.groupBy("_bucket").transformWithStateInPandas(_Sessions(int(gap_seconds * 1_000_000)), "key string, first long, last long, events long", "Append", "EventTime")
    return made.select(back(F.col("key")).alias(key), "first", "last", "events")


def dedup_stream(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of every key that comes within ``late`` of another's time: what is sent again soon is dropped, and the state forgets a key when the watermark has passed it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_stream(made: DataFrame, path: str, checkpoint: str, fail: Callable[[int], None] | None = None) -> StreamingQuery:
    """Run a stream over all there is, a folder of ``path`` a micro-batch: a batch that runs again after a restart writes its folder again. ``fail`` gets each batch's number before it is written."""

    def write(rows: DataFrame, number: int) -> None:
        if fail is not None:
            fail(number)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return made.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
