"""Streams with state: what comes out after a failure and a restart equals the batch."""

import datetime as dt
import random

import pytest

from loomgraph.streaming import dedup_stream, run_stream, session_stream, use_rocks
from loomgraph.streaming.stateful import join_sessions

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def batches(events, gap):
    """Closed sessions of (key, minute) by a batch, where the watermark is 10 minutes behind the latest."""
    out, mark = [], max(m for _, m in events if m is not None) - 10
    for k in {k for k, _ in events}:
        times = sorted(m for key, m in events if key == k and m is not None)
        for first, last, n in join_sessions([(m, m, 1) for m in times], gap):
            if last + gap <= mark:
                out.append((str(k), first, last, n))
    return sorted(out)


def test_sessions_survive_a_failure(spark, tmp_path):
    use_rocks(spark)
    rng = random.Random(5)
    gap = 20
    minutes = sorted(rng.randrange(0, 900) for _ in range(200))
    late = (3, 1)
    events = [(rng.choice([1, 1, 1, 2, None]), m) for m in minutes] + [late, (2, None), (3, 2000), (3, 3000)]
    parts = [events[:80], events[80:150], events[150:]]
    folder, checkpoint, out = (str(tmp_path / x) for x in ("in", "checkpoint", "out"))
    fallen = []

    def fail(number):
        if number == 2 and not fallen:
            fallen.append(number)
            raise RuntimeError("the executor was lost")

    for i, part in enumerate(parts):
        rows = [(k, None if m is None else at(m)) for k, m in part]
        rng.shuffle(rows)
        spark.createDataFrame(rows, "user long, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("user long, ts timestamp").parquet(folder)
        while True:
            query = run_stream(session_stream(stream, "user", "ts", gap * 60), out, checkpoint, fail)
            try:
                query.awaitTermination()
                break
            except Exception as e:
                assert "the executor was lost" in str(e) and i < 3
    assert fallen == [2]
    got = spark.read.schema("user long, first long, last long, events long").parquet(out).collect()
    begin = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    assert sorted((str(r["user"]), (r["first"] // 1_000_000 - begin) // 60, (r["last"] // 1_000_000 - begin) // 60, r["events"]) for r in got) == batches([e for e in events if e != late], gap)


def test_repeats_are_dropped_once(spark, tmp_path):
    folder, checkpoint, out = (str(tmp_path / x) for x in ("in", "checkpoint", "out"))
    for rows in ([(1, at(0)), (1, at(1)), (2, at(2))], [(2, at(3)), (None, at(4)), (None, at(5)), (3, at(6))], [(9, at(200))], [(1, at(300)), (1, at(301))]):
        spark.createDataFrame(rows, "k long, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("k long, ts timestamp").parquet(folder)
        run_stream(dedup_stream(stream, ["k"], "ts"), out, checkpoint).awaitTermination()
    assert sorted(str(r["k"]) for r in spark.read.parquet(out).collect()) == ["1", "1", "2", "3", "9", "None"]


@pytest.mark.parametrize("gap", [0, 3])
def test_joined_sessions(gap):
    rng = random.Random(gap)
    times = [rng.randrange(60) for _ in range(25)]
    whole = join_sessions([(t, t, 1) for t in times], gap)
    assert sum(n for *_, n in whole) == 25 and all(b[0] - a[1] > gap for a, b in zip(whole, whole[1:], strict=False))
    for cut in range(25):
        held = join_sessions([(t, t, 1) for t in times[:cut]], gap)
        assert join_sessions(held + join_sessions([(t, t, 1) for t in times[cut:]], gap), gap) == whole


def test_sessions_of_a_bucket_are_those_of_its_keys(monkeypatch):
    import pyarrow as pa

    from loomgraph.streaming import stateful

    rng = random.Random(2)
    events = [(rng.choice(["a", "b", None]), rng.randrange(200)) for _ in range(60)]
    keys, times = zip(*events)
    got = stateful._joined(pa.table([pa.array(keys, pa.string()), times, times, [1] * 60], schema=stateful._OPEN), 3)
    want = [(k, *s) for k in ("a", "b", None) for s in join_sessions([(t, t, 1) for key, t in events if key == k], 3)]
    assert sorted(map(str, zip(*(c.to_pylist() for c in got.columns)))) == sorted(map(str, want))


def test_sessions_with_many_keys_of_a_bucket(spark, tmp_path, monkeypatch):
    from loomgraph.streaming import stateful

    monkeypatch.setattr(stateful, "BUCKETS", 2)
    use_rocks(spark)
    folder, checkpoint, out = (str(tmp_path / x) for x in ("in", "checkpoint", "out"))
    big = 2**60
    for rows in ([(big + k, at(m)) for k in range(20) for m in (0, 5)], [(None, at(300)), (big, at(301))]):
        spark.createDataFrame(rows, "k long, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("k long, ts timestamp").parquet(folder)
        run_stream(session_stream(stream, "k", "ts", 600), out, checkpoint).awaitTermination()
    assert sorted((r["k"], r["events"]) for r in spark.read.parquet(out).collect()) == [(big + k, 2) for k in range(20)]
