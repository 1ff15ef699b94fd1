"""Joins and windows over hot keys against brute force: nulls, ties, repeated rows, one key with most rows, many ranges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import operators as op
from loomgraph.operators import intervals, similarity

NAN, INF = float("nan"), float("inf")


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables take as many ranges as there are partitions."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def keyed(rng, n, hot=0.6):
    """(id, key, time): most rows have key 1, times tie, some keys and times are null."""
    return [(i, rng.choice([2, 3, 4, None]) if rng.random() > hot else 1, None if rng.random() < 0.05 else rng.randrange(n // 2)) for i in range(n)]


def shown(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof_against_brute_force(spark, direction, exact, tolerance):
    rng = random.Random(f"{direction}{exact}{tolerance}")
    left, right = keyed(rng, 150), keyed(rng, 60)
    left += left[:5]
    right += [(1000, 1, 30), (1001, 1, 30)] + right[:3]
    want = []
    for i, k, t in left:
        found = [(rt, ri) for ri, rk, rt in right if rk is not None and rk == k and rt is not None and t is not None and ((rt < t or exact and rt == t) if direction == "backward" else (rt > t or exact and rt == t))]
        best = (max(found) if direction == "backward" else min(found)) if found else None
        if best and tolerance is not None and abs(best[0] - t) > tolerance:
            best = None
        want.append((i, k, t, best[1] if best else None, best[0] if best else None))
    a = spark.createDataFrame(left, "id long, k int, t long")
    b = spark.createDataFrame(right, "id long, k int, t long")
    got = op.asof_join(a, b, "t", "t", ["k"], direction, exact, None if tolerance is None else F.lit(tolerance))
    assert got.columns == ["id", "k", "t", "id_rhs", "t_rhs"] and shown(tuple(r) for r in got.collect()) == shown(want)


def test_asof_of_odd_tables(spark, rows):
    a = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "a", None)], "id long, k string, t long")
    none = a.limit(0)
    assert rows(op.asof_join(a, none, "t", "t", ["k"]), "id", "id_rhs") == [(1, None), (2, None), (3, None)]
    assert op.asof_join(none, a, "t", "t", ["k"]).count() == 0
    with pytest.raises(ValueError):
        op.asof_join(a, a, "t", "t", ["k"], "sideways")
    all_null = spark.createDataFrame([("a", 1, None)], "k string, t long, v string")
    found = op.asof_join(a, all_null, "t", "t", ["k"]).where("id = 1").first()
    assert found["t_rhs"] == 1 and found["v"] is None
    with_map = spark.createDataFrame([("a", 1, {"x": 1})], "k string, t long, m map<string,int>")
    assert op.asof_join(a, with_map, "t", "t", ["k"]).where("id = 1").first()["m"] == {"x": 1}
    dates = spark.sql("select 'a' k, date'2024-01-02' d union all select 'a', date'2024-01-05'")
    assert rows(op.asof_join(dates, dates, "d", "d", ["k"], exact=False).selectExpr("day(d) a", "day(d_rhs) b").fillna(0)) == [(2, 0), (5, 2)]


def test_asof_plan_splits_a_hot_key(spark):
    """A key with all rows takes every range, and no plan has a cross join."""
    from loomgraph.operators.ordered import Ranged

    rows = spark.range(4000).select(F.lit(1).alias("k"), (F.col("id") % 3).alias("t"))
    ranged = Ranged(rows, ["k"], [F.col("t")])
    sizes = [r["count"] for r in ranged.rows.groupBy("_range").count().collect()]
    assert len(sizes) == 7 and max(sizes) < 5 * min(sizes)
    plan = op.asof_join(rows, rows, "t", "t", ["k"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_running_sums_against_brute_force(spark):
    rng = random.Random(4)
    given = [(i, k, t, rng.choice([None, 1, 2, -5])) for i, k, t in keyed(rng, 200)]
    want = []
    for k in {g[1] for g in given}:
        total = n = 0
        for i, _, t, v in sorted((g for g in given if g[1] == k), key=lambda g: (g[2] is not None, g[2] or 0, g[0])):
            total, n = total + (v or 0), n + 1
            want.append((i, k, t, v, total, n))
    df = spark.createDataFrame(given, "id long, k int, t long, v int")
    got = op.running(df, ["k"], ["t", "id"], {"total": F.col("v"), "nth": F.lit(1)})
    assert shown(tuple(r) for r in got.collect()) == shown(want)
    assert op.running(df.limit(0), ["k"], ["t"], {"n": F.lit(1)}).count() == 0
    same = op.running(spark.createDataFrame([(1, 1)] * 50, "k int, v int"), ["k"], ["v"], {"n": F.lit(1)})
    assert sorted(r["n"] for r in same.collect()) == list(range(1, 51))


@pytest.mark.parametrize("gap", [0, 2, 9])
def test_sessions_against_brute_force(spark, gap):
    rng = random.Random(gap)
    given = keyed(rng, 180) + [(900 + i, 5, None) for i in range(3)]
    want = []
    for k in {g[1] for g in given}:
        session, last = 0, None
        own = sorted((g for g in given if g[1] == k), key=lambda g: (g[2] is not None, g[2] or 0))
        for j, (i, _, t) in enumerate(own):
            if j and t is not None and (last is None or t > last + gap):
                session += 1
            last = t if t is not None else last
            want.append((i, k, t, session))
    got = op.sessions(spark.createDataFrame(given, "id long, k int, t long"), ["k"], "t", F.lit(gap))
    assert shown(tuple(r) for r in got.collect()) == shown(want)


def spans(rng, n, wide):
    out = []
    for i in range(n):
        a = rng.randrange(400)
        out.append((i, rng.choice([1, 1, 1, 2, None]), None if rng.random() < 0.04 else a, None if rng.random() < 0.04 else a + (rng.randrange(-2, 8) if rng.random() > wide else rng.randrange(300))))
    return out + out[:4]


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("base", [None, 1.0, 1000.0])
def test_intervals_against_brute_force(spark, monkeypatch, closed, base):
    monkeypatch.setattr(intervals, "LEAST", 5)
    rng = random.Random(str((closed, base)))
    left, right = spans(rng, 90, 0.1), spans(rng, 70, 0.3)
    points = [(i, rng.choice([1, 1, 2, None]), rng.choice([None, *range(0, 400, 7)])) for i in range(80)]
    a, b = (spark.createDataFrame(x, "id long, k int, s long, e long") for x in (left, right))
    c = spark.createDataFrame(points, "id long, k int, at long")
    sound = lambda s, e: s is not None and e is not None and (s <= e if closed else s < e)
    meets = lambda s, e, u, v: (s <= v and u <= e) if closed else (s < v and u < e)
    want = [(i, j) for i, k, s, e in left for j, m, u, v in right if k is not None and k == m and sound(s, e) and sound(u, v) and meets(s, e, u, v)]
    got = op.interval_join(a, b, ("s", "e"), ("s", "e"), ["k"], closed, base)
    assert sorted((r["id"], r["id_rhs"]) for r in got.collect()) == sorted(want) and len(want) > 50
    inside = lambda p, s, e: s <= p and (p <= e if closed else p < e)
    want = [(i, j) for i, _, p in points for j, _, s, e in left if p is not None and sound(s, e) and inside(p, s, e)]
    got = op.interval_join(c, a, ("at", "at"), ("s", "e"), closed=closed, base=base)
    assert sorted((r["id"], r["id_rhs"]) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert op.interval_join(c.limit(0), a, ("at", "at"), ("s", "e")).count() == 0


def test_intervals_of_doubles_and_times(spark):
    a = spark.createDataFrame([(1, 0.5, 2.5), (2, NAN, 3.0), (3, -INF, INF), (4, -1e300, 1e300)], "id int, s double, e double")
    b = spark.createDataFrame([(7, 2.5), (8, 2.6), (9, NAN)], "p int, x double")
    assert sorted((r["id"], r["p"]) for r in op.interval_join(a, b, ("s", "e"), ("x", "x"), base=1.0).collect()) == [(1, 7), (4, 7), (4, 8)]
    t = spark.sql("select 1 i, timestamp_ntz'2024-03-31 01:30:00' s, timestamp_ntz'2024-03-31 03:30:00' e")
    p = spark.sql("select explode(array(timestamp_ntz'2024-03-31 02:30:00', timestamp_ntz'2024-03-31 03:30:00.000001')) x")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert op.interval_join(p, t, ("x", "x"), ("s", "e")).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_nearest_rows_of_odd_vectors(spark, rows, monkeypatch):
    """A right vector without a score takes no place of one that has a score, and waves of queries add up."""
    rng = random.Random(2)
    good = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    odd = [(100, [NAN, 1.0, 0.0, 0.0]), (101, None), (102, [0.0] * 4), (103, [INF, 0.0, 0.0, 0.0]), (104, [None, 1.0, 1.0, 1.0]), (105, [1e-200] * 4), (106, [1.0, 1.0]), (None, [1.0] * 4)]
    table = spark.createDataFrame(good + odd, "id long, v array<double>")
    queries = spark.createDataFrame([(i, v) for i, v in good[:9]] + odd[:6] + good[:2], "q long, v array<double>")
    known = [(i, v) for i, v in good] + [(105, [1.0] * 4)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    score = lambda a, b: round(dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)), 6)
    want = [(q, i, s, n) for q, u in [*good[:9], (105, [1.0] * 4), *good[:2]] for n, (s, i) in enumerate(sorted(((score(u, v), i) for i, v in known), key=lambda x: (-x[0], x[1]))[:3], 1)]
    run = lambda: rows(op.top_k_similar(queries, table, 3, "q", "id", "v", "v"))
    assert run() == sorted(want)
    monkeypatch.setattr(similarity, "WAVE_BYTES", 100)
    assert run() == sorted(want)
    assert op.score_pairs(queries, table, "q", "id", "v", "v").count() == 12 * 62


def near(x, u, k):
    """The rows of the ``k`` best cosines, rounded, ties by row."""
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(u) @ unit(x).T, 6)
    return [np.lexsort((np.arange(len(x)), -row))[:k].tolist() for row in scores]


def test_index_finds_nearly_all_nearest_rows(spark):
    """Recall at 3 against brute force, on vectors without clusters and on vectors most of which are in one list."""
    rng = np.random.default_rng(9)
    loose = rng.standard_normal((1500, 24))
    tight = np.r_[np.ones((1100, 24)) + 0.2 * rng.standard_normal((1100, 24)), rng.standard_normal((400, 24))]
    for x in (loose, tight):
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
        index = op.VectorIndex(table, "id", "v", sample=800)
        assert index.count == 1500 and sum(len(r[0]) // 8 for r in index.blocks.select("rows").collect()) == 1500
        got = index.search(table.where("id % 50 = 0").withColumnRenamed("id", "q"), "q", "v", 3).collect()
        want = near(x, x[::50], 3)
        hits = sum(r["id"] in want[r["q"] // 50] for r in got)
        assert len(got) == 90 and hits >= 0.9 * 90
        whole = index.search(table.where("id % 150 = 0").withColumnRenamed("id", "q"), "q", "v", 3, probe=1000, keep=1500).collect()
        assert sorted((r["q"], r["rank"], r["id"]) for r in whole) == [(i * 150, n + 1, r) for i, rows in enumerate(near(x, x[::150], 3)) for n, r in enumerate(rows)]


def test_index_of_odd_vectors(spark, rows):
    odd = [(0, None), (1, [0.0, 0.0]), (2, [NAN, 1.0]), (3, [None, 1.0]), (4, [INF, 1.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [1e-200, 1e-200]), (7, [1.0, 2.0, 3.0]), (None, [0.0, 1.0])]
    table = spark.createDataFrame(odd, "id long, v array<double>")
    index = op.VectorIndex(table, "id", "v")
    assert index.count == 4
    got = index.search(table, "id", "v", 2)
    assert sorted(((-1 if r["id"] is None else r["id"]), r["rank"], r["score"]) for r in got.collect()) == [(-1, 1, 1.0), (-1, 2, 0.707107), (5, 1, 1.0), (5, 1, 1.0), (5, 2, 1.0), (5, 2, 1.0), (6, 1, 1.0), (6, 2, 0.707107)]
    assert op.VectorIndex(table.limit(0), "id", "v").search(table, "id", "v", 2).count() == 0
    assert index.search(table.limit(0), "id", "v", 2).count() == 0


def test_hot_buckets_repeat_the_smaller_side(spark, monkeypatch):
    monkeypatch.setattr(intervals, "LEAST", 20)
    left = spark.createDataFrame([(i, 0) for i in range(100)], "a int, k int").selectExpr("a", "struct(k) AS meet")
    right = spark.createDataFrame([(i, i % 2) for i in range(4000)], "b int, k int").selectExpr("b", "struct(k) AS meet")
    seen = []
    plain = type(left).join
    monkeypatch.setattr(type(left), "join", lambda self, other, on=None, how=None: seen.append((self, other, on)) or plain(self, other, on, how))
    got = intervals.salted_join(left, right, "meet")
    sent = [df.count() for self, other, on in seen[-1:] for df in (self, other)]
    # a hundred cells for the key: its 2,000 rows go to two each, not to five
    assert sent[1] <= 8000 and sum(sent) < 12_000
    assert got.count() == got.distinct().count() == 100 * 2000
