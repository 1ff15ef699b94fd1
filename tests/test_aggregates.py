"""Bloom-filtered joins, sketches and grouping sets against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import operators as op
from loomgraph.operators import aggregates, bloom


@pytest.mark.parametrize("most", [1 << 29, 256, 64])
def test_bloom_joins_are_joins(spark, monkeypatch, most):
    """With room, with a crowded filter, and with none; null keys, repeated rows, two keys of which one is most rows."""
    monkeypatch.setattr(bloom, "MOST", most)
    rng = random.Random(most)
    left = [(i, rng.choice([1, 1, 1, None, *range(2, 90)]), rng.choice(["a", "b", None])) for i in range(300)]
    right = [(rng.choice([None, *range(40, 120)]), rng.choice(["a", None]), i) for i in range(90)]
    a, b = spark.createDataFrame(left, "id long, k int, s string"), spark.createDataFrame(right, "k int, s string, id int")
    pairs = {(k, s) for k, s, _ in right if k is not None and s is not None}
    for join, keep in ((op.bloom_semi_join, True), (op.bloom_anti_join, False)):
        assert sorted(r["id"] for r in join(a, b, ["k", "s"]).collect()) == [i for i, k, s in left if ((k, s) in pairs) == keep]
        assert join(a, b, ["k"]).columns == a.columns and join(a.limit(0), b, ["k"]).count() == 0
    assert op.bloom_semi_join(a, b.limit(0), ["k"]).count() == 0 and op.bloom_anti_join(a, b.limit(0), ["k"]).count() == 300


def test_bloom_filters_let_few_rows_through(spark):
    keys = spark.range(0, 60_000, 3).toDF("k")
    made = op.build_bloom(keys, ["k"])
    hashed = {r["k"]: r["h"] for r in spark.range(60_000).select(F.col("id").alias("k"), F.xxhash64("id").alias("h")).collect()}
    held = made.holds(np.array([hashed[k] for k in range(60_000)]))
    assert held[::3].all() and held[np.arange(60_000) % 3 > 0].mean() < 0.01
    wanted = spark.range(60_000).toDF("k")
    exchanged = bloom._might(wanted, ["k"], made).where("_might").count()
    assert 20_000 <= exchanged < 20_500


def groups(rows, dims, sets):
    out = {}
    for r in rows:
        for s in sets:
            key = (*[r[d] if d in s else None for d in dims], sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in s))
            out.setdefault(key, []).append(r)
    return out


def test_grouping_sets_against_brute_force(spark):
    rng = random.Random(3)
    rows = [{"a": rng.choice(["x", "x", "x", None]), "b": rng.choice([1, 2, None]), "c": rng.choice([True, False]), "u": rng.choice([None, *range(9)]), "v": rng.choice(["p", "q", None]), "w": rng.randrange(5)} for _ in range(240)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "a string, b int, c boolean, u int, v string, w int")
    dims = ["a", "b", "c"]
    for sets in (None, [["a"], ["a", "b"], []], [["c"]]):
        real = sets if sets is not None else [list(c) for n in range(4) for c in combinations(dims, n)]
        want = sorted(str((*k, len(g), sum(r["w"] for r in g), len({r["u"] for r in g} - {None}), len({r["v"] for r in g} - {None}))) for k, g in groups(rows, dims, real).items())
        got = op.grouping_distinct(df, dims, ["u", "v"], {"w_sum": F.col("w")}, sets)
        assert got.columns == [*dims, "grouping", "rows", "w_sum", "distinct_u", "distinct_v"] and sorted(str(tuple(r)) for r in got.collect()) == want
    none = op.grouping_distinct(df.limit(0), dims, ["u"]).collect()
    assert [tuple(r) for r in none] == [(None, None, None, 7, 0, 0)]


def test_sketches_hold_their_bounds(spark):
    rng = np.random.default_rng(2)
    rows = [(d, int(min(rng.zipf(1.3), 5000)), float(rng.normal())) for d in range(4) for _ in range(3000)]
    rows += [(None, None, None), (0, 1, float("nan"))]
    df = spark.createDataFrame(rows, "day int, user long, value double")
    daily = op.sketches(df, ["day"], "user", "value", "user")
    path = spark.conf.get("spark.checkpoint.dir") + "/sketches"
    daily.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    assert {r["day"]: r["rows"] for r in stored.collect()} == {0: 3001, 1: 3000, 2: 3000, 3: 3000, None: 1}
    whole = op.merge_sketches(stored.withColumn("all", F.lit(1)), ["all"])
    one = whole.select("rows", F.hll_sketch_estimate("distinct").alias("users"), F.kll_sketch_get_quantile_double("quantiles", F.lit(0.9)).alias("q")).first()
    users = [u for _, u, _ in rows if u is not None]
    values = np.array([v for *_, v in rows if v is not None and v == v])
    assert one["rows"] == len(rows) and abs(one["users"] - len(set(users))) <= 0.06 * len(set(users)) and abs((values <= one["q"]).mean() - 0.9) < 0.02
    for table, keys, own in ((whole, ["all"], {(1, u): users.count(u) for u in set(users)}), (stored, ["day"], None)):
        asked = df.select("user", "day", F.lit(1).alias("all")).where("day is not null")
        truth = {(r[0], r[1]): r[2] for r in asked.groupBy(*keys, "user").count().collect() if r[1] is not None}
        n = {r[0]: r[1] for r in table.select(*keys, "rows").collect()}
        guess = {(r[0], r[1]): r["estimate"] for r in op.estimate_counts(table, asked, keys, "user").collect()}
        assert guess.keys() == truth.keys() and all(guess[k] >= v for k, v in truth.items())
        assert np.mean([guess[k] <= v + aggregates.ERROR * n[k[0]] for k, v in truth.items()]) >= 1 - aggregates.RISK
        assert own is None or all(guess[k] >= v for k, v in own.items())
    assert op.sketches(df.limit(0), ["day"], "user", "value", "user").count() == 0
