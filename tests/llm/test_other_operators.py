"""Chat formatting, embeddings, mixing, WARC, toxicity and the pipeline."""

import io
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm.chat import rotate_perspectives
from loomgraph.llm.embedding_dedup import decode, near_duplicates
from loomgraph.llm.mixing import mix, mixed
from loomgraph.llm.queries import QUERIES
from loomgraph.llm.toxicity import Chain, fit_chain, score, train
from loomgraph.llm.warc import RecordReader, read_archives, record, write_archives

SF = "/root/testdata/sf0.001"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, part string, perspective int")


def test_perspectives(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 4, None, "who?"), (2, 0, "system", "alone"), (None, 0, "eve", "x"), (None, None, "eve", "late")]
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in rotate_perspectives(turns(spark, rows)).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (None, "eve", 0), (None, "eve", None)}
    ann = got[1, "ann", 0]
    assert ann["rendered"] == "<|im_start|>system\nbe nice<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n<|im_start|>user\nwho?<|im_end|>\n"
    assert [ann["rendered"][s["first"] : s["end"]] for s in ann["spans"]] == ["hi < |im_end|><|im_end|>\n", "bye<|im_end|>\n"]
    assert ann["n_masked"] == sum(s["end"] - s["first"] for s in ann["spans"]) and ann["n_turns"] == 5
    assert rotate_perspectives(turns(spark, [])).count() == 0


def test_a_long_dialogue_comes_in_parts(spark):
    rows = [(1, i, "ab"[i % 2], f"t{i}") for i in range(300)]
    whole = "".join(r["rendered"] for r in rotate_perspectives(turns(spark, rows), part_turns=1000).where("perspective = 'a'").collect())
    parts = rotate_perspectives(turns(spark, rows)).where("perspective = 'a'").orderBy("part").collect()
    assert len(parts) == 3 and "".join(r["rendered"] for r in parts) == whole


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, node int, size int")


def brute(x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return unit @ unit.T >= 0.95


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 32))
    x[100:160] = x[0] + 0.02 * rng.standard_normal((60, 32))
    for i in range(160, 200):
        x[i] = x[i - 80] + 0.15 * rng.standard_normal(32)
    x[200:210] = x[5]
    x = x.astype(np.float32).astype(float)
    close = brute(x)
    got = {r["vec_id"]: r for r in near_duplicates(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    found, true = sum(r["n_links"] for r in got.values()), close.sum() - len(x)
    assert len(got) == 300 and 0.9 * true <= found <= true
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert {got[i]["component_id"] for i in range(100, 160)} == {0} and got[205]["n_links"] == 10


def test_filters_recall():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal((400, 64))
    noise -= (noise * x).sum(1, keepdims=True) * x
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    shared = [len(np.intersect1d(a, b)) > 0 for a, b in zip(decode(x), decode(y), strict=True)]
    assert np.mean(shared) >= 0.95


def test_embedding_edges(spark):
    odd = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0, 0.0]), (None, [3.0, 0.0])]
    got = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], r["component_id"]) for r in near_duplicates(vectors(spark, odd)).collect())
    assert got == [(-1, 3, 6), *[(i, 0, i) for i in range(6)], (6, 3, 6), (7, 3, 6), (7, 3, 6), (8, 0, 8)]
    assert near_duplicates(vectors(spark, [])).count() == 0


def test_vectors_of_any_scale(spark):
    """Tiny and huge components, whose squares no double holds, have a direction all the same."""
    rows = spark.createDataFrame([(1, [1e-200] * 4), (2, [1e200] * 4), (3, [1e-200, 0.0, 0.0, 0.0]), (4, [1e-300, 1e-300, 1e-300, 1e-300])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_duplicates(rows).collect()) == [(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 2, 1)]


def test_rows_of_no_group_do_not_meet(spark, monkeypatch):
    """With no broadcast, rows without a key stay in the tasks that have them, and the components are the same."""
    from loomgraph.llm import hot

    monkeypatch.setattr(hot, "SMALL_ROWS", 2)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", "8")):
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 4000, 1, 16).select("id", F.when(F.col("id") % 4 == 0, F.col("id") % 40).alias("k"))
        groups = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        parts = [r["count"] for r in hot.join_groups(rows, groups, "k", "n", "left").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(parts) == 4000 and max(parts) < 5 * sorted(parts)[len(parts) // 2]
        rng = np.random.default_rng(1)
        given = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 16)))] + [(1000 + i, None) for i in range(300)] + [(2000 + i, [1.0] * 15 + [0.001 * i]) for i in range(60)]
        got = {r["vec_id"]: r for r in near_duplicates(vectors(spark, given)).collect()}
        assert len(got) == 660 and {got[2000 + i]["component_id"] for i in range(60)} == {2000} and got[1000]["n_links"] == 0 and got[1000]["component_id"] == 1000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def mixable(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "k") for i, t, s in rows], "doc_id long, text string, source string, size int, key string")


def level(totals, cap=3):
    """Targets by weights 5, 2, 1, repeating over the sources in order, capped and reshared."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(totals)}
    target, open_, rest = {}, set(totals), sum(totals.values())
    while open_:
        share = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > cap * totals[s]}
        if not over:
            return target | {s: weight[s] * share for s in open_}
        for s in over:
            target[s] = cap * totals[s]
            rest -= target[s]
        open_ -= over
    return target


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(1, 90)), rng.choice(["a", "b", "c", "dd", None])) for i in range(600)]
    rows += [(700, "tiny one", "a0"), (701, "", "b"), (702, None, "c"), (703, "x\x1cy z", "b"), (5, rows[5][1], rows[5][2])]
    rows += [(1000 + i, "same words here", "hot") for i in range(500)]
    got = mix(mixable(spark, rows)).collect()
    text = {i: (t, s) for i, t, s in rows}
    size = lambda t: len([x for x in (t or "").replace("\t", " ").split(" ") if x])
    totals = Counter()
    for _, t, s in rows:
        totals[s] += size(t)
    want = level({s: totals[s] for s in sorted(totals, key=lambda s: (s is None, s))})
    taken = Counter()
    for r in got:
        t, s = text[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["size"] == size(t) and r["source_size"] == totals[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 3 * r["size"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= max(3, 0.01 * want[s]) for s in want)
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mix(mixable(spark, rows)).collect()))
    out = mixed(mixable(spark, rows))
    assert out.columns == mixable(spark, []).columns and out.count() == sum(r["copies"] for r in got)
    assert mix(mixable(spark, [])).count() == 0 and mixed(mixable(spark, [])).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a b", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (9, "u", "x" * 200_000), (2, None, big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    written = write_archives(pages, f"file://{tmp_path}/w")
    assert written.agg(F.sum("records")).first()[0] == len(rows)
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in read_archives(written).collect()), key=str)
    want = [(0, 1200, "revisit", 2), (1, 1200, "revisit", 2), (2, 1200, "response", None), (2, 1200, "response", None), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (9, 200_000, "response", None)]
    assert got == sorted(want, key=str)
    assert read_archives(write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_broken_archives_are_told():
    member = record(1, "u", b"payload" * 100, None, 6)
    fields, block = next(iter(RecordReader(io.BytesIO(member), 7)))
    assert fields["WARC-Type"] == "response" and block.endswith(b"payload")
    with pytest.raises(ValueError, match="ends inside"):
        list(RecordReader(io.BytesIO(member[:-9])))
    assert len(list(RecordReader(io.BytesIO(member * 3), 11))) == 3
    import zlib

    raw = zlib.decompress(member, 31)
    for bad in (raw.replace(b"payload", b"PAYLOAD", 1), raw.replace(b"Content-Length: 7", b"Content-Length: 6")):
        with pytest.raises(ValueError):
            list(RecordReader(io.BytesIO(zlib.compress(bad, wbits=31))))


def test_chain_on_held_out_rows():
    rng = np.random.default_rng(8)
    n, bad = 3000, np.arange(5, dtype=np.uint64)
    toxic = rng.random(n) < 0.15
    sets = [np.unique(np.r_[rng.integers(1000, 6000, 60).astype(np.uint64), rng.choice(bad, 2) if t else bad[:0]]) for t in toxic]
    labels = np.column_stack([(toxic | (rng.random(n) < 0.1)).astype(float), toxic.astype(float)])
    labels[::7, 0] = np.nan
    chain, outside = fit_chain(sets[:2000], labels[:2000], ["rude", "toxic"])
    known = ~np.isnan(labels[:2000, 0])
    assert ((outside[:, 1] >= chain.threshold[1]) == toxic[:2000]).mean() > 0.98 and known.any()
    sums = lambda s: [sum(chain.weights[j][i] for i in np.flatnonzero(np.isin(chain.words, s))) for j in range(2)]
    p = chain.chained([np.array(x) for x in zip(*[sums(s) for s in sets[2000:]], strict=True)], n - 2000)
    assert ((p[:, 1] >= chain.threshold[1]) == toxic[2000:]).mean() > 0.98
    assert isinstance(fit_chain([], np.zeros((0, 2)), ["a", "b"])[0], Chain)


def test_toxicity_edges(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefghij") * 3 for _ in range(20)) + (" nasty" if i % 5 == 0 else "")) for i in range(200)] + [(900, None), (901, ""), (5, "ccc nasty"), (None, "nasty")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, None if i % 3 else 1, int(i % 5 == 0)) for i in range(150)] + [(None, 1, 1), (777, 0, 0)], "doc_id long, quality int, toxic int")
    got = score(docs, train(docs, labels)).collect()
    assert len(got) == len(rows) and {r["doc_id"] for r in got if r["toxic"]} == {i for i, t in rows if "nasty" in (t or "")}
    none = score(docs, train(docs, labels.limit(0)))
    assert none.where("toxic").count() == 0 and none.first()["p_toxic"] == 0.5
    assert score(docs.limit(0), train(docs, labels)).count() == 0


def test_pipeline_against_its_parts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append(stage(spark, seen[-1], SF).cache())
        if i < 4:
            assert seen[-1].columns == docs.columns
    toxic = {r[0] for r in QUERIES["op10_toxicity"](spark, SF).where("toxic").select("doc_id").collect()}
    first = {r["doc_id"]: r["text"] for r in seen[1].collect()}
    assert set(first) == {r[0] for r in docs.select("doc_id").collect()} - toxic
    best = {}
    for i, t in first.items():
        best[t] = max(i, best.get(t, i))
    second = {r[0] for r in seen[2].select("doc_id").collect()}
    assert second == set(best.values())
    third = {r[0] for r in seen[3].select("doc_id").collect()}
    assert third <= second
    words = lambda d: {r[0]: r[1] for r in d.groupBy("doc_id").agg(F.count(F.lit(1))).collect()}
    fourth = words(seen[4])
    assert set(fourth) <= third and max(fourth.values()) <= 3
    assert words(seen[5]) == fourth and seen[5].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, seen[5].collect()))


def test_queries_are_ten():
    numbers = defaultdict(list)
    for name in QUERIES:
        numbers[int(name[2:].split("_")[0])].append(name)
    assert sorted(numbers) == list(range(1, 11)) and all(len(x) == 1 for x in numbers.values())


def test_a_second_attempt_writes_its_own_archives(spark, tmp_path, monkeypatch):
    """A task that runs again after its first run moved an archive to its name."""
    import pyarrow as pa

    from loomgraph.llm import warc

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(warc, "TaskContext", Context)
    write = warc._archive_writer(f"file://{tmp_path}/w", 6)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["u", None]), pa.array(["<p>", None]), pa.array([None, None], pa.int64())], ["id", "url", "html", "refers_to"])
    first, second = (next(write(iter([batch]))).to_pylist() for _ in range(2))
    assert len(first) == len(second) == 1 and first[0]["path"] != second[0]["path"] and first[0]["records"] == 2
    written = spark.createDataFrame(second, "path string, records long, bytes long")
    assert sorted(r["page_id"] for r in read_archives(written).collect()) == [1, 2]
