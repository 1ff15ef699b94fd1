"""Parts that several operators share: text numbers, components, skewed joins."""

import random

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import graph, hot, identity
from loomgraph.llm.graph import components, linked_components, listed_pairs
from loomgraph.llm.ngram_join import ngram_classes
from loomgraph.llm.scratch import Scratch
from loomgraph.llm.words import word_hashes, word_spans


def roots_of(edges):
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_texts_whose_numbers_meet_are_told_apart(spark, rows, monkeypatch):
    real = identity.text_hash
    monkeypatch.setattr(identity, "text_hash", lambda text, turn: F.length(text).cast("long") if turn == 0 else real(text, turn))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "bb", "aa", "c", None, ""])], "doc_id long, text string")
    known = identity.TextNodes(docs, "doc_id", "text", Scratch(spark, "t"))
    assert known.clashes == [[2]] and sorted(r["members"] for r in known.groups.collect()) == [1, 1, 2, 2]
    node = {r["id"]: r["node"] for r in known.rows.collect()}
    assert node[0] == node[2] != node[1] and node[4] == node[5] and node == {r[0]: r[1] for r in docs.select("doc_id", known.node).collect()}
    assert rows(ngram_classes(docs), "doc_id", "component_id") == [(0, 0), (1, 1), (2, 0), (3, 3), (4, 4), (5, 5)]


def test_components_in_rounds_and_in_one_task(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(1000, 2000 + i) for i in range(50)]
    want = {k: v for k, v in roots_of([e for e in edges if e[0] != e[1]]).items()}
    df = spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long")
    assert {r[0]: r[1] for r in components(df, Scratch(spark, "t")).collect()} == want
    monkeypatch.setattr(graph, "ONE_TASK", 30)
    monkeypatch.setattr(graph, "SMALL_ROWS", 20)
    monkeypatch.setattr(hot, "SMALL_ROWS", 20)
    monkeypatch.setattr(hot, "max", lambda a, b: 10, raising=False)
    assert {r[0]: r[1] for r in components(df, Scratch(spark, "t")).collect()} == want
    assert components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_skewed_joins_are_joins(spark, rows, monkeypatch):
    monkeypatch.setattr(hot, "SMALL_ROWS", 2)
    monkeypatch.setattr(hot, "max", lambda a, b: 10, raising=False)
    left = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(90)] + [(100, None)], "i long, k long")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 60)], "k long, v string")
    for how in ("inner", "left"):
        assert sorted(map(str, hot.join_skewed(left, right, "k", 91, 60, how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    keys = hot.hot_keys(left, "k", 91)
    assert [tuple(r) for r in keys.collect()] == [(7, 6)]
    assert rows(hot.join_salted(left, right, "k", keys, "i")) == rows(left.join(right, "k"))
    sizes = left.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert rows(hot.join_groups(left, sizes, "k", "n")) == rows(left.join(sizes, "k"))


def test_long_lists_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 4)
    lists = [(1, i, 0, i % 5, 30) for i in range(30)] + [(2, i, 0, i, 3) for i in range(3)]
    df = spark.createDataFrame(lists, "token long, node long, n long, label long, all long")
    every = {(a, b) for a in range(30) for b in range(a + 1, 30) if a % 5 != b % 5} | {(0, 1), (0, 2), (1, 2)}
    assert {tuple(r) for r in listed_pairs(df, None).collect()} == every


def test_links_of_lists_are_all_found(spark):
    rng = random.Random(7)
    lists = [(t, rng.randrange(60), 0) for t in range(40) for _ in range(4)] + [(99, i, 0) for i in range(60)]
    links = {(a, b) for a in range(60) for b in range(a + 1, 60) if (a * b) % 17 == 3}
    posts = spark.createDataFrame(sorted(set(lists)), "token long, node long, n long")
    good = spark.createDataFrame([*links, *[(b, a) for a, b in links]], "a long, b long")
    scratch = Scratch(spark, "t")
    got = linked_components(scratch.table(posts, "posts"), lambda pairs, n: pairs.join(good, ["a", "b"]), scratch)
    assert {r[0]: r[1] for r in got.collect()} == roots_of(links)


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_long_words_that_meet_in_every_polynomial_hash_are_apart(spark, rows):
    for n in (1024, 2048, 4096):
        word = thue_morse(n)
        other = word.translate(str.maketrans("ab", "ba"))
        raw = np.frombuffer(f"{word} {other}".encode(), np.uint8)
        a, b = word_hashes(raw, np.array([0, len(raw)]))[0]
        assert a != b
        docs = spark.createDataFrame([(1, word), (2, other), (3, word.upper())], "doc_id long, text string")
        assert rows(ngram_classes(docs), "doc_id", "component_id") == [(1, 1), (2, 2), (3, 1)]


def test_words_have_one_hash_wherever_they_stand():
    rng = random.Random(5)
    letters = ["a", "B", "\x00", "é", "z" * 8, "q" * 7]
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    texts = [rng.choice("\t\n ").join(rng.choices(words, k=rng.randrange(0, 12))) + rng.choice(["", " ", "\r\n"]) for _ in range(300)]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([0, *map(len, raw)])
    hashes, starts, lengths, first = word_spans(np.frombuffer(b"".join(raw), np.uint8), ends)
    low = bytes(x + 32 if 65 <= x <= 90 else x for x in b"".join(raw))
    known = {}
    for h, a, n in zip(hashes.tolist(), starts.tolist(), lengths.tolist(), strict=True):
        assert known.setdefault(low[a : a + n], h) == h
    assert len(set(known.values())) == len(known) > 300
    assert [len(t.split()) for t in (x.decode() for x in raw)] == np.diff(first).tolist()
