"""Vector codes, hard negatives and language-model scores against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import context_mixing, hard_negatives
from loomgraph.llm.context_mixing import Mixer, Speller, bit_counts, score_texts
from loomgraph.llm.hard_negatives import best, merged, mine, products
from loomgraph.llm.vector_codes import compress

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    """(id, vector, label) with columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<float>, label int, key int, code string, rank int")


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floored(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def coded(rows, parts=16, entries=64, rounds=2):
    """The codes by whole passes: every round assigns all parts and takes all means anew."""
    kept = sorted(((r[0] is None, r[0] or 0, floored(r[1])), r) for r in rows if sound(r[1]))
    x = [floored(r[1]) for _, r in kept]
    if not x:
        return [], ""
    dim = len(x[0])
    at = [dim * i // parts for i in range(parts + 1)]
    cut = [[v[at[p] : at[p + 1]] for p in range(parts)] for v in x]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    assign = lambda: [[min((far(c[p], e), i) for i, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut[i][p] for i in range(len(x)) if found[i][p][1] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    label = Counter()
    for (_, r), err in zip(kept, errors, strict=True):
        label[r[2]] += err
    digest = hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()
    return sorted(str((r[0], "".join(f"{i:02x}" for _, i in f), err, label[r[2]])) for (_, r), f, err in zip(kept, found, errors, strict=True)), digest


def odd_rows(rng, n, dim):
    rows = [(i, rng.standard_normal(dim).astype(np.float32).tolist(), int(rng.integers(3)) if i % 5 else None) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [NAN] * dim, 1), (n + 2, [INF] * dim, 1), (n + 3, [None] + [0.0] * (dim - 1), 2), (7, rows[7][1], 0), (None, rows[3][1], None)]
    return rows + [(1000 + i, rows[5][1], 1) for i in range(30)]


@pytest.mark.parametrize(("dim", "entries"), [(32, 64), (32, 5), (20, 200)])
def test_codes_against_whole_passes(spark, dim, entries):
    rows = odd_rows(np.random.default_rng(dim + entries), 90, dim)
    want, digest = coded(rows, entries=entries)
    got = compress(table(spark, rows), entries=entries).collect()
    assert {r["codebooks_sha256"] for r in got} == {digest}
    assert sorted(str((r["vec_id"], r["code"], r["error"], r["label_error"])) for r in got) == want


def test_codes_of_odd_tables(spark, rows):
    assert compress(table(spark, [])).count() == 0 and compress(table(spark, [(1, None, 1)])).count() == 0
    assert rows(compress(table(spark, [(1, [], 1), (2, [], None)])), "vec_id", "code", "error") == [(1, "00" * 16, 0), (2, "00" * 16, 0)]
    got = {r["vec_id"]: r for r in compress(table(spark, [(1, [0.5] * 16, 1), (2, [0.5] * 32, 1), (3, [1e30] * 16, 1), (4, [0.5] * 16, 2)])).collect()}
    assert [got[i]["code"] for i in (1, 2, 3, 4)] == ["00" * 16, None, None, "00" * 16] and got[1]["label_error"] == 0


def mined(rows, every=50, k=5, m=3, low=50, high=95):
    known = [(i, lab, floored(v)) for i, v, lab in rows if i is not None and lab is not None and sound(v)]
    out = []
    for a, label, x in known:
        if a % every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), b, lab) for b, lab, y in known if b != a and len(y) == len(x))
        for p, b, _ in [s for s in scores if s[2] == label][:k]:
            found = [s for s in scores if s[2] != label and low * -p <= 100 * -s[0] <= high * -p][:m]
            out += [(a, b, n, c, -p, -s) for n, (s, c, _) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [4096, 16])
def test_negatives_against_all_pairs(spark, rows, size):
    rng = np.random.default_rng(8)
    given = odd_rows(rng, 300, 12) + [(2000, [0.0] * 12, 1), (2050, [-1.0] * 12, 1), (2051, [1.0] * 12, 1), (2100, [0.5] * 7, 0), (2101, [0.5] * 7, 0), (2102, [0.25] * 7, 1)]
    given = [g for g in given if g[0] is None or g[0] != 7 or g is given[7]]
    want = mined(given, every=10)
    assert len(want) > 50 and rows(mine(table(spark, given), every=10, block=size, anchor_block=size)) == want


def test_negatives_of_odd_tables(spark, rows, monkeypatch):
    assert mine(table(spark, [])).count() == 0 and mine(table(spark, [(50, None, 1), (100, [1.0], None)])).count() == 0
    given = [(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.9, 0.0], 2), (52, [0.9, 0.0], 2), (53, [1e9, 0.0], 2), (None, [0.9, 0.0], 2)]
    assert rows(mine(table(spark, given))) == [(50, 51, 1, 52, 65536, 58880), (50, 51, 2, 52, 65536, 58880)]
    relabelled = mine(table(spark, given), relabel=F.when(F.col("vec_id") == 51, 2).otherwise(F.col("label")))
    assert relabelled.count() == 0
    monkeypatch.setattr(hard_negatives, "WAVE_BYTES", 600)
    many = odd_rows(np.random.default_rng(2), 120, 8)
    many = [g for g in many if g[0] != 7]
    assert rows(mine(table(spark, many), every=2, anchor_block=3)) == mined(many, every=2)


def test_large_scores_are_exact():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 25), 1 << 25, (6, 40)).astype(np.int32), rng.integers(-(1 << 25), 1 << 25, (50, 40)).astype(np.int32)
    exact = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    scores = products(a, b)
    assert scores.tolist() == exact
    ids = np.arange(50) * 3
    found = best(scores, np.ones(scores.shape, bool), ids, 4)
    want = [sorted((-s, i) for s, i in zip(row, ids.tolist(), strict=True))[:4] for row in exact]
    assert found[0].tolist() == [[-s for s, _ in w] for w in want] and found[1].tolist() == [[i for _, i in w] for w in want]
    halves = [best(scores[:, s], np.ones((6, 25), bool), ids[s], 4) for s in (slice(0, 25), slice(25, 50))]
    both = merged(4, *halves)
    assert both[0].tolist() == found[0].tolist() and both[1].tolist() == found[1].tolist()


def texts(spark, rows):
    return spark.createDataFrame([(i, t, 5, "b", 1.0) for i, t in rows], "doc_id long, text string, n_tokens int, kind string, score double")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + [""]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def unigram(rows):
    """The contract's columns by whole counts."""
    docs = [(i, tokens(t)) for i, t in rows]
    seen = Counter(w for i, d in docs if not is_held(i) for w in d)
    n, v = sum(seen.values()), len(seen)
    return sorted((str(i), is_held(i), len(d), sum(seen[w] > 0 for w in d), n, round(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in d), 6)) for i, d in docs)


def base_of(df):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect())


def corpus(n=400):
    rng = np.random.default_rng(6)
    parts = ["th", "an", "er", "in", "on", "Re", "st", "ou", "é", "ti"]
    vocabulary = ["".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(900)]
    line = " ".join(rng.choice(vocabulary, 40))
    draw = lambda k: vocabulary[int(900 * rng.random() ** 3)] if k else line
    return [(i, " ".join(draw(rng.integers(30)) for _ in range(rng.integers(5, 120)))) for i in range(n)]


@pytest.mark.parametrize("chunk", [8 << 20, 3000])
def test_base_scores_against_counts(spark, monkeypatch, chunk):
    monkeypatch.setattr(context_mixing, "CHUNK", chunk)
    given = corpus(120) + [(500, None), (501, ""), (502, " \t\n"), (None, "the The THE"), (3, "again the same id"), (503, "x" * 70_000 + " y"), (504, "a\x00 a")]
    got = score_texts(texts(spark, given))
    assert base_of(got) == unigram(given)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["bits_per_byte"] > 0 for r in got.collect())


def test_scores_of_odd_tables(spark):
    assert score_texts(texts(spark, [])).count() == 0
    held = [i for i in range(200) if is_held(i)][:3]
    only = [(i, "never learnt") for i in held]
    assert base_of(score_texts(texts(spark, only))) == unigram(only)
    assert [round(r["score"], 4) for r in score_texts(texts(spark, [(held[0], None)])).collect()] == [round(-8 * math.log10(2), 4)]


def test_chunks_do_not_change_scores(spark, monkeypatch):
    given = corpus(150)
    whole = {r["doc_id"]: r["score"] for r in score_texts(texts(spark, given)).collect()}
    monkeypatch.setattr(context_mixing, "CHUNK", 2000)
    cut = {r["doc_id"]: r["score"] for r in score_texts(texts(spark, given).repartition(7)).collect()}
    assert whole.keys() == cut.keys() and all(cut[i] == pytest.approx(s, rel=1e-9) for i, s in whole.items())


def test_held_out_texts_are_scored_better_than_by_the_base(spark):
    got = [r for r in score_texts(texts(spark, corpus(600))).collect() if r["held_out"]]
    assert len(got) > 30 and sum(r["score"] for r in got) > 0.93 * sum(r["base_score"] for r in got)


def test_spellings_are_a_distribution():
    """All words of one letter, and what longer ones begin with, cost bits that add up to one."""
    words = [b"an", b"anon", b"ban", b"on", b""]
    counts = bit_counts(np.array([len(w) for w in words]), b"".join(words)).astype(np.uint32)
    speller = Speller(counts, Mixer(27, context_mixing.LETTERS + 1, 256))
    speller.fit(np.array([len(w) for w in words]), b"".join(words))
    ends = [bytes([x]) for x in range(256) if x != 32]
    ended = np.exp2(-speller.bits(np.ones(255, np.int64), b"".join(ends)))
    empty = np.exp2(-speller.bits(np.zeros(1, np.int64), b""))[0]
    two = np.exp2(-speller.bits(np.full(255, 2), b"".join(b"a" + x for x in ends)))
    first_a = ended[ends.index(b"a")]
    assert empty + ended.sum() < 1 and two.sum() < 1 and first_a > 0
    known = np.exp2(-speller.bits(np.array([2, 2]), b"anzq"))
    assert known[0] > 50 * known[1]


def test_spelling_is_fitted_on_all_words(spark, monkeypatch):
    seen = []
    plain = Speller.take
    monkeypatch.setattr(Speller, "take", lambda self, sums: seen.append(float(sums[27 * 5 : 27 * 6].sum())) or plain(self, sums))
    given = [(i, f"w{i}x{i % 7}") for i in range(300)]
    score_texts(texts(spark, given)).count()
    words = {t for i, t in given if zlib.crc32(str(i).encode()) % 10}
    # eight bits of every letter of each word, and of the space and the end
    assert seen and all(abs(x / (8 * (sum(len(w) + 1 for w in words) + 1)) - 1) < 1e-9 for x in seen)


def test_a_fit_sends_one_row_a_task_whatever_the_mixer_has(spark, monkeypatch):
    seen = []
    plain = context_mixing._sum_of_fits
    monkeypatch.setattr(context_mixing, "_sum_of_fits", lambda fits, parts: seen.append((fits.count(), parts)) or plain(fits, parts))
    score_texts(texts(spark, corpus(60))).count()
    assert len(seen) == context_mixing.FITS and all(0 < rows <= parts for rows, parts in seen)


def test_kept_inputs_give_the_same_fit(monkeypatch):
    words = [b"an", b"anon", b"ban", b"on", b"", b"banana"] * 40
    sizes, text = np.array([len(w) for w in words]), b"".join(words)
    pairs, times = context_mixing.letter_pairs(sizes, text)
    fit = lambda: Speller(bit_counts(sizes, text).astype(np.uint32), Mixer(27, context_mixing.LETTERS + 1, 256)).fit_pairs(pairs, times)
    kept = fit()
    monkeypatch.setattr(context_mixing, "KEPT", 0)
    assert (fit() == kept).all()
    ranked, back = context_mixing._distinct_letters(pairs[::-1].repeat(2))
    assert (ranked == pairs).all() and (ranked[back] == pairs[::-1].repeat(2)).all()
