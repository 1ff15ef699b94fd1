"""Exact dedup, the n-gram join, BPE, sharding and substring dedup against brute force, and their edge cases."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from loomgraph.llm.bpe import WordBpe, bpe_decode, bpe_encode
from loomgraph.llm.exact_dedup import drop_copies, exact_dedup
from loomgraph.llm.ngram_join import drop_near_copies, ngram_classes
from loomgraph.llm.sharding import shard
from loomgraph.llm.substring_dedup import _meetings, align, all_pairs, chains, edit_distance, likely, shared_passages

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("word_bpe_49k.json")
#: Columns that a table may have besides, with names that operators use inside.
MORE = "id long, size long, node long, row string, key string, token long, digest string"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows, more=False):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + MORE if more else "")
    fill = (7, 7, 7, "r", "k", 7, "d") if more else ()
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *fill) for i, t in rows], schema)


def corpus(n=120, seed=5):
    """Texts with exact and near copies, short and empty ones, a null, and a common line."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    line = " ".join(rng.choice(words) for _ in range(12))
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            out.append(rng.choice(out))
        elif out and kind < 0.5:
            copy = rng.choice(out).split() or ["a", "b", "c"]
            for _ in range(rng.randint(1, 1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append("\n".join([" ".join(copy)]))
        elif kind < 0.58:
            out.append(rng.choice(["", "  \t\n", "One", "one  two", "ONE two"]))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randint(20, 150))) + " " + line)
    return list(enumerate(out)) + [(n, None)]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def reached(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_exact_dedup(spark):
    rows = corpus() + [(3, "again"), (3, "again"), (None, "again"), (None, None)]
    got = exact_dedup(docs(spark, rows, True)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = sorted((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows if i is not None)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got if r["doc_id"] is not None) == want
    assert len(got) == len(rows) and all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    least = {r["doc_id"]: r["keep_id"] for r in exact_dedup(docs(spark, [(1, "a"), (2, "a")]), keep="smallest").collect()}
    assert least == {1: 1, 2: 1}
    assert exact_dedup(docs(spark, [])).count() == 0


def test_drop_copies_keeps_all_columns(spark):
    out = drop_copies(docs(spark, [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, "")], True))
    assert out.columns == docs(spark, [], True).columns and sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(2, "a"), (4, "")]
    assert drop_copies(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [5, 6])
def test_ngram_classes(spark, seed):
    rows = corpus(seed=seed)
    sets = {i: shingles(t) for i, t in rows}
    root = reached(list(sets), lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    got = ngram_classes(docs(spark, rows, True)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), root[i]) for i in sets}


def test_ngram_edges(spark):
    assert ngram_classes(docs(spark, [])).count() == 0
    long = " ".join(str(i) for i in range(30_000))
    rows = [(1, long), (2, long + " end"), (None, long), (3, ""), (4, None), (5, "a b c d"), (6, "A  b\tc D"), (7, "a b c d"), (7, "a b c d")]
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_classes(docs(spark, rows)).collect() if r["doc_id"])
    assert got == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5), (7, 5), (7, 5)]
    out = drop_near_copies(docs(spark, rows, True))
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 3, 4, 5] and "token" in out.columns
    assert drop_near_copies(docs(spark, [(1, "a"), (1, "a")])).count() == 1


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        own = list(base)
        own[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(own)))
    assert {r["component_id"] for r in ngram_classes(docs(spark, rows)).collect()} == {0}


def test_bpe_is_the_librarys(spark):
    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(VOCABULARY)
    rng = random.Random(3)
    texts = [t for _, t in corpus(40)] + ["it's I'LL don't", "ΣΑΣ İ ﬁ ǅ", "a<|endoftext|>b<|startoftext|>", "é 한글 ½ ²\x85\xa0z", "x" * 5000, "".join(rng.choice("abé 'S1ñ\n") for _ in range(20_000)), "😀 12345"]
    got = {r["doc_id"]: r for r in bpe_encode(docs(spark, list(enumerate(texts)), True), VOCABULARY, digests=True).collect()}
    for i, text in enumerate(texts):
        ids = known.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = bpe_encode(docs(spark, [(1, "hello world"), (2, None)]), VOCABULARY)
    back = {r["doc_id"]: r["text"] for r in bpe_decode(whole, VOCABULARY).collect()}
    assert back == {r["doc_id"]: r["decoded"] for r in whole.collect()} and back[2] == ""
    assert bpe_encode(docs(spark, []), VOCABULARY).count() == 0


def test_bpe_on_every_code_point():
    tokenizers = pytest.importorskip("tokenizers")
    known, own = tokenizers.Tokenizer.from_file(VOCABULARY), WordBpe(VOCABULARY)
    texts = [f"a{c}1{c}{c} {c}b" for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)])]
    for i in range(0, len(texts), 1 << 16):
        some = texts[i : i + (1 << 16)]
        theirs = known.encode_batch(some, add_special_tokens=False)
        ours = own.encoded(some)
        wrong = [t for t, a, (b, _) in zip(some, theirs, ours, strict=True) if struct.pack(f"<{len(a.ids)}I", *a.ids) != b]
        assert not wrong


def test_bpe_words_are_kept_and_let_go():
    bpe = WordBpe(VOCABULARY)
    once = bpe.encoded(["hello hello world"])
    assert bpe.encoded(["hello hello world"]) == once == bpe.encoded(["hello hello world"]) and "hello" in bpe.known
    assert bpe.encode("") == [] and bpe.merge([]) == []


def test_shards(spark):
    rows = corpus(200) + [(None, "none"), (5, "twice"), (5, "twice")] + [(1000 + i, "hot " * 50) for i in range(150)]
    got = shard(docs(spark, rows, True), 7).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and set(sizes) == set(range(7)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    total, most = sum(sizes.values()), max(r["size"] for r in got)
    assert all(abs(x - total / 7) <= most for x in sizes.values())
    text = dict(rows)
    assert all(r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) and r["law"] == "bytes" and r["grown_shard"] is None for r in got if r["doc_id"] not in (None, 5))
    again = shard(docs(spark, rows), 7).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert shard(docs(spark, [])).count() == 0


def test_edit_distance_and_chains():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(30))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert edit_distance(a, b) == row[-1]
    x = np.array([0, 5, 9, 30, 34, 40]), np.array([100, 105, 109, 132, 136, 142])
    assert chains(*x) == [(0, 48, 100, 150)]
    assert chains(np.array([3]), np.array([4])) == []
    assert align(list(range(100)), list(range(20, 120)), 40, 60, 20, 40)[:4] == (20, 100, 0, 80)


def test_shared_passages(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(70)
    fuzzy = list(passage)
    fuzzy[20], fuzzy[50] = "new", "words"
    del fuzzy[35]
    make = lambda *parts: " ".join(x for p in parts for x in p)
    rows = [(i, make(fresh(100), passage, fresh(40))) for i in (1, 2, 3)] + [(4, make(fresh(10), fuzzy, fresh(90))), (5, make(fresh(200))), (6, make(fresh(60), passage[:30], fresh(60)))]
    copy = make(fresh(80))
    rows += [(7, copy), (8, copy), (8, copy), (9, None), (10, ""), (None, copy), (11, "same " * 300), (12, "same " * 250)]
    both = shared_passages(docs(spark, rows, True)).collect()
    assert {r["doc_id"] for r in both} == {1, 2, 3, 4, 7, 8, 11, 12} and [tuple(r)[:4] for r in both if r["doc_id"] == 7] == [(7, 0, 80, 8)]
    assert all(r["repeat"] == (r["doc_id"] > r["source_id"]) for r in both)
    got = [r for r in both if r["repeat"]]
    assert {(r["source_id"], r["source_first"], r["source_end"], r["doc_id"], r["first_word"], r["end_word"]) for r in got} == {tuple(r)[:6] for r in both if not r["repeat"]}
    exact = [r for r in got if {r["doc_id"], r["source_id"]} <= {1, 2, 3}]
    assert exact and all((r["first_word"], r["end_word"], r["source_first"], r["source_end"], r["similarity"]) == (100, 170, 100, 170, 1.0) for r in exact)
    near = [r for r in got if r["doc_id"] == 4]
    assert near and all((r["first_word"], r["end_word"]) == (10, 79) and 0.9 < r["similarity"] < 1 for r in near)
    assert [tuple(r)[:4] for r in got if r["doc_id"] == 8] == [(8, 0, 80, 7)]
    assert shared_passages(docs(spark, [])).count() == 0


def test_passages_with_gaps(spark):
    """Two passages of a pair, with other words between them on either side or both."""
    rng = random.Random(11)
    fresh = lambda n: [f"{rng.randrange(10**9)}" for _ in range(n)]
    gaps = [(n, n) for n in (10, 30, 60, 80, 120, 200, 300)] + [(n, 0) for n in (10, 60, 80, 300)] + [(0, n) for n in (10, 60, 80, 300)] + [(20, 120), (300, 60)]
    rows, places = [], {}
    for i, (here, there) in enumerate(gaps):
        one, two = fresh(60), fresh(60)
        rows += [(2 * i, " ".join(fresh(30) + one + fresh(here) + two + fresh(30))), (2 * i + 1, " ".join(fresh(30) + one + fresh(there) + two + fresh(30)))]
        places[2 * i + 1] = set(range(30, 90)) | set(range(90 + there, 150 + there))
    got = defaultdict(set)
    for r in shared_passages(docs(spark, rows)).where("repeat").collect():
        assert r["source_id"] == r["doc_id"] - 1 and r["similarity"] >= 0.75
        got[r["doc_id"]] |= set(range(r["first_word"], r["end_word"]))
    assert all(places[i] <= got[i] for i in places)


def test_passages_of_common_lines(spark):
    """Two texts share two lines that are each in many other texts."""
    rng = random.Random(12)
    fresh = lambda n: [f"{rng.randrange(10**9)}" for _ in range(n)]
    make = lambda *parts: " ".join(x for p in parts for x in p)
    rows, pairs = [], []
    for _ in range(12):
        one, two = fresh(30), fresh(30)
        rows += [make(fresh(40), line, fresh(40)) for line in (one, two) for _ in range(8)]
        pairs += [make(fresh(20), one, two, fresh(20)) for _ in range(2)]
    got = shared_passages(docs(spark, list(enumerate(rows + pairs)))).where("repeat").collect()
    assert {(r["doc_id"], r["source_id"], r["first_word"], r["end_word"], r["similarity"]) for r in got} == {(len(rows) + i + 1, len(rows) + i, 20, 80, 1.0) for i in range(0, 24, 2)}


def test_passages_with_even_edits(spark):
    """Every eighth word of a passage is another one: no eight words in a row are equal."""
    rng = random.Random(13)
    fresh = lambda n: [f"{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(20):
        passage = fresh(70)
        edited = [fresh(1)[0] if j % 8 == 7 else word for j, word in enumerate(passage)]
        rows += [(2 * i, " ".join(fresh(30) + passage + fresh(30))), (2 * i + 1, " ".join(fresh(30) + edited + fresh(30)))]
    got = shared_passages(docs(spark, rows)).where("repeat").collect()
    assert {(r["doc_id"], r["source_id"]) for r in got} == {(2 * i + 1, 2 * i) for i in range(20)}


@pytest.mark.parametrize("others", [6, 30])
def test_passages_whose_parts_others_hold(spark, others):
    """Two texts share an edited passage whose equal runs are each in other texts, too, different ones for each run: no seed's first holder or neighbour is the partner."""
    rng = random.Random(23)
    fresh = lambda n: [f"{rng.randrange(10**9)}" for _ in range(n)]
    make = lambda *parts: " ".join(x for p in parts for x in p)
    pairs, runs = 10, [[fresh(7) for _ in range(10)] for _ in range(10)]
    rows = [make(*(part for own in runs for part in (own[j], fresh(20)))) for j in range(10) for _ in range(others)]
    for own in runs:
        rows += [make(fresh(30), *(part for run in own for part in (run, fresh(1))), fresh(30)) for _ in range(2)]
    got = shared_passages(docs(spark, list(enumerate(rows)))).where("repeat").collect()
    assert {(r["doc_id"], r["source_id"]) for r in got} == {(len(rows) - 2 * i - 1, len(rows) - 2 * i - 2) for i in range(pairs)}
    assert len({r["doc_id"] for r in got if r["end_word"] - r["first_word"] >= 75 and 0.85 < r["similarity"] < 0.9}) == pairs


def test_all_pairs_and_likeness():
    i, j = all_pairs(np.array([0, 3, 4]), np.array([3, 1, 2]))
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(1, 0), (2, 0), (2, 1), (5, 4)]
    rng = np.random.default_rng(3)
    u = rng.integers(1, 60000, (1, 101)).astype(np.uint16)
    moved = np.concatenate([u[:, :50], rng.integers(1, 60000, (1, 12)).astype(np.uint16), u[:, 50:89]], 1)
    poor = u.copy()
    poor[0, ::3] = 0
    assert likely(u, moved).all() and not likely(u, poor).any() and not likely(u * 0, u * 0).any()


def hang_together(nodes, pairs):
    root = {x: x for x in nodes}
    for a, b in pairs:
        a, b = root[a], root[b]
        root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
    return len(set(root.values())) == 1


def test_meetings_grow_with_the_places():
    """60 places of a seed whose surroundings are edited copies, and 60 in runs of one word: as many pairs as join them, not all; runs of 50 are exact repeats, which hang together without."""
    rng = np.random.default_rng(5)
    base = rng.integers(1, 60000, 101).astype(np.uint16)
    near = np.tile(base, (60, 1))
    for row in near:
        row[rng.choice(np.r_[:40, 60:101], 4, False)] = rng.integers(1, 60000, 4)
    runs = rng.integers(1, 60000, (60, 101)).astype(np.uint16)
    for i, row in enumerate(runs):
        row[48 : 98 + i % 3] = 7
    for around in (near, runs):
        nodes = np.arange(60)
        pairs = [(i, j) for a, b in _meetings(nodes, nodes.copy(), np.full(60, 9), around) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(pairs) < 120 and (around is runs or hang_together(range(60), pairs))


def test_passages_of_one_word(spark):
    """Texts with 50 to 54 times one word in a row hang together in about as many rows; passages of a short run of one word and edited words beside it are found, and no others."""
    rng = random.Random(29)
    fresh = lambda n: [f"{rng.randrange(10**9)}" for _ in range(n)]
    beside = fresh(18)
    rows = [(i, " ".join(fresh(30) + ["word"] * (50 + i % 5) + fresh(30))) for i in range(40)]
    other = [(100 + i, " ".join(fresh(60) + [w if j % 6 else fresh(1)[0] for j, w in enumerate(beside)] + ["cell"] * 40 + fresh(60))) for i in range(2)]
    other += [(200 + i, " ".join(fresh(60) + ["cell"] * 20 + fresh(60))) for i in range(20)]
    got = [(r["doc_id"], r["source_id"]) for r in shared_passages(docs(spark, rows + other)).where("repeat").collect()]
    assert hang_together(range(40), [x for x in got if x[0] < 100]) and len([x for x in got if x[0] < 100]) < 200
    assert {x for x in got if x[0] >= 100} == {(101, 100)}


def test_passages_against_brute_force(spark):
    """A corpus with one passage in 5 % of the texts, another in a third, common lines, copies, edited passages and a very long text: every document with an exact repeat of 50 words is listed with all its repeated words, and all that is listed is similar."""
    rng = random.Random(17)
    fresh = lambda n: [f"{rng.randrange(10**7)}" for _ in range(n)]
    rare, common, lines = fresh(64), fresh(55), [fresh(26) for _ in range(6)]
    rows = []
    for i in range(160):
        parts = [fresh(rng.randrange(5, 120))]
        if i % 20 == 0:
            parts += [rare, fresh(rng.randrange(30))]
        if i % 3 == 0:
            parts += [common, fresh(rng.randrange(30))]
        parts += [x for x in rng.sample(lines, 3) if rng.random() < 0.6]
        if i % 7 == 0:
            edited = list(common)
            for _ in range(rng.randrange(1, 6)):
                edited[rng.randrange(55)] = fresh(1)[0]
            parts += [edited]
        rows.append((i, " ".join(x for p in parts for x in p)))
    rows += [(500 + i, rows[i * 9][1]) for i in range(6)] + [(600, " ".join(fresh(40_000) + rare + fresh(20_000))), (601, None), (602, "")]
    words = {i: (t or "").split() for i, t in rows}
    holders = defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - 49):
            holders[tuple(w[j : j + 50])].add(i)
    repeated = defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - 49):
            if len(holders[tuple(w[j : j + 50])]) > 1:
                repeated[i] |= set(range(j, j + 50))
    got, listed = shared_passages(docs(spark, rows)).collect(), defaultdict(set)
    for r in got:
        a, b = words[r["doc_id"]][r["first_word"] : r["end_word"]], words[r["source_id"]][r["source_first"] : r["source_end"]]
        assert min(len(a), len(b)) >= 50 and r["similarity"] >= 0.75 and r["similarity"] == pytest.approx(1 - edit_distance(a, b) / max(len(a), len(b)))
        listed[r["doc_id"]] |= set(range(r["first_word"], r["end_word"]))
    assert len(repeated) > 60 and all(repeated[i] <= listed[i] for i in repeated)
