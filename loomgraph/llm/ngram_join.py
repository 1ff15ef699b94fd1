"""N-gram Jaccard join with filters under several global token orders."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import linked_components
from .hot import SMALL_ROWS, hot_keys, join_groups, join_salted
from .identity import TextNodes
from .lean import lean
from .packed import MESSAGE, batch, messages, narrow, planes, send, unplanes, wide
from .scratch import Scratch, parts_for
from .words import mix, shingle_sets, text_batches

#: Tokens that a task gathers before it deals them out.
_BLOCK = 1 << 19
#: Texts, at least, that hot tokens are looked for in, the share of texts that a hot token is in, and the texts from which on it is one at any share.
SAMPLE, HOT, MOST = 10_000, 0.01, 1_000_000
_NODES = "node long, n long, shared binary, prefix array<long>, second array<int>, third array<int>"


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """So many first tokens of a set of ``n``, under any order of all tokens, hold one of any set as similar as asked."""
    return n - (n * percent + 99) // 100 + 1


def deal_tokens(parts: int, k: int, percent: int, hot: np.ndarray, weights: np.ndarray):
    """(node, text) to messages for ``parts`` ranges of token hashes.

    0: nodes, tokens, places of their nodes; 1: nodes, set sizes, cuts; 2: nodes, hot tokens, their weights, which no range need count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[int, np.ndarray] = {}
        held = 0
        bounds = np.array([(p << 64) // parts for p in range(parts)], np.uint64)

        def flush():
            own = np.fromiter(nodes, np.int64, len(nodes))
            sets = list(nodes.values())
            n = np.array([len(x) for x in sets], np.int64)
            cut = prefix_length(n, percent)
            low = np.array([x[c - 1] if len(x) else 0 for x, c in zip(sets, cut.tolist(), strict=True)], np.uint64)
            high = np.array([x[len(x) - c] if len(x) else 0 for x, c in zip(sets, cut.tolist(), strict=True)], np.uint64)
            out = [(int(mix(own[:1].view(np.uint64))[0] % np.uint64(parts)), 1, own.tobytes(), n.tobytes(), low.tobytes(), high.tobytes())]
            tokens = np.concatenate(sets)
            order = np.argsort(tokens)
            if len(hot) and len(tokens):
                at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
                known = hot[at] == tokens
                out.append((out[0][0], 2, np.repeat(own, n)[known].tobytes(), tokens[known].tobytes(), weights[at[known]].tobytes(), None))
                order = order[~known[order]]
            tokens, place = tokens[order], np.repeat(np.arange(len(own), dtype=np.uint32), n)[order]
            ends = np.r_[np.searchsorted(tokens, bounds), len(tokens)]
            for p in range(parts):
                if ends[p] < ends[p + 1]:
                    there, at = np.unique(place[ends[p] : ends[p + 1]], return_inverse=True)
                    out.append((p, 0, own[there].tobytes(), planes(tokens[ends[p] : ends[p + 1]]), narrow(at, len(there)), None))
            return batch(out)

        for given in batches:
            ids = given.column(0).to_numpy()
            for i, raw, ends in text_batches(given.column(1)):
                for node, tokens in zip(ids[i:].tolist(), shingle_sets(raw, ends, k), strict=False):
                    if node not in nodes:
                        nodes[node] = tokens
                        held += len(tokens) + 4
                if held >= _BLOCK:
                    yield flush()
                    nodes, held = {}, 0
        if nodes:
            yield flush()

    return run


def sampled_tokens(k: int):
    """(node, text) to the tokens of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, ends in text_batches(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(raw, ends, k)).view(np.int64))], ["token"])

    return run


def sampled(texts: DataFrame) -> tuple[DataFrame, int]:
    """About SAMPLE of ``texts`` (node, text), more of very many so that 40 have a token that MOST have, and the number of them that a hot token is in."""
    n = max(1, texts.count())
    share = min(1.0, max(SAMPLE, 40 * n / MOST) / n)
    return texts.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30))), max(4, int(min(share * n * HOT, share * MOST / 2)))


def shared_tokens(parts: int):
    """Messages by token range to messages by node: 0: nodes, their tokens that other nodes have too, in how many nodes each is; 1 as before."""

    def answer(tokens: np.ndarray, nodes: np.ndarray) -> list[tuple]:
        order = np.argsort(tokens, kind="stable")
        tokens, nodes = tokens[order], nodes[order]
        same = tokens[1:] == tokens[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        tokens, nodes = tokens[keep], nodes[keep]
        order = np.lexsort((nodes, tokens))
        tokens, nodes = tokens[order], nodes[order]
        if len(tokens):
            keep = np.r_[True, (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])]
            tokens, nodes = tokens[keep], nodes[keep]
            starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            counts = np.diff(np.r_[starts, len(tokens)])
            spread = np.repeat(counts, counts)
            tokens, nodes, spread = tokens[spread > 1], nodes[spread > 1], spread[spread > 1]
        else:
            spread = np.zeros(0, np.int64)
        return split(0, nodes, tokens, spread.astype(np.int64))

    def split(kind: int, nodes: np.ndarray, *cols: np.ndarray) -> list[tuple]:
        to = (mix(nodes.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to = to[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, to[1:] != to[:-1]]), len(to)] if len(to) else np.zeros(1, np.int64)
        sides = [nodes[order], *[x[order] for x in cols]]
        return [(int(to[a]), kind, *[x[a:b].tobytes() for x in sides], *[None] * (4 - len(sides))) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for to, kind, a, b, c, d in messages(batches):
            nodes = np.frombuffer(a, np.int64)
            out = []
            if kind == 2:
                out = split(0, nodes, np.frombuffer(b, np.uint64), np.frombuffer(c, np.int64))
            elif kind:
                out = split(1, nodes, np.frombuffer(b, np.int64), np.frombuffer(c, np.uint64), np.frombuffer(d, np.uint64))
            else:
                tokens = unplanes(b)
                held.setdefault(to, []).append((tokens, nodes[wide(c, len(tokens))]))
            if out:
                yield batch(out)
        while held:
            _, got = held.popitem()
            if out := answer(np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])):
                yield batch(out)

    return run


def nodes_of(percent: int):
    """Messages by node to a row per node: its tokens that others have too, and those among the first of all its tokens under three orders.

    ``prefix``: rarest first; ``second``, ``third``: by rising and by falling hash, the lower 32 bits.
    A node that has none under one of the orders can't have a partner: its arrays are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, entries = [], []
        for _, kind, a, b, c, d in messages(batches):
            if kind:
                heads.append((np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), np.frombuffer(c, np.uint64), np.frombuffer(d, np.uint64)))
            else:
                entries.append((np.frombuffer(a, np.int64), np.frombuffer(b, np.uint64), np.frombuffer(c, np.int64)))
        if not heads:
            return
        node, first = np.unique(np.concatenate([x[0] for x in heads]), return_index=True)
        n, low, high = (np.concatenate([x[i] for x in heads])[first] for i in (1, 2, 3))
        owner, tokens, spread = (np.concatenate([x[i] for x in entries]) for i in range(3)) if entries else (node[:0], low[:0], n[:0])
        entries.clear()
        order = np.lexsort((mix(tokens), spread, owner))
        owner, tokens = owner[order], tokens[order]
        # a hot token comes once from every block that has a copy of the text
        fresh = np.r_[True, (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1])][: len(owner)]
        owner, tokens = owner[fresh], tokens[fresh]
        begins, ends = np.searchsorted(owner, node, "left"), np.searchsorted(owner, node, "right")
        open_ = prefix_length(n, percent) - (n - (ends - begins))
        kinds = [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for i in range(0, len(node), 2048):
            cols: list[list] = [[], [], [], []]
            for a, b, p, least, most in zip(begins[i : i + 2048].tolist(), ends[i : i + 2048].tolist(), open_[i : i + 2048].tolist(), low[i : i + 2048], high[i : i + 2048], strict=True):
                row = (None,) * 4
                if b > a and p > 0:
                    rising = np.sort(tokens[a:b])
                    short = rising.astype(np.uint32).view(np.int32)
                    second, third = short[: np.searchsorted(rising, least, "right")], short[np.searchsorted(rising, most, "left") :]
                    if len(second) and len(third):
                        row = rising.tobytes(), tokens[a : a + p].view(np.int64), second, third
                for col, x in zip(cols, row, strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 2048]), pa.array(n[i : i + 2048]), *[pa.array(x, t) for x, t in zip(cols, kinds, strict=True)]], ["node", "n", "shared", "prefix", "second", "third"])

    return run


def _similar(percent: int):
    """Pairs (a, b, sizes and shared tokens of either) to those that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            n, m = col["n"].to_numpy(), col["m"].to_numpy()
            found = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(col["shared"][i].as_buffer(), np.uint64), np.frombuffer(col["shared2"][i].as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (int(n[i]) + int(m[i]) - both):
                    found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(col[x].to_numpy()[found]) for x in "ab"], ["a", "b"])

    return run


def verify(pairs: DataFrame, n: int, nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Those of ``n`` stored pairs (a, b) of nodes that are similar.

    Pairs share a token of the first order. Those that share none of the second's or none of the third's
    first tokens go; only then whole sets are fetched and compared. Nodes in very many pairs, as
    leaders of large groups are, are dealt to several tasks.
    """
    hot = {side: hot_keys(pairs, side, n) for side in "ab"}
    ends = pairs.select("b").distinct()
    few = n <= SMALL_ROWS or ends.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS

    def joined(pairs: DataFrame, *cols: str) -> DataFrame:
        own = nodes.select(F.col("node").alias("a"), *cols)
        other = nodes.select(F.col("node").alias("b"), *[F.col(c).alias("m" if c == "n" else f"{c}2") for c in cols])
        other = other.join(F.broadcast(ends), "b", "left_semi") if few else other
        return join_salted(join_salted(pairs, own, "a", hot["a"], "b"), other, "b", hot["b"], "a")

    close = joined(pairs, "second", "third").where(F.arrays_overlap("second", "second2") & F.arrays_overlap("third", "third2")).select("a", "b")
    close = scratch.table(close, "close")
    return joined(close, "n", "shared").select("a", "b", "n", "m", "shared", "shared2").mapInArrow(lean(_similar(percent)), "a long, b long")


def link_classes(texts: DataFrame, scratch: Scratch, k: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, n) and the components (node, root) of the similarity graph over ``texts`` (node: long, text).

    Under any order of all tokens, similar sets share one of their first tokens (the prefix).
    Three orders serve: rarest first (by exact counts of the sets that hold a token, ties by
    hash), rising hash and falling hash. A set whose prefix under any of them is its own alone has
    no partner. Candidates share a prefix token under the first; pairs that do not under the second
    and third too are dropped before any set is fetched.

    Tokens travel as packed 64-bit hashes: each range of hashes is counted by one task, which
    answers only with tokens of two or more sets. Tokens in HOT of all texts, by a sample, or in MOST
    texts go past that count: they come last in the order, by their count in the sample, so no
    task gets the entries of a token that more texts hold. There are at most the mean set's size /
    HOT of them, or twice all tokens / MOST.

    A pair is a candidate only by a token from which on either has tokens enough for it, under
    the first order: the first token that similar sets share is such a one.
    ``linked_components`` does the rest without listing the pairs of a group.
    """
    parts = 2 * parts_for(texts)
    drawn, bar = sampled(texts)
    counts = drawn.mapInArrow(lean(sampled_tokens(k)), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= bar).toArrow()
    hot = counts["token"].to_numpy().view(np.uint64)
    order = np.argsort(hot)
    hot, weights = hot[order], (1 << 60) + counts["texts"].to_numpy()[order]
    dealt = send(texts.mapInArrow(lean(deal_tokens(parts, k, percent, hot, weights)), MESSAGE), parts)
    answers = send(dealt.mapInArrow(lean(shared_tokens(parts)), MESSAGE), parts)
    nodes = scratch.table(answers.mapInArrow(lean(nodes_of(percent)), _NODES), "nodes")
    live = nodes.where("prefix is not null")
    posts = live.select("node", "n", F.expr("octet_length(shared) div 8 AS known"), F.posexplode("prefix").alias("at", "token"))
    posts = posts.selectExpr("token", "node", "named_struct('all', n, 'known', known, 'rest', known - at) AS n")
    n, m = F.col("n"), F.col("m")
    near = (n["all"] * 100 >= m["all"] * percent) & (m["all"] * 100 >= n["all"] * percent) & (F.least(n["rest"], m["rest"]) * (100 + percent) >= (n["all"] + m["all"]) * percent)
    test = lambda pairs, n: verify(pairs, n, live, percent, scratch)
    roots = linked_components(scratch.table(posts, "posts"), test, scratch, near, (n["all"] - n["known"]) / n["all"])
    return nodes.select("node", "n"), roots


def ngram_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """(id, node, n_shingles, component_id): a row per row of ``docs``, copies too.

    A set holds the distinct runs of ``k`` words, or with fewer words the whole sequence as one;
    words are runs of characters other than space and 0x09-0x0D, A-Z lower-cased. Two texts link
    when 100 * |A and B| >= percent * |A or B|; ``component_id`` is the smallest id that links
    reach. Equal texts are one node (``TextNodes``), so copies cost nothing. Texts without
    words, empty and null ones, link with nothing: n_shingles 0, their own id. Rows with a null id
    link as others do but give no id. Rows that repeat an id keep their own texts. No rows give none.
    """
    return _classes(docs, id_col, text_col, k, percent)[0]


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, Column]:
    """``ngram_classes`` and the column of ``docs`` that is a row's node."""
    scratch = Scratch(docs.sparkSession, "ngram")
    known = TextNodes(docs, id_col, text_col, scratch)
    texts = docs.where(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(known.node.alias("node"), F.col(text_col).alias("text"))
    nodes, roots = link_classes(texts, scratch, k, percent)
    rows, sizes = known.rows, known.groups.drop("most")
    classes = sizes.join(nodes, "node", "left").join(roots, "node", "left")
    least = classes.groupBy(F.coalesce("root", "node").alias("at")).agg(F.min("least").alias("component"))
    classes = classes.withColumn("at", F.coalesce("root", "node")).join(least, "at").select("node", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "component", "members")
    out = join_groups(rows, scratch.table(classes, "classes"), "node", "members")
    scratch.keep("rows", "classes")
    return out.select(F.col("id").alias(id_col), "node", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id")), known.node


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each class of similar texts, that with the smallest id; all columns stay.

    Texts without words stay all, and so do rows without an id; rows that repeat id and text become one.
    """
    scratch = Scratch(docs.sparkSession, "drop-near")
    found, node = _classes(docs, id_col, text_col, k, percent)
    found = scratch.table(found.select(F.col(id_col).alias("own"), "node", "n_shingles", "component_id"), "found")
    gone = found.where("n_shingles > 0 and own is not null and own <> component_id").select("own", "node").distinct()
    twice = scratch.table(found.where("own is not null").groupBy("own", "node").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "twice").drop("rows")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own"), node.alias("node"))
    stay = rows.join(gone, ["own", "node"], "left_anti")
    if twice.isEmpty():
        return stay.select("row.*")
    again = stay.join(twice, ["own", "node"], "left_semi").groupBy("own", "node").agg(F.first("row").alias("row"))
    return stay.join(twice, ["own", "node"], "left_anti").select("row.*").unionByName(again.select("row.*"))
