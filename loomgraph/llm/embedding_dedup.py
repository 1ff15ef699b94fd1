"""Embedding near-dedup by spherical-cap filters: a random product code, decoded to lists."""

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import linked_components
from .hot import hot_keys, join_groups, join_salted
from .lean import lean
from .scratch import Scratch, parts_for

#: Blocks of a direction; unit vectors per block, from and to, so that there are ROOM filters per vector: code ** BLOCKS.
#: A vector is in each filter whose direction it exceeds by so much that random vectors are in MEAN on average, and in its LEAST best at least.
BLOCKS, CODES, ROOM, MEAN, LEAST = 4, (64, 512), 320, 22, 32
#: Vectors of a component that are compared at a time.
BLOCK = 512


def code_size(n: int) -> tuple[int, int]:
    """Unit vectors per block for ``n`` vectors, and filters that a vector is in at least: lists stay as short as ``n`` grows, and recall as high."""
    size = int(min(max(CODES[0], np.ceil((ROOM * n) ** (1 / BLOCKS))), CODES[1]))
    return size, int(LEAST * np.sqrt(size / CODES[0]))


@lru_cache(maxsize=8)
def _code(dim: int, size: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(rotation into padded dimensions, block code) for vectors of ``dim``."""
    rng = np.random.default_rng([seed, dim])
    wide = max(4 * BLOCKS, -(-dim // BLOCKS) * BLOCKS)
    turn = np.linalg.qr(rng.standard_normal((wide, wide)))[0][:dim]
    code = rng.standard_normal((BLOCKS, size, wide // BLOCKS))
    return turn, code / np.linalg.norm(code, axis=2, keepdims=True) / np.sqrt(BLOCKS)


def decode(vectors: np.ndarray, size: int = CODES[0], least: int = LEAST) -> list[np.ndarray]:
    """The filters of every unit vector: all directions that it exceeds, or its best few if those are fewer.

    A direction's score is the sum of its four blocks'. The sums of blocks 1 and 2 and of 3
    and 4 are pruned by what the other half could add, and only what is left is combined.
    """
    n, dim = vectors.shape
    turn, code = _code(dim, size)
    blocks = (vectors @ turn).reshape(n, BLOCKS, -1)
    score = np.einsum("nbd,bcd->nbc", blocks, code)
    front = (score[:, 0, :, None] + score[:, 1, None, :]).reshape(n, -1)
    back = (score[:, 2, :, None] + score[:, 3, None, :]).reshape(n, -1)
    level = NormalDist().inv_cdf(1 - MEAN * least / LEAST / size**BLOCKS) / np.sqrt(turn.shape[1])
    out = []
    for a, b in zip(front, back, strict=True):
        bar = level
        while True:
            i, j = np.flatnonzero(a >= bar - b.max()), np.flatnonzero(b >= bar - a.max())
            x, y = np.nonzero(a[i][:, None] + b[j][None, :] >= bar)
            if len(x) >= least:
                break
            bar -= 0.1 * level
        found = i[x] * size**2 + j[y]
        if bar < level and len(found) > least:
            found = found[np.argsort(-(a[i[x]] + b[j[y]]), kind="stable")[:least]]
        out.append(found)
    return out


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat doubles and offsets of an array column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.array([len(x) for x in column]) if len(column) else np.zeros(0, np.int64)
    return flat, np.r_[0, np.cumsum(lengths)]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; divided by their largest component first, so that no square under- or overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filters(size: int, least: int):
    """(node, vector) to (token, node): a token names a filter and the dimension."""
    step = max(1, 256 * CODES[0] ** 2 // size**2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for i in range(0, batch.num_rows, step):
                flat, ends = _unit(batch.column(1).slice(i, step))
                dims = np.diff(ends)
                for dim in np.unique(dims):
                    rows = np.flatnonzero(dims == dim)
                    x = np.stack([flat[ends[r] : ends[r + 1]] for r in rows])
                    lists = decode(unit(x), size, least)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists) + (int(dim) << 36)), pa.array(np.repeat(nodes[i + rows], [len(y) for y in lists]))], ["token", "node"])

    return run


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows of doubles with rows."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return np.einsum("nd,nd->n", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def _close(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (u, at), (v, to) = _unit(batch.column(2)), _unit(batch.column(3))
            dims = np.diff(at)
            keep = np.zeros(batch.num_rows, bool)
            for dim in np.unique(dims):
                rows = np.flatnonzero((dims == dim) & (np.diff(to) == dim))
                if len(rows):
                    keep[rows] = cosines(np.stack([u[at[r] : at[r] + dim] for r in rows]), np.stack([v[to[r] : to[r] + dim] for r in rows])) >= least
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep))

    return run


def _count(least: float):
    """Sorted rows (root, i, j, side, node, members, vector) to (node, links): for each node of side 0, how many vectors of side 1 are close."""

    def counts(rows: pa.Table) -> pa.RecordBatch:
        side, members = rows["side"].to_numpy(), rows["members"].to_numpy()
        flat, ends = _unit(rows["vector"].combine_chunks())
        x = flat.reshape(len(side), -1)
        x = unit(x)
        own, other = side == 0, side == 1
        links = ((x[own] @ x[other].T) >= least) @ members[other]
        return pa.RecordBatch.from_arrays([pa.array(rows["node"].to_numpy()[own]), pa.array(links.astype(np.int64))], ["node", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            key = np.column_stack([table[c].to_numpy() for c in ("root", "i", "j")])
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=len(cuts) > 0) if len(cuts) else ():
                yield counts(table.slice(a, b - a))
            held = table.slice(int(cuts[-1])) if len(cuts) else table
        if held is not None and len(held):
            yield counts(held)

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept): a row per row of ``vectors``.

    Two vectors link when their cosine in doubles is ``least`` or more. Candidates share a
    filter; every candidate that decides a component is verified. ``n_links`` then counts
    all other vectors of the component that are that close, by blocks of a component against
    blocks, so links are counted once, also those that share no filter, and no pair is listed. Filters are random, so a pair can be
    missed if no path of found links joins it: README has the recall.

    Equal vectors are one node (two 64-bit hashes) and link with each other. Vectors that are null,
    empty or zero, or hold null or non-finite components, link with nothing and stay. Only
    vectors of one length are compared. Null ids link but are nobody's component_id; rows that
    repeat an id are vectors of their own. No rows give none; other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    v = F.col(vector_col).cast("array<double>")
    sound = F.coalesce(F.col(vector_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = scratch.table(vectors.select(F.col(id_col).cast("long").alias("id"), F.when(sound, F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit(7), v).alias("b"))).alias("both"), F.when(sound, F.col(vector_col)).alias("vector")), "rows")
    # of vectors with one number the second hash tells those apart that differ, and gives all but the first another number
    numbers = rows.where("both is not null").groupBy("both").agg(F.count(F.lit(1)).alias("n")).groupBy("both.a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = [r[0] for r in numbers.select("a").collect()]
    node = F.when(F.col("both.a").isin(twice), F.col("both.b")).otherwise(F.col("both.a")) if twice else F.col("both.a")
    rows = rows.select("id", node.alias("node"), "vector")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("members"), F.first("vector").alias("vector"))
    nodes = scratch.table(nodes, "nodes")
    size, few = code_size(scratch.rows("nodes"))
    posts = nodes.select("node", "vector").repartition(parts_for(nodes), "node").mapInArrow(lean(_filters(size, few)), "token long, node long").withColumn("n", F.lit(1).cast("long"))

    def verify(pairs: DataFrame, n: int) -> DataFrame:
        a, b = nodes.select(F.col("node").alias("a"), F.col("vector").alias("u")), nodes.select(F.col("node").alias("b"), F.col("vector").alias("v"))
        # a leader may be in a third of the pairs
        met = join_salted(pairs.join(a, "a"), b, "b", hot_keys(pairs, "b", n), "a")
        return met.select("a", "b", "u", "v").mapInArrow(lean(_close(least)), "a long, b long")

    roots = scratch.table(linked_components(scratch.table(posts, "posts"), verify, scratch), "roots")
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    inside = join_groups(roots, scratch.table(sizes, "sizes"), "root", "size").join(nodes, "node")
    inside = inside.select("root", "node", "members", "vector", "blocks", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int").alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = inside.select("root", F.col("own").alias("i"), every.alias("j"), F.lit(0).alias("side"), "node", "members", "vector")
    right = inside.select("root", every.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "node", "members", "vector")
    dealt = left.unionByName(right).repartition(parts_for(nodes), "root", "i", "j").sortWithinPartitions("root", "i", "j")
    links = dealt.mapInArrow(lean(_count(least)), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    first = roots.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("size"))
    # most vectors are in no component: they go no further, instead of meeting under a null root
    linked = join_groups(roots, scratch.table(first, "first"), "root", "size").select("node", "component")
    linked = nodes.select("node", "members").join(linked, "node").join(links, "node").select("node", "members", (F.col("links") - 1).alias("n_links"), "component")
    alone = nodes.join(roots, "node", "left_anti").select("node", "members", (F.col("members") - 1).alias("n_links"), F.col("least").alias("component"))
    classes = linked.unionByName(alone)
    out = join_groups(rows.select("id", "node"), scratch.table(classes, "classes"), "node", "members", "left")
    scratch.keep("rows", "classes")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
