"""Connected components of links, as DataFrame jobs."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hot import SMALL_ROWS, join_groups, join_skewed
from .lean import lean
from .scratch import Scratch


#: Links that one task joins into components.
ONE_TASK = 50_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) to (node, root), by union of sets of which the smallest node is the root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], ["node", "root"])


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long); ``root`` is the smallest node of its component.

    Every round hooks each node to its smallest neighbour, follows these pointers to their
    ends, and contracts the links to links between ends, until ONE_TASK links or fewer are left,
    which one task joins. Groups are reduced by partial aggregates and joins on nodes that very
    many rows point to go past the shuffle (``join_skewed``), so a component of any size costs no task
    more than its share. Null ends and self-links count for nothing. Only counts and the under 1,000 hot nodes are collected.
    """
    links = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links, left = scratch.table(links, f"{name}-links-0"), scratch.rows(f"{name}-links-0")
    found, step = None, 0
    while left > ONE_TASK:
        step += 1
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up"))
        hook = scratch.table(hook, f"{name}-hook-{step}-0")
        n, jump, moved = scratch.rows(f"{name}-hook-{step}-0"), 0, 1
        while moved:
            up = hook.select(F.col("node").alias("up"), F.col("up").alias("above"))
            nxt = join_skewed(hook, up, "up", n, n).select("node", F.col("above").alias("up"), (F.col("above") != F.col("up")).alias("moved"))
            jump += 1
            hook = scratch.table(nxt, f"{name}-hook-{step}-{jump}", moved=F.count_if("moved")).drop("moved")
            moved = scratch.seen[f"{name}-hook-{step}-{jump}"]["moved"]
            scratch.drop(f"{name}-hook-{step}-{jump - 1}")
        found = _relabelled(found, hook.select("node", F.col("up").alias("root")), n, scratch, f"{name}-found-{step}")
        half = join_skewed(links, hook.select(F.col("node").alias("a"), F.col("up").alias("x")), "a", left, n)
        half = half if n <= SMALL_ROWS else scratch.table(half, f"{name}-half-{step}")
        links = join_skewed(half, hook.select(F.col("node").alias("b"), F.col("up").alias("y")), "b", left, n)
        links = links.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links, left = scratch.table(links, f"{name}-links-{step}"), scratch.rows(f"{name}-links-{step}")
        scratch.drop(f"{name}-links-{step - 1}", f"{name}-half-{step}", f"{name}-hook-{step}-{jump}", f"{name}-found-{step - 1}")
    if found is not None and not left:
        return found
    ends = scratch.table(links.repartition(1).mapInArrow(lean(_joined), "node long, root long"), f"{name}-ends")
    return _relabelled(found, ends, scratch.rows(f"{name}-ends"), scratch, f"{name}-roots")


def _relabelled(found: DataFrame | None, ends: DataFrame, n: int, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) with the roots that ``ends`` (node, root; ``n`` rows) gives for the roots of ``found``, a stored table."""
    if found is None:
        return scratch.table(ends, name)
    further = join_skewed(found, ends.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", found.count(), n, "left")
    return scratch.table(further.select("node", F.coalesce("top", "root").alias("root")), name)


#: Rounds of tests against leaders at most, and pairs left per posting at which they end early.
ROUNDS, OPEN = 5, 2
#: By how much the choice of leaders is shaken, more with every round.
SHAKE = 0.02
#: Nodes of a block of a list that one task pairs.
BLOCK = 1024


def linked_components(posts: DataFrame, verify: Callable[[DataFrame, int], DataFrame], scratch: Scratch, near: Column | None = None, fringe: Column | None = None) -> DataFrame:
    """(node, root) of all linked nodes, where links are the pairs in one list that ``verify`` keeps.

    ``posts`` (token, node, n), stored, lists the nodes of every token, with anything about a node in n; ``verify`` gives those of
    stored pairs (a, b), so many, that are similar; pairs against ``near``, a condition on their n and m, can't be.

    ``fringe``, a number of a node's n, is the larger the fewer nodes may be like it; leaders have a small one.

    Components are wanted, not all pairs. In a round every node is tested against one leader
    of its open lists, that which shares most of them; lists whose nodes are in one component close.
    Rounds end when few pairs of different components share a list, or a round hardly lessens
    them; those left are then all tested, so no link between components is lost, and a group of
    n nodes that are alike costs about n tests. Lists of any length are joined by ``join_groups``
    and paired by ``listed_pairs``, so no task gets one list whole.
    """
    counted = lambda name: (scratch.rows(name), scratch.seen[name]["entries"] or 0)
    shared = scratch.table(posts.groupBy("token").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1"), "lists", entries=F.sum("nodes"))
    posts = scratch.table(join_groups(posts, shared, "token", "nodes", counts=counted("lists")).select("token", "node", "n"), "posts-0")
    links, labels, before = None, None, float("inf")
    for turn in range(ROUNDS + 1):
        lists = posts if labels is None else posts.join(labels, "node", "left")
        label = F.col("node") if labels is None else F.coalesce("root", "node")
        lists = lists.select("token", "node", "n", label.alias("label"))
        if turn:
            counts = lists.groupBy("token", "label").agg(F.count(F.lit(1)).alias("nodes"))
            open_ = counts.groupBy("token").agg(F.sum("nodes").alias("all"), F.sum(F.col("nodes") * F.col("nodes")).alias("within")).where("all * all > within")
            open_ = scratch.table(open_.select("token", "all", ((F.col("all") * F.col("all") - F.col("within")) / 2).alias("pairs")), f"open-{turn}", entries=F.sum("all"), pairs=F.sum("pairs"))
            lists = scratch.table(join_groups(lists, open_, "token", "all", counts=counted(f"open-{turn}")).select("token", "node", "n", "label", "all"), f"posts-{turn}")
            scratch.drop(f"posts-{turn - 1}")
            posts = lists.select("token", "node", "n")
            left, entries = scratch.seen[f"open-{turn}"]["pairs"] or 0, scratch.rows(f"posts-{turn}")
            if left <= OPEN * entries or 1.1 * left > before or turn == ROUNDS:
                break
            before = left
        chance = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        luck = chance if fringe is None else fringe + chance * (SHAKE * turn)
        leads = lists.groupBy("token").agg(F.min(F.struct(luck.alias("luck"), F.col("node").alias("lead"), F.col("n").alias("m"), F.col("label").alias("other"))).alias("x"), F.count(F.lit(1)).alias("size"))
        leads = scratch.table(leads.select("token", "x.lead", "x.m", "x.other", "size"), f"leads-{turn}", entries=F.sum("size"))
        met = join_groups(lists, leads, "token", "size", counts=counted(f"leads-{turn}")).where(F.col("label") != F.col("other"))
        met = met if near is None else met.where(near)
        best = met.groupBy("node", "lead").agg(F.count(F.lit(1)).alias("times")).groupBy("node").agg(F.max(F.struct("times", "lead")).alias("x"))
        pairs = scratch.table(best.select(F.col("node").alias("a"), F.col("x.lead").alias("b")), f"pairs-{turn}")
        found = scratch.table(verify(pairs, scratch.rows(f"pairs-{turn}")), f"links-{turn}")
        links = found if links is None else links.union(found)
        labels = components(links, scratch, f"labels-{turn}")
    rest = scratch.table(listed_pairs(lists, near), "pairs-rest")
    found = scratch.table(verify(rest, scratch.rows("pairs-rest")), "links-rest")
    return components(links.union(found), scratch, "labels") if scratch.rows("links-rest") else labels


def listed_pairs(lists: DataFrame, near: Column | None) -> DataFrame:
    """(a, b): distinct pairs of nodes with different labels in one list of ``lists`` (token, node, n, label, all: the list's nodes).

    A list is dealt as blocks against blocks of BLOCK nodes, so a task pairs no more than two
    blocks, however long the list.
    """
    blocks = F.ceil(F.col("all") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    left = lists.select("token", own.alias("i"), every.alias("j"), "node", "n", "label")
    right = lists.select("token", every.alias("i"), own.alias("j"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("label").alias("other"))
    rest = left.join(right, ["token", "i", "j"]).where((F.col("node") < F.col("b")) & (F.col("label") != F.col("other")))
    rest = rest if near is None else rest.where(near)
    return rest.select(F.col("node").alias("a"), "b").distinct()
