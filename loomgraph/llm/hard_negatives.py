"""Hard negatives: blocks of anchors against blocks of candidates by dense matrix products."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lean import lean
from .scratch import Scratch
from .vector_blocks import by_length, in_range, sound, whole_numbers

#: Rows of a block of candidates, and of anchors; bytes of the anchors that are broadcast at a time, at most twice.
CANDIDATES, ANCHORS, WAVE_BYTES = 4096, 256, 32 << 20
#: Products are exact in doubles below 2**53; a score and a place in a block share a 64-bit key below 2**50.
_EXACT, _KEYED = 1 << 53, 1 << 50
_NONE = np.iinfo(np.int64).min
_BLOCK = "dim int, ids binary, labels binary, vectors binary"


def pack_candidates(size: int) -> Callable:
    """(id, label, vector) to blocks of ``size`` vectors of one length, rising by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _candidates(batches, size)

    return run


def _candidates(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[pa.RecordBatch]] = {}

    def block(dim: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held.pop(dim)).combine_chunks().to_batches()[0]
        ids = rows.column(0).to_numpy()
        order = np.argsort(ids, kind="stable")
        x = whole_numbers(rows.column(2)) if dim else np.zeros((len(ids), 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([v[order].tobytes()], pa.binary()) for v in (ids, rows.column(1).to_numpy(), x.astype(np.int32))]], _names(_BLOCK))

    for batch in batches:
        for dim, rows in by_length(batch, 2):
            for i in range(0, rows.num_rows, size):
                rest = rows.slice(i, size)
                room = size - sum(x.num_rows for x in held.get(dim, []))
                held.setdefault(dim, []).append(rest.slice(0, room))
                if rest.num_rows >= room:
                    yield block(dim)
                    if rest.num_rows > room:
                        held[dim] = [rest.slice(room)]
    for dim in list(held):
        yield block(dim)


def pack_anchors(size: int) -> Callable:
    """(key, id, label, vector, scores of its positives) to blocks of ``size`` vectors of one length; missing scores are the least long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _anchors(batches, size)

    return run


def _anchors(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, rows in by_length(batch, 3):
            for i in range(0, rows.num_rows, size):
                part = rows.slice(i, size)
                keys, ids, labels = (part.column(c).to_numpy() for c in range(3))
                x = whole_numbers(part.column(3)).astype(np.int32) if dim else np.zeros((len(ids), 0), np.int32)
                given = part.column(4).to_pylist()
                scores = np.full((len(ids), max(map(len, given), default=0)), _NONE, np.int64)
                for r, found in enumerate(given):
                    scores[r, : len(found)] = found
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (keys, ids, labels, x, scores)]], _names(_ANCHOR))


_ANCHOR = "dim int, keys binary, ids binary, labels binary, vectors binary, scores binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, as longs: in doubles where these are exact, else in longs."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if top < _EXACT else a.astype(np.int64) @ b.astype(np.int64).T


def best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the ``k`` best allowed columns of every row, ties by the smaller id; ``ids`` rise. Missing ones score the least long."""
    width = scores.shape[1]
    if width <= CANDIDATES and np.abs(scores).max(initial=0) < _KEYED:
        key = np.where(allowed, scores * CANDIDATES + (CANDIDATES - 1 - np.arange(width)), _NONE)
        if width > k:
            key = np.partition(key, width - k, axis=1)[:, width - k :]
        key = -np.sort(-np.maximum(key, -np.iinfo(np.int64).max), axis=1)
        there = key > -np.iinfo(np.int64).max
        return np.where(there, key // CANDIDATES, _NONE), np.where(there, ids[np.where(there, CANDIDATES - 1 - key % CANDIDATES, 0)], 0)
    value = np.where(allowed, scores, _NONE)
    order = np.lexsort((np.broadcast_to(ids, value.shape), -np.maximum(value, -np.iinfo(np.int64).max)), axis=-1)[:, :k]
    return np.take_along_axis(value, order, 1), ids[order]


def merged(k: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of two such lists for every row."""
    scores, ids = np.concatenate([a[0], b[0]], axis=-1), np.concatenate([a[1], b[1]], axis=-1)
    order = np.lexsort((ids, -np.maximum(scores, -np.iinfo(np.int64).max)), axis=-1)[..., :k]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


def _met(k: int, choose: Callable) -> Callable:
    """Pairs of an anchor block and a candidate block to (key, slot, id, score): the ``k`` best of the task's candidates for every anchor and slot.

    ``choose(scores, same label, ids differ, ids of candidates, positives' scores)`` gives lists of (scores, ids), one a slot. What is held is k
    numbers a slot for the anchors of a wave, however many candidates come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[bytes, list] = {}
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                raw = {name: column[name][r].as_buffer() for name in column if name not in ("dim", "dim_a")}
                dim = column["dim"][r].as_py()
                if dim != column["dim_a"][r].as_py():
                    continue
                ids, labels, a_ids, a_labels = (np.frombuffer(raw[n], np.int64) for n in ("ids", "labels", "ids_a", "labels_a"))
                x, y = np.frombuffer(raw["vectors_a"], np.int32).reshape(len(a_ids), dim), np.frombuffer(raw["vectors"], np.int32).reshape(len(ids), dim)
                scores = products(x, y)
                found = choose(scores, a_labels[:, None] == labels[None, :], a_ids[:, None] != ids[None, :], ids, np.frombuffer(raw["scores_a"], np.int64).reshape(len(a_ids), -1))
                name = raw["keys_a"].to_pybytes()
                state[name] = [merged(k, old, new) for old, new in zip(state[name], found, strict=True)] if name in state else found
        for name, slots in state.items():
            keys = np.frombuffer(name, np.int64)
            for slot, (scores, ids) in enumerate(slots):
                row, nth = np.nonzero(scores != _NONE)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(np.full(len(row), slot, np.int32)), pa.array(ids[row, nth]), pa.array(scores[row, nth])], ["key", "slot", "id", "score"])

    return run


def _positives(k: int) -> Callable:
    def choose(scores, same, other, ids, _):
        return [best(scores, same & other, ids, k)]

    return choose


def _negatives(k: int, slots: int, low: int, high: int) -> Callable:
    """``low`` and ``high``, in hundredths of a positive's score, are the window."""

    def choose(scores, same, other, ids, bars):
        out = []
        apart = ~same & other
        for slot in range(slots):
            bar = bars[:, slot : slot + 1] if slot < bars.shape[1] else np.full((len(scores), 1), _NONE)
            # the window in whole scores, hundreds apart so that no product leaves a long; a negative bar has none
            whole, rest = np.divmod(np.maximum(bar, 0), 100)
            least, most = whole * low + -(-rest * low // 100), whole * high + rest * high // 100
            out.append(best(scores, apart & (bar >= 0) & (scores >= least) & (scores <= most), ids, k))
        return out

    return choose


def _waves(blocks: DataFrame, bytes_: int) -> list[DataFrame]:
    """The anchor blocks in parts of WAVE_BYTES or so, each proven to be of twice that or one block at most before any is broadcast."""
    n = max(1, -(-bytes_ // WAVE_BYTES))
    while n > 1:
        wave = F.pmod(F.xxhash64("keys"), F.lit(n))
        sizes = blocks.groupBy(wave).agg(F.sum(_size()).alias("bytes"), F.count(F.lit(1)).alias("n"))
        if sizes.where((F.col("bytes") > 2 * WAVE_BYTES) & (F.col("n") > 1)).isEmpty():
            return [blocks.where(wave == i) for i in range(n)]
        n *= 2
    return [blocks]


def _size() -> Column:
    return sum((F.octet_length(c) for c in _names(_ANCHOR)[1:]), F.lit(0))


def _best_of_all(met: DataFrame, k: int) -> DataFrame:
    """The ``k`` best a key and slot of what the tasks kept, ``rank`` from 1."""
    by = Window.partitionBy("key", "slot").orderBy(F.col("score").desc(), "id")
    return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, relabel: Column | None = None, block: int = CANDIDATES, anchor_block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for the best ``positives`` of every anchor, the
    best ``negatives`` rows of other labels that score from ``low`` to ``high`` hundredths of what the positive scores.

    Anchors are the rows whose id is divisible by ``every``. A score is the inner product of the vectors' ``floor(256 * x)``, in
    doubles where these are exact; higher ones come first, ties by the smaller id. Candidates are packed in blocks once. Blocks of
    anchors are broadcast in waves of a checked size and meet every block of candidates; a task holds the best few for each
    anchor of the wave. A first pass finds positives, a second the negatives in their windows; neither lists pairs.

    ``relabel`` gives the label to use, else it is the column. Rows with a null id, label or vector, with a null or non-finite
    component, or with one of 2**17 or more either way, whose products a long may not hold, take no part. Only vectors of one length
    meet. A row with the anchor's own id is neither its positive nor its negative; anchors that repeat an id are mined each.
    A positive with a negative score has no negatives. No rows, or none that fit, give none; other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "negatives")
    label = F.col(label_col) if relabel is None else relabel
    rows = vectors.where(F.col(id_col).isNotNull() & sound(F.col(vector_col)) & in_range(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where("label is not null")
    blocks = scratch.table(rows.mapInArrow(lean(pack_candidates(min(block, CANDIDATES))), _BLOCK), "candidates")
    own = scratch.table(rows.where(F.col("id") % every == 0).withColumn("key", F.monotonically_increasing_id()), "anchors")
    # anchors of many small files meet in full blocks
    tasks = 1 + scratch.rows("anchors") // (16 * anchor_block)

    def passed(anchors: DataFrame, name: str, k: int, choose: Callable) -> DataFrame:
        packed = scratch.table(anchors.repartition(tasks).mapInArrow(lean(pack_anchors(anchor_block)), _ANCHOR), f"{name}-blocks", bytes=F.sum(_size()))
        met = None
        for wave in _waves(packed, scratch.seen[f"{name}-blocks"]["bytes"] or 0):
            pairs = blocks.crossJoin(F.broadcast(wave.select(*[F.col(c).alias(f"{c}_a") for c in _names(_ANCHOR)])))
            part = pairs.mapInArrow(lean(_met(k, choose)), "key long, slot int, id long, score long")
            met = part if met is None else met.unionAll(part)
        return scratch.table(_best_of_all(met, k), name)

    none = F.array().cast("array<long>")
    found = passed(own.select("key", "id", "label", "vector", none.alias("scores")), "positives", positives, _positives(positives))
    scores = found.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    left = passed(own.join(scores, "key").select("key", "id", "label", "vector", "scores"), "negatives", negatives, _negatives(negatives, positives, low, high))
    near = found.select("key", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = left.select("key", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(near, ["key", "slot"]).join(own.select("key", F.col("id").alias("anchor_id")), "key")
    scratch.keep("anchors", "positives", "negatives")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
