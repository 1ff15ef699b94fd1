"""Approximate nearest rows: inverted lists of product-quantised residuals, with exact re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import state_path, store
from ..subjects import visible
from .similarity import LEFT, RIGHT, _waves, has_direction, unit_rows

#: Rows that the index is fitted on at most, lists at most, sample rows a list at least, parts of a vector, and entries of a part's codebook at most.
SAMPLE, LISTS, EACH, PARTS, ENTRIES = 20_000, 1024, 40, 16, 256


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """``k`` centres of the rows of ``x``; a centre without rows moves to the row that is furthest from its own."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        far = (centres**2).sum(axis=1)[None] - 2 * x @ centres.T
        own = far.argmin(axis=1)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            centres[empty] = x[np.argsort(-(far[np.arange(len(x)), own] + (x**2).sum(axis=1)), kind="stable")[: len(empty)]]
    return centres


@dataclass
class Codes:
    """Centres of the lists, and for each part of a residual its codebook."""

    centres: np.ndarray
    books: list[np.ndarray]

    @property
    def cuts(self) -> list[int]:
        dim = self.centres.shape[1]
        return [dim * i // len(self.books) for i in range(len(self.books) + 1)]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, parts: int) -> Codes:
        centres = k_means(x, lists)
        rest = x - centres[_nearest(x, centres)]
        at = [x.shape[1] * i // parts for i in range(parts + 1)]
        return cls(centres, [k_means(rest[:, a:b], ENTRIES, 8) for a, b in zip(at, at[1:], strict=False)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lists, codes) of unit vectors."""
        own = _nearest(x, self.centres)
        rest = x - self.centres[own]
        return own, np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)], axis=1).astype(np.uint8)

    def tables(self, u: np.ndarray) -> list[np.ndarray]:
        """For each part the products of the queries' part with all entries."""
        return [u[:, a:b] @ book.T for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)


def _encoded(codes: Codes) -> Callable:
    """(row, vector) to (row, list, code, unit vector)."""
    dim = codes.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, RIGHT):
                part = batch.slice(i, RIGHT)
                x = unit_rows(part.column(1), dim)
                own, code = codes.encode(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], ["row", "list", "code", "unit"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list, row, code), sorted by list, to blocks (list, rows, codes) of one list."""
    held: list[pa.RecordBatch] = []

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([rows["list"][0].as_py()], pa.int32()), pa.array([rows["row"].to_numpy().tobytes()], pa.binary()), pa.array([b"".join(rows["code"].to_pylist())], pa.binary())], ["list", "rows", "codes"])

    for batch in batches:
        lists = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(lists[1:] != lists[:-1]) + 1).tolist(), len(lists)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            for i in range(a, b, RIGHT):
                part = batch.slice(i, min(RIGHT, b - i))
                if held and (held[0].column(0)[0] != part.column(0)[0] or sum(x.num_rows for x in held) + part.num_rows > RIGHT):
                    yield block()
                held.append(part)
    if held:
        yield block()


def _probed(codes: Codes, probe: int) -> Callable:
    """(q, vector) to blocks (list, places, queries): the queries that look into a list, their unit vectors."""
    dim = codes.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = unit_rows(batch.column(1), dim)
            near = np.argsort((codes.centres**2).sum(axis=1)[None] - 2 * u @ codes.centres.T, axis=1, kind="stable")[:, :probe]
            names = batch.column(0).to_numpy()
            for own in np.unique(near).tolist():
                who = np.flatnonzero((near == own).any(axis=1))
                for i in range(0, len(who), LEFT):
                    yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([names[who[i : i + LEFT]].tobytes()], pa.binary()), pa.array([u[who[i : i + LEFT]].tobytes()], pa.binary())], ["list", "places", "vectors"])

    return run


def _guessed(codes: Codes, keep: int) -> Callable:
    """Pairs of blocks of one list to (q, row, guess): the task's ``keep`` best rows of every query by their codes."""
    dim = codes.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                own, rows, code, places, vectors = (batch.column(i)[r] for i in range(5))
                rows, places = np.frombuffer(rows.as_buffer(), np.int64), np.frombuffer(places.as_buffer(), np.int64)
                u = np.frombuffer(vectors.as_buffer(), np.float64).reshape(len(places), dim)
                code = np.frombuffer(code.as_buffer(), np.uint8).reshape(len(rows), -1)
                guess = np.repeat((u @ codes.centres[own.as_py()])[:, None], len(rows), axis=1)
                for p, table in enumerate(codes.tables(u)):
                    guess += table[:, code[:, p]]
                for q, place in enumerate(places.tolist()):
                    score, name = guess[q], rows
                    if place in held:
                        score, name = np.r_[held[place][0], score], np.r_[held[place][1], name]
                    if len(score) > keep:
                        best = np.argpartition(-score, keep)[:keep]
                        score, name = score[best], name[best]
                    held[place] = score, name
        for place, (score, name) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(name), place)), pa.array(name), pa.array(score)], ["q", "row", "guess"])

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, row, unit, query) to (q, row, score): exact cosines, rounded to 6 places."""
    for batch in batches:
        if batch.num_rows:
            x, u = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.float64).reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.round(np.einsum("nd,nd->n", x, u), 6) + 0.0)], ["q", "row", "score"])


class VectorIndex:
    """An index of a table of vectors, stored in the shared folder: ``rows`` (key, row, list, code, unit) and ``blocks`` (list, rows, codes).

    It is fitted on at most ``sample`` vectors, those with the least hashes; the lists' centres and the codebooks of residuals come from these
    alone, ``lists`` of them, without it the root of the number of rows, at most LISTS, with EACH sample rows a list. Every vector with a direction and of the length
    of most of the sample is in the index; vectors that are null or zero, hold null or non-finite components, or have another length are in no list. A list of any share of the
    rows is cut into blocks, so no task gets one whole. Null keys and repeated keys are rows of their own.
    """

    def __init__(self, df: DataFrame, key: str, values: str, lists: int | None = None, parts: int = PARTS, sample: int = SAMPLE):
        self.key, spark = key, df.sparkSession
        plain = visible(df).select(F.col(f"`{key}`").alias("key"), F.col(f"`{values}`").cast("array<double>").alias("v"))
        sound = plain.where(has_direction(F.col("v")))
        drawn = [r[0] for r in sound.orderBy(F.xxhash64("v", F.lit(3)), "v").select("v").limit(sample).collect()]
        lengths = [len(v) for v in drawn]
        self.dim = max(sorted(set(lengths)), key=lengths.count) if drawn else 0
        drawn = [v for v in drawn if len(v) == self.dim]
        self.codes: Codes | None = None
        if not drawn:
            self.kind = plain.schema["key"].dataType
            return
        n = sound.count()
        lists = lists or int(np.clip(np.sqrt(n), 1, min(LISTS, max(1, len(drawn) // EACH))))
        self.codes = Codes.fit(unit_rows(pa.array(drawn, pa.list_(pa.float64())), self.dim), lists, min(parts, self.dim))
        self.kind = plain.schema["key"].dataType
        kept = sound.where(F.size("v") == self.dim).withColumn("row", F.monotonically_increasing_id())
        kept, self.count = store(kept)
        coded, _ = store(kept.select("row", "v").mapInArrow(_encoded(self.codes), "row long, list int, code binary, unit binary"))
        self.keys, self.coded = kept.select("row", "key"), coded
        # a salt a block's worth of rows, so a list's blocks are made by many tasks
        salt = F.pmod(F.xxhash64("row"), F.lit(max(1, self.count // (RIGHT * 4)))).cast("int")
        dealt = coded.select("list", "row", "code").repartition("list", salt).sortWithinPartitions("list", "row")
        self.blocks, _ = store(dealt.mapInArrow(_blocks, "list int, rows binary, codes binary"))

    def search(self, queries: DataFrame, key: str, values: str, k: int, probe: int | None = None, keep: int = 64) -> DataFrame:
        """(key, the index's key, score, rank): about the ``k`` nearest rows to each query, by exact cosines rounded to 6 places, ties by the index's key.

        A query looks into the ``probe`` lists with the nearest centres, without it an eighth of them, 8 at least; the ``keep`` rows of these that are best by their codes are ranked by their vectors.
        Queries are packed in blocks by list, and these are broadcast in waves of a checked size to the blocks of the index, which stay where they are;
        no query comes to the driver. Only codes are read for the first choice, vectors for the rows that it leaves. Queries without a direction, or of another
        length than the index's, have no rows. A search is exact where ``probe`` is the number of lists and ``keep`` that of the rows.
        """
        name = f"{self.key}_rhs" if self.key == key else self.key
        left = visible(queries).select(F.col(f"`{key}`").alias("name"), F.col(f"`{values}`").cast("array<double>").alias("v"))
        out = [F.col("name").alias(key), F.col("key").alias(name), "score", "rank"]
        if self.codes is None:
            return left.limit(0).select(F.col("name").alias(key), F.lit(None).cast(self.kind).alias(name), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
        probe = probe or max(8, len(self.codes.centres) // 8)
        sound = left.where(has_direction(F.col("v"))).where(F.size("v") == self.dim).withColumn("q", F.monotonically_increasing_id())
        own, n = store(sound)
        packed, _ = store(own.select("q", "v").repartition(1 + n // 4096).mapInArrow(_probed(self.codes, probe), "list int, places binary, vectors binary"), state_path(left.sparkSession))
        guesses = None
        for wave in _waves(packed, packed.agg(F.sum(F.octet_length("vectors"))).first()[0] or 0):
            pairs = self.blocks.join(F.broadcast(wave), "list").select("list", "rows", "codes", "places", "vectors")
            part = pairs.mapInArrow(_guessed(self.codes, keep), "q long, row long, guess double")
            guesses = part if guesses is None else guesses.unionAll(part)
        best = guesses.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.col("guess").desc(), "row"))).where(F.col("nth") <= keep).select("q", "row")
        units = own.select("q", "v").mapInArrow(_units(self.dim), "q long, query binary")
        exact = best.join(self.coded.select("row", "unit"), "row").join(units, "q").select("q", "row", "unit", "query").mapInArrow(_scored, "q long, row long, score double")
        ranked = exact.join(self.keys, "row").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "key"))).where(F.col("rank") <= k)
        return ranked.join(own.select("q", "name"), "q").select(*out)


def _units(dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in unit_rows(batch.column(1), dim)], pa.binary())], ["q", "query"])

    return run
