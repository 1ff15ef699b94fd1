"""Vector codes: a codebook a part of the vectors, by Lloyd rounds that send only what changed."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot import join_groups
from .lean import lean
from .scratch import Scratch
from .vector_blocks import SCALE, in_range, sound, whole_numbers

#: Parts of a vector, entries of a part's codebook, and rounds.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors whose distances to all entries are held at a time.
_BLOCK = 2048
_DELTA = "part int, entry int, n long, sums array<long>"


def cuts(dim: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end: equal parts if ``parts`` divides ``dim``, else as near as may be."""
    return [dim * i // parts for i in range(parts + 1)]


def nearest(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances): each part's nearest entry, the lower index of equally near ones; (rows, parts) both, in whole numbers."""
    at = cuts(x.shape[1], len(books))
    codes, far = np.zeros((len(x), len(books)), np.uint8), np.zeros((len(x), len(books)), np.int64)
    for i in range(0, len(x), _BLOCK):
        for p, book in enumerate(books):
            d = np.zeros((len(x[i : i + _BLOCK]), len(book)), np.int64)
            for c in range(at[p], at[p + 1]):
                apart = x[i : i + _BLOCK, c, None] - book[None, :, c - at[p]]
                apart *= apart
                d += apart
            codes[i : i + _BLOCK, p] = d.argmin(axis=1)
            far[i : i + _BLOCK, p] = d.min(axis=1)
    return codes, far


def _assign(books: list[np.ndarray], keep: list[str], error: bool):
    """(code, vector, others) to the same with the new code, the old one in ``old``, and with ``error`` the distances' sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, far = nearest(whole_numbers(batch.column(1)), books)
            out = [pa.array([c.tobytes() for c in codes], pa.binary())]
            out += [pa.array(far.sum(axis=1))] if error else [batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays([*out, *batch.columns[2:]], ["code", *(["error"] if error else ["old", "vector"]), *keep])

    return run


def _deltas(dim: int, parts: int, entries: int):
    """(code, old, vector) to what the parts whose entry changed add to its count and sums, and take from those of the entry before, added up over the task."""
    at = cuts(dim, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((entries, dim), np.int64)
        touched = np.zeros((parts, entries), bool)
        for batch in batches:
            x = whole_numbers(batch.column(2))
            new = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(len(x), parts)
            given = batch.column(1).to_pylist()
            had = np.array([o is not None for o in given], bool)
            old = np.frombuffer(b"".join(o if o is not None else bytes(parts) for o in given), np.uint8).reshape(len(x), parts)
            changed = ~had[:, None] | (new != old)
            for p in range(parts):
                for code, rows, sign in ((new, changed[:, p], 1), (old, changed[:, p] & had, -1)):
                    entry = code[rows, p]
                    n[p] += sign * np.bincount(entry, minlength=entries)
                    touched[p, entry] = True
                    np.add.at(sums[:, at[p] : at[p + 1]], entry, sign * x[rows, at[p] : at[p + 1]])
        part, entry = np.nonzero(touched)
        if len(part):
            own = [sums[e, at[p] : at[p + 1]].tolist() for p, e in zip(part.tolist(), entry.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(own, pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): a row per row of ``vectors`` whose vector is there and finite.

    Vectors become whole numbers, ``floor(256 * x)``, and are cut into ``parts``. The codebook of a part begins with the parts of the
    ``entries`` (256 at most) smallest ids. A round assigns every part to its nearest entry, the lower of equally near ones, and makes an entry the
    floored mean of its parts. The assignments and the entries' counts and whole sums are kept from round to round, in tables:
    a task adds up what the parts that changed their entry bring and take away, one row for an entry at most, and only that is
    shuffled and added to the sums. So a late round, in which little changes, sends little, and the sums are exact.

    ``code`` is two hex digits a part; ``error`` the squared distances' sum; ``label_error`` is it over equal labels, nulls being one.
    Vectors of another length than the first id's, or with a component of 2**17 or more either way, whose squares a long may not hold, stay, with a null code and error.
    Null ids come after all others when entries are chosen, rows that repeat an id by their vectors; each is a row of its own. With fewer than
    ``entries`` vectors a codebook has fewer entries. No vectors give no rows; other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("A codebook has 1 to 256 entries.")
    scratch = Scratch(vectors.sparkSession, "codes")
    label = F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit(""))
    rows = vectors.where(sound(F.col(vector_col))).select(F.col(id_col).alias("id"), label.alias("key"), F.col(vector_col).alias("vector"), in_range(F.col(vector_col)).alias("fits"))
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    first = rows.where("fits").orderBy(*order).select("vector").limit(1).collect()
    dim = len(first[0][0]) if first else 0
    fits = F.col("fits") & (F.size("vector") == dim)
    # as many vectors as a codebook has entries
    least = [r[0] for r in rows.where(fits).orderBy(*order).select("vector").limit(entries).collect()]
    seeds = np.floor(np.array(least, np.float64).reshape(len(least), dim) * SCALE).astype(np.int64)
    at = cuts(dim, parts)
    books = [seeds[:, at[p] : at[p + 1]].copy() for p in range(parts)]
    none = F.lit(None).cast("binary")
    kind = rows.schema["vector"].dataType.simpleString()
    state = rows.where(fits).select(none.alias("code"), "vector")
    sums: DataFrame | None = None
    for turn in range(rounds if len(seeds) else 0):
        state = scratch.table(state.mapInArrow(lean(_assign(books, [], False)), f"code binary, old binary, vector {kind}"), f"state-{turn}")
        found = state.mapInArrow(lean(_deltas(dim, parts, len(seeds))), _DELTA)
        found = found if sums is None else found.unionByName(sums)
        total = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(max(b - a for a, b in zip(at, at[1:], strict=False)))]
        found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total)
        sums = scratch.table(found.select("part", "entry", "n", F.array(*[F.col(f"s{i}") for i in range(len(total))]).cast("array<long>").alias("sums")), f"sums-{turn}")
        # one row an entry at most
        for part, entry, n, values in sums.collect():
            if n:
                books[part][entry] = [v // n for v in values[: at[part + 1] - at[part]]]
        state = state.select("code", "vector")
        scratch.drop(f"state-{turn - 1}", f"sums-{turn - 1}")
    ended = rows.where(fits).select(none.alias("code"), "vector", "id", "key")
    ends = f"code binary, error long, id {rows.schema['id'].dataType.simpleString()}, key string"
    ended = ended.mapInArrow(lean(_assign(books, ["id", "key"], True)), ends) if len(seeds) else ended.select("code", F.lit(None).cast("long").alias("error"), "id", "key").limit(0)
    odd = rows.where(~fits).select(none.alias("code"), F.lit(None).cast("long").alias("error"), "id", "key")
    ended = scratch.table(ended.unionByName(odd), "ended")
    labels = scratch.table(ended.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error")), "labels")
    out = join_groups(ended, labels, "key", "n")
    scratch.keep("ended", "labels")
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
