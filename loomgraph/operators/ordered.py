"""Ordered work per key when one key may hold a third of all rows: as-of joins, running aggregates, sessions.

Rows are dealt in ranges of (keys, order), so a hot key takes many ranges, split by its order. A
window works within a range; what a range hands on to the next is one row, found by a small
aggregate, carried from range to range, and joined back. The number of ranges is that of
Spark's partitions, so the carried table is small at any size of input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import store

_RANGE, _FIRST, _LAST, _LUCK, _NTH = "_range", "_first_key", "_last_key", "_luck", "_nth"


def _orderable(kind: str) -> bool:
    return "map<" not in kind and "variant" not in kind


class Ranged:
    """``df`` stored in ranges of (keys, order): ``rows`` has the range's number in ``_range``, ``bounds`` each range's first and last key.

    ``order`` are columns, the first of which may be equal in many rows; a hash of the whole row and a number follow them, so rows of one time and equal rows can be split as well.
    Nulls come first, and null keys are one key. ``falling`` is an order whose columns all fall, with nulls last.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[Column], falling: bool = False):
        self.keys, self.order = keys, [*order, *[F.col(c).desc() if falling else F.col(c) for c in (_LUCK, _NTH)]]
        plain = [F.col(f"`{c}`") for c, kind in df.dtypes if _orderable(kind)]
        dealt = df.withColumn(_LUCK, F.xxhash64(*plain)).withColumn(_NTH, F.monotonically_increasing_id()).repartitionByRange(*[F.col(f"`{k}`") for k in keys], *self.order)
        self.rows, self.count = store(dealt.withColumn(_RANGE, F.spark_partition_id()))
        key = self.key
        self.bounds = self.rows.groupBy(_RANGE).agg(F.min(key).alias(_FIRST), F.max(key).alias(_LAST))

    @property
    def key(self) -> Column:
        return F.struct(*[F.col(f"`{k}`") for k in self.keys])

    @property
    def window(self):
        """The rows of one key in one range, in order."""
        return Window.partitionBy(_RANGE, *[F.col(f"`{k}`") for k in self.keys]).orderBy(*self.order)

    def carried(self, rows: DataFrame, source: DataFrame, tail: dict[str, Column], merge: dict[str, object]) -> DataFrame:
        """``rows``, of ``self.rows`` with more columns, with what came before their range: for each ``name`` of ``tail``, an aggregate of ``source``, the same rows, over a range's last key,
        ``merge[name](column, window)`` over all earlier ranges of the same key; null where the key begins in the range."""
        bounds = F.broadcast(self.bounds)
        ends = source.join(bounds, _RANGE).where(self.key.eqNullSafe(F.col(_LAST))).groupBy(_RANGE).agg(*[c.alias(n) for n, c in tail.items()])
        # a row a range, so that one task with all of them, and their broadcast, are small
        ends = self.bounds.join(ends, _RANGE)
        same = Window.partitionBy(_LAST).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, 0)
        upto = ends.select(_RANGE, _FIRST, _LAST, *[merge[n](F.col(n), same).alias(n) for n in tail])
        step = Window.orderBy(_RANGE)
        before = F.lag(_LAST).over(step).eqNullSafe(F.col(_FIRST))
        brought = upto.select(_RANGE, _FIRST, *[F.when(before, F.lag(n).over(step)).alias(n) for n in tail])
        out = rows.join(F.broadcast(brought), _RANGE)
        return out.withColumns({n: F.when(self.key.eqNullSafe(F.col(_FIRST)), F.col(n)) for n in tail}).drop(_FIRST)


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[str], direction: str = "backward", exact: bool = True, tolerance: Column | None = None, tie: list[str] | None = None) -> DataFrame:
    """Every row of ``left`` with the last row of ``right`` of equal keys at its time or before; ``direction="forward"`` the first at it or after.

    Both sides are merged in ranges of (keys, time), and a range's last right row is carried to the ranges that go on with
    its key, so a hot key is split by time and no key is one task. Without ``exact`` a right row of the same time does not count. Where the times,
    which are of one type, are further apart than ``tolerance``, an interval or a number, there is no match.

    Of right rows of one time, the one with the greatest ``tie`` columns, nulls least, is taken, forward the one with the least; without ``tie`` those are all its columns that
    can be ordered. Left rows with a null key or time, and those without a match, stay, with nulls; right rows with a null key or time match nothing.
    Repeated left rows stay. Right columns whose names meet the left's get the suffix ``_rhs``; the keys are the left's.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"The direction is backward or forward, not {direction}.")
    names = {c: f"{c}_rhs" if c in left.columns else c for c in right.columns if c not in by}
    ranks = tie if tie is not None else [c for c, kind in right.dtypes if c not in (*by, right_time) and _orderable(kind)]
    keys = [f"_k{i}" for i in range(len(by))]
    back = direction == "backward"

    def side(df: DataFrame, time: str, *more: Column) -> DataFrame:
        return df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], F.col(f"`{time}`").alias("_time"), *more)

    sound = right.dropna(subset=[*by, right_time])
    found = side(sound, right_time, F.struct(F.lit(0).alias("t"), *[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(ranks)]).alias("_tie"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("_right"))
    kind = dict(found.dtypes)
    given = side(left, left_time, F.lit(None).cast(kind["_tie"]).alias("_tie"), F.lit(None).cast(kind["_right"]).alias("_right"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"))
    both = given.unionByName(found.withColumn("_left", F.lit(None).cast(given.schema["_left"].dataType)))
    own = F.col("_left").isNotNull()
    # right rows come before left ones of the same time where these count, else after; forward all is read from its end
    order = ["_time", "_side", "_tie"]
    ranged = Ranged(both.withColumn("_side", own if exact == back else ~own), keys, [F.col(c) if back else F.col(c).desc() for c in order], falling=not back)
    match = F.when(F.col("_right").isNotNull(), F.struct("_time", "_right"))
    rows = ranged.rows.withColumn("_here", F.last(match, ignorenulls=True).over(ranged.window))
    tail = (F.max_by if back else F.min_by)(match, F.when(match.isNotNull(), F.struct(*order, _LUCK)))
    rows = ranged.carried(rows, ranged.rows, {"_before": tail}, {"_before": lambda c, w: F.last(c, ignorenulls=True).over(w)}).where(own)
    best = F.coalesce("_here", "_before")
    if tolerance is not None:
        near = F.col("_time") <= best["_time"] + tolerance if back else best["_time"] <= F.col("_time") + tolerance
        best = F.when(near, best)
    # null keys are one range's key, but no right row has one
    return rows.withColumn("_match", F.when(F.col("_time").isNotNull(), best)).select("_left.*", *[F.col(f"_match._right.c{i}").alias(n) for i, n in enumerate(names.values())])


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with running sums per key, in order: for each name the sum of its column over the rows up to this one, nulls counting as nothing.

    Rows of one place in the order are taken one after the other, by a hash of the whole row, so sums over them are fixed; equal rows may swap. A count is the running
    sum of ones. Sums of doubles are added range by range, so their last digits may differ with the ranges.
    A key of any share of the rows is split by its order. Null keys are one key; nulls come first in the order.
    """
    ranged = Ranged(df, keys, [F.col(f"`{c}`") for c in order])
    upto = ranged.window.rowsBetween(Window.unboundedPreceding, 0)
    source = ranged.rows.withColumns({f"_own_{n}": F.coalesce(c, F.lit(0)) for n, c in values.items()})
    rows = source.withColumns({n: F.sum(f"_own_{n}").over(upto) for n in values})
    rows = ranged.carried(rows, source, {f"_from_{n}": F.sum(f"_own_{n}") for n in values}, {f"_from_{n}": lambda c, w: F.sum(c).over(w) for n in values})
    return rows.withColumns({n: F.col(n) + F.coalesce(f"_from_{n}", F.lit(0)) for n in values}).select(*df.columns, *values)


def with_previous(df: DataFrame, keys: list[str], time: str, name: str = "previous") -> tuple[Ranged, DataFrame]:
    """(ranges, their rows with the key's time before this row's): a key's first row has null."""
    ranged = Ranged(df, keys, [F.col(f"`{time}`")])
    rows = ranged.rows.withColumn(name, F.lag(f"`{time}`").over(ranged.window))
    rows = ranged.carried(rows, ranged.rows, {"_before": F.max(f"`{time}`")}, {"_before": lambda c, w: F.max(c).over(w)})
    return ranged, rows.withColumn(name, F.coalesce(name, "_before")).drop("_before")


def sessions(df: DataFrame, keys: list[str], time: str, gap: Column) -> DataFrame:
    """``df`` with ``session``, from 0: a key's rows in time, a new session where more than ``gap``, an interval, has passed since the row before.

    What lies between two rows and how many sessions began before are carried from range to range, so a key of any share of the rows, and a session of any length,
    is split by time. Null times come first and are a session of their own; null keys are one key.
    """
    ranged, rows = with_previous(df, keys, time, "_previous")
    at = F.col(f"`{time}`")
    # the first row of a key opens session 0, so does its first time after nulls open one
    opens = F.when(F.col("_previous").isNotNull() & (at > F.col("_previous") + gap), 1).otherwise(0)
    nulls = F.max(at.isNull().cast("int")).over(Window.partitionBy(_RANGE, *[F.col(f"`{k}`") for k in keys]))
    rows = rows.withColumn("_opens", opens).withColumn("_nulls", nulls)
    upto = ranged.window.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("_opens").over(upto))
    rows = ranged.carried(rows, rows, {"_from": F.sum("_opens"), "_had": F.max("_nulls")}, {"_from": lambda c, w: F.sum(c).over(w), "_had": lambda c, w: F.max(c).over(w)})
    after = F.when(at.isNotNull(), F.greatest("_nulls", F.coalesce("_had", F.lit(0)))).otherwise(0)
    return rows.select(*df.columns, (F.col("_sum") + F.coalesce("_from", F.lit(0)) + after).cast("long").alias("session"))
