"""Aggregates that can be stored and merged, and grouping sets with distinct counts."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import store

#: Of a count-min sketch: how far above the truth an estimate may be, as a share of all rows, and how likely it is to be further.
ERROR, RISK = 0.002, 0.01
#: Of a distinct sketch: 2 ** PRECISION registers, a standard error of about 1.04 / 2 ** (PRECISION / 2). Of a quantile sketch: its k.
PRECISION, QUANTILES = 12, 400
#: Rows of a table for which grouping sets have a part more.
PART_ROWS = 1 << 20


def _width(error: float) -> int:
    return math.ceil(math.e / error)


def _depth(risk: float) -> int:
    return math.ceil(math.log(1 / risk))


def _cells(value: Column, error: float, risk: float) -> Column:
    """The cells of a value, one in every row of the sketch."""
    width = _width(error)
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), value), F.lit(width)).cast("int") + i * width for i in range(_depth(risk))])


def sketches(df: DataFrame, keys: list[str], distinct: str, quantile: str, frequent: str, error: float = ERROR, risk: float = RISK) -> DataFrame:
    """(keys ..., rows, distinct, quantiles, counts) of every group, to be stored and merged later.

    ``distinct`` is a sketch of how many values that column has, ``quantiles`` one of the column's distribution, both binary; ``counts`` a
    count-min sketch of a column's values, the cells that are not zero: as many as the sketch has at most. All are partial aggregates before the exchange, so a group of any size sends
    one sketch a task. Nulls are counted in ``rows`` alone; NaN values have no quantile. Null keys are a group.
    """
    value = F.col(f"`{quantile}`").cast("double")
    plain = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(F.col(f"`{distinct}`"), F.lit(PRECISION)).alias("distinct"), F.kll_sketch_agg_double(F.when(~F.isnan(value), value), F.lit(QUANTILES)).alias("quantiles"))
    cells = df.where(F.col(f"`{frequent}`").isNotNull()).select(*keys, F.explode(_cells(F.col(f"`{frequent}`"), error, risk)).alias("_cell"))
    return _joined(plain, cells.withColumn("_n", F.lit(1).cast("long")), keys)


def _joined(plain: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    summed = cells.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_n"))
    packed = summed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_cell", "_n"))).alias("counts"))
    if not keys:
        return plain.crossJoin(F.broadcast(packed))
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    other = packed.withColumnsRenamed(names)
    same = F.lit(True)
    for k, n in names.items():
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(n))
    return plain.join(other, same, "left").drop(*names.values()).withColumn("counts", F.coalesce("counts", F.create_map().cast("map<int,bigint>")))


def merge_sketches(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Stored ``sketches`` merged to coarser groups, a rollup without the rows."""
    plain = stored.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"))
    return _joined(plain, stored.select(*keys, F.explode("counts").alias("_cell", "_n")), keys)


def estimate_counts(stored: DataFrame, values: DataFrame, keys: list[str], value: str, error: float = ERROR, risk: float = RISK) -> DataFrame:
    """(keys ..., value, estimate): how often each of the ``values`` came in its group, by the stored count-min sketches of the same error and risk.

    An estimate is never too small, and by more than ``error`` of the group's rows too large with odds of ``risk``. Cells meet by a join, so neither side need be small. Null keys and values have none.
    """
    asked = values.select(*keys, value).distinct().withColumn("_cell", F.explode(_cells(F.col(f"`{value}`"), error, risk)))
    cells = stored.select(*keys, F.explode("counts").alias("_cell", "_n"))
    met = asked.join(cells, [*keys, "_cell"], "left")
    return met.where(F.col(f"`{value}`").isNotNull()).groupBy(*keys, value).agg(F.min(F.coalesce("_n", F.lit(0).cast("long"))).alias("estimate"))


def grouping_distinct(df: DataFrame, dims: list[str], distinct: list[str], sums: dict[str, Column] | None = None, sets: list[list[str]] | None = None) -> DataFrame:
    """(dims ..., grouping, rows, sums ..., distinct_<column> ...) of grouping sets, all subsets of ``dims`` without ``sets``: a cube.

    A set's missing dimensions are null, and ``grouping`` has a bit, the first dimension's the highest, for each that is missing, so a null in the data is told from it. Rows are first brought down to
    one for each finest group, with its counts and sums, and one for each value in it that is to be counted once; only these are repeated for the sets, after they were dealt by value to parts of PART_ROWS table rows or so. Spark's own expansion
    repeats every row for every set and every distinct column. Null values are not counted. A table without rows has no groups but the grand total, of nothing.
    """
    sums = sums or {}
    wanted = sets if sets is not None else [list(c) for n in range(len(dims), -1, -1) for c in combinations(dims, n)]
    bits = {d: 1 << (len(dims) - 1 - i) for i, d in enumerate(dims)}
    groups = F.array(*[F.lit(sum(bits[d] for d in dims if d not in s)) for s in wanted]).cast("array<int>")
    kinds = dict(df.dtypes)

    def spread(rows: DataFrame) -> DataFrame:
        own = rows.withColumn("grouping", F.explode(groups))
        return own.withColumns({d: F.when(F.col("grouping").bitwiseAND(F.lit(bits[d])) == 0, F.col(f"`{d}`")).cast(kinds[d]) for d in dims})

    finest, _ = store(df.groupBy(*dims).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(n) for n, c in sums.items()]))
    counted = finest.agg(F.sum("rows")).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), counted // PART_ROWS)
    out = spread(finest).groupBy(*dims, "grouping").agg(F.sum("rows").alias("rows"), *[F.sum(n).alias(n) for n in sums])
    if not counted and any(not s for s in wanted):
        total = df.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(n) for n, c in sums.items()])
        out = total.select(*[F.lit(None).cast(kinds[d]).alias(d) for d in dims], F.lit(sum(bits.values())).cast("int").alias("grouping"), "rows", *sums)
    for i, c in enumerate(distinct):
        each = df.where(F.col(f"`{c}`").isNotNull()).select(*dims, F.col(f"`{c}`").alias("_value")).distinct()
        # all sets' rows of a value are made in one task, so they need no exchange to be told apart; parts are by rows, not by bytes, which say little of the repeated rows
        values = spread(each.repartition(parts, "_value")).distinct()
        names = {d: f"_d{j}" for j, d in enumerate([*dims, "grouping"])}
        counts = values.groupBy(*dims, "grouping").agg(F.count(F.lit(1)).alias(f"_n{i}")).withColumnsRenamed(names)
        same = F.lit(True)
        for d, n in names.items():
            same = same & F.col(f"`{d}`").eqNullSafe(F.col(n))
        out = out.join(counts, same, "left").drop(*names.values()).withColumn(f"distinct_{c}", F.coalesce(f"_n{i}", F.lit(0).cast("long"))).drop(f"_n{i}")
    return out
