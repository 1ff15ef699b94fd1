"""Joins of rows to their groups when one group may hold a third of all rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot if it holds more than this share of the rows, so there are fewer than 1 / share hot groups at any size of input.
HOT_SHARE = 1 / 1000
#: A table of at most so many rows may be broadcast.
SMALL_ROWS = 50_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner", counts: tuple[int, int] | None = None) -> DataFrame:
    """Join every row to its group on ``key``; ``groups`` is a stored table with one row per key and its row count in ``size``.

    Hot groups, of which there are under 1 / HOT_SHARE, are broadcast, so their rows stay where
    they are. So is a table of groups that was counted and is small. All other rows are
    shuffled by key. ``how`` is inner or left. Null keys join nothing. ``counts``, if known: the number of groups, and of rows in them.
    """
    n, total = counts or groups.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if n <= SMALL_ROWS:
        return rows.join(F.broadcast(groups), key, how)
    if how == "left":
        # rows of no group stay where they are: a shuffle would bring them all to one task
        none = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in groups.schema if f.name != key])
        return none.unionByName(_joined_groups(rows.where(F.col(key).isNotNull()), groups, key, size, how, total).select(*none.columns))
    return _joined_groups(rows, groups, key, size, how, total)


def _joined_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str, total: int | None) -> DataFrame:
    bar = max(1000, int((total or 0) * HOT_SHARE))
    hot = groups.where(F.col(size) > bar)
    if hot.isEmpty():
        return rows.join(groups, key, how)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(size) <= bar), key, how)
    return near.unionByName(far)


def hot_keys(rows: DataFrame, key: str, n: int) -> DataFrame | None:
    """(key, salts) of the keys in over HOT_SHARE of the ``n`` rows: under 1 / HOT_SHARE of them, found by a partial aggregate. ``salts`` is how many times that share a key is in. None without any."""
    bar = max(1000, int(n * HOT_SHARE))
    if n <= bar:
        return None
    found = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / bar).cast("int").alias("salts")).where((F.col("salts") > 1) & F.col(key).isNotNull())
    got = found.collect()
    return rows.sparkSession.createDataFrame(got, found.schema) if got else None


def join_salted(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None, salt_by: str, only: bool = False) -> DataFrame:
    """Join ``rows`` to ``table``, one row per key, whose rows may be too large to be broadcast.

    Rows of the ``hot_keys`` are dealt by a hash of ``salt_by``, and their rows of ``table``
    are repeated as often: at most 1 / HOT_SHARE repeats in all. ``only``: all keys of ``rows`` are hot.
    """
    if hot is None:
        return rows.join(table, key)
    how = "inner" if only else "left"
    dealt = rows.join(F.broadcast(hot), key, how).withColumn("salt", F.pmod(F.xxhash64(salt_by), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    spread = table.join(F.broadcast(hot), key, how).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt.join(spread, [key, "salt"]).drop("salt")


def join_skewed(rows: DataFrame, table: DataFrame, key: str, n_rows: int, n_table: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``table``, which has one narrow row per key; any key may be in a large share of the rows.

    A small table is broadcast; so are, beyond that, its rows of the ``hot_keys``. All else is
    shuffled by key. ``how`` is inner or left.
    """
    if n_table <= SMALL_ROWS:
        return rows.join(F.broadcast(table), key, how)
    hot = hot_keys(rows, key, n_rows)
    if hot is None:
        return rows.join(table, key, how)
    hot = hot.select(key)
    near = rows.join(F.broadcast(hot), key).join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key, how)
    far = rows.join(F.broadcast(hot), key, "left_anti").join(table, key, how)
    return near.unionByName(far)
