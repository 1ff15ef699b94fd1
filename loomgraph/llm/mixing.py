"""Mixing sources to target weights by entropy balancing, in DataFrame functions only."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Newton steps at most and in one job, and the relative error of every source's tokens at which they end.
STEPS, AT_ONCE, CLOSE = 80, 4, 1e-9
#: Documents in a cell that are ranked together, about; sizes in a band.
CELL, BAND = 4096, 64
_FIXES = 3


def n_words(text: str):
    """The number of runs of characters other than space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """``sources`` (source, total) with its ``target``: weights repeat over the sources by code point, null last.

    Targets share the sum of all totals by weight. One that would pass ``cap`` times its total
    stops there and the excess is reshared. Closed form: sorted by cap per weight, the first
    sources are capped, as many as leave the rest's level above their own.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    nth = F.row_number().over(order) - 1
    weighted = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int"))).withColumn("most", F.col("total") * float(cap))
    ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    up, every = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighted.withColumn("rest", F.sum("total").over(every) - F.coalesce(F.sum("most").over(up), F.lit(0.0))).withColumn("open", F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing)))
    levels = levels.withColumn("level", F.col("rest") / F.col("open")).withColumn("fits", F.col("most") >= F.col("weight") * F.col("level"))
    level = F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("most") / F.col("weight"))).over(every)
    return levels.withColumn("target", F.least("most", F.coalesce(F.col("weight") * level, F.col("most")))).select("source", "total", "target")


def tilt(cells: DataFrame, targets: DataFrame, cap: float, scratch: Scratch) -> DataFrame:
    """(key, tilt): ``targets`` (key, total, docs, target) with the dual variable of each source's token constraint.

    Of all document rates between 0 and ``cap`` whose expected tokens meet the target, those
    nearest to 1 in relative entropy are ``min(cap, exp(tilt * size / mean size))``. Newton's method solves
    the convex dual; every step is one aggregate of ``cells`` (key, size, docs: one per source and
    size) and a bracket that shrinks each step keeps it safe. AT_ONCE steps are one job; STEPS halve the bracket to
    the precision of doubles, so an error left after them raises. A null tilt means: all rates at cap.
    """
    mean = F.col("total") / F.col("docs")
    state = targets.where("total > 0").select("key", "target", mean.alias("mean"), (F.col("target") >= cap * F.col("total") * (1 - 1e-12)).alias("full"))
    state = state.select("*", F.lit(0.0).alias("tilt"), (-60.0 * F.col("mean")).alias("low"), ((math.log(cap) + 1e-9) * F.col("mean")).alias("high"))
    state = scratch.table(state, "tilt-0")
    x = F.col("size") / F.col("mean")
    for step in range(1, STEPS + 1):
        rate = F.exp(F.col("tilt") * x)
        free = rate < cap
        sums = cells.where("size > 0").join(state.select("key", "tilt", "mean"), "key").groupBy("key").agg(
            F.sum(F.col("docs") * F.col("size") * F.least(rate, F.lit(float(cap)))).alias("got"), F.sum(F.when(free, F.col("docs") * F.col("size") * x * rate).otherwise(0.0)).alias("slope")
        )
        over = F.col("got") > F.col("target")
        new = state.join(sums, "key").withColumn("high", F.when(over, F.col("tilt")).otherwise(F.col("high"))).withColumn("low", F.when(over, F.col("low")).otherwise(F.col("tilt")))
        newton = F.col("tilt") - (F.col("got") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope"))
        error = F.when(F.col("full"), 0.0).otherwise(F.abs(F.col("got") / F.col("target") - 1))
        moved = F.when(error <= CLOSE, F.col("tilt")).when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = new.select("key", "target", "mean", "full", moved.alias("tilt"), "low", "high", error.alias("error"))
        if step % AT_ONCE:
            continue
        state = scratch.table(state, f"tilt-{step}", worst=F.max("error"))
        scratch.drop(f"tilt-{step - AT_ONCE}")
        worst = scratch.seen[f"tilt-{step}"]["worst"]
        if worst is None or worst <= CLOSE:
            break
    else:
        raise RuntimeError(f"The mix is off its targets by a share of {worst} after {STEPS} steps.")
    return state.select("key", "mean", F.when(~F.col("full"), F.col("tilt")).alias("tilt"))


def plan_copies(sized: DataFrame, weights: tuple[float, ...], cap: int, scratch: Scratch) -> DataFrame:
    """(key, size, salt, docs, copies, total, target): the copies of every cell of ``sized`` (source, key, size, salt).

    A cell holds the documents of one source, size and salt. Expected copies add up along the
    cells of a source by size, and a cell takes the whole numbers that its stretch crosses, so the
    rounding error of tokens stays about the size of one document; a few cells then gain or lose one
    copy to come closer still. Sums run in bands of sizes first, so no task takes a whole source.
    """
    cells = scratch.table(sized.groupBy("source", "key", "size", "salt").agg(F.count(F.lit(1)).alias("docs")), "cells")
    sources = cells.groupBy("source", "key").agg(F.sum(F.col("size") * F.col("docs")).alias("total"), F.sum("docs").alias("docs"))
    targets = source_targets(sources.select("source", "total"), weights, cap)
    targets = scratch.table(targets.withColumn("key", source_key(F.col("source"))).join(sources.select("key", "docs"), "key"), "targets")
    by_size = cells.groupBy("key", "size").agg(F.sum("docs").alias("docs"))
    tilts = tilt(by_size, targets, cap, scratch)
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("tilt").isNull(), float(cap)).otherwise(F.least(F.exp(F.col("tilt") * F.col("size") / F.col("mean")), F.lit(float(cap))))
    want = cells.join(tilts, "key", "left").select("key", "size", "salt", "docs", F.floor(F.col("size") / BAND).alias("band"), (F.col("docs") * rate).alias("want"))
    want = scratch.table(want, "want")
    bands = want.groupBy("key", "band").agg(F.sum("want").alias("sum"))
    bands = bands.withColumn("start", F.coalesce(F.sum("sum").over(Window.partitionBy("key").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("sum")
    end = F.col("start") + F.sum("want").over(Window.partitionBy("key", "band").orderBy("size", "salt").rowsBetween(Window.unboundedPreceding, 0))
    most = F.col("docs") * cap
    copies = F.floor(F.col("end") + 0.5) - F.floor(F.col("end") - F.col("want") + 0.5)
    taken = want.join(bands, ["key", "band"]).withColumn("end", end).select("key", "size", "salt", "docs", F.greatest(F.lit(0), F.least(copies, most)).cast("long").alias("copies"))
    taken = scratch.table(taken, "copies-0")
    for step in range(1, _FIXES + 1):
        off = taken.groupBy("key").agg(F.sum(F.col("copies") * F.col("size")).alias("got")).join(targets.select("key", "target"), "key").select("key", (F.col("target") - F.col("got")).alias("off"))
        room = (F.col("size") > 0) & F.when(F.col("off") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        left = F.abs(F.abs(F.col("off")) - F.col("size"))
        best = taken.join(off, "key").where(room & (left < F.abs(F.col("off")))).groupBy("key").agg(F.min(F.struct(left.alias("left"), "size", "salt", F.signum("off").cast("long").alias("by"))).alias("best")).select("key", "best.size", "best.salt", "best.by")
        nxt = taken.join(best, ["key", "size", "salt"], "left").select("key", "size", "salt", "docs", (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies"))
        taken = scratch.table(nxt, f"copies-{step}")
        scratch.drop(f"copies-{step - 1}")
    scratch.keep("rows", "targets", f"copies-{_FIXES}")
    return taken.join(targets.select("key", "total", "target"), "key")


def source_key(source):
    """A string of a source that is never null and sorts null last."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, copies, taken): how often each row of ``docs`` is in the mix; rows not taken have 0.

    A row's size is its words. ``source_targets`` gives every source's target. Entropy balancing
    (``tilt``) gives the rates, at most ``cap``, which ``plan_copies`` rounds. In a cell of equal
    documents those with the lowest hash of id and text take a copy more, so reruns agree. A null
    source is one of its own; null and empty texts have size 0, are taken once and weigh nothing;
    rows that repeat id and text are told apart by no rule but each has its own copies. An empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"), F.xxhash64(F.col(id_col), text).alias("luck"))
    placed, plan = _placed(scratch.table(rows, "rows"), weights, cap, scratch)
    out = _copies(placed, plan)
    return out.select(F.col("id").alias(id_col), "size", F.col("total").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix`` takes it, all columns kept. Rows that repeat id and text are told apart by their other columns."""
    scratch = Scratch(docs.sparkSession, "mixed")
    text = F.coalesce(F.col(text_col), F.lit(""))
    cols = [F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"), F.xxhash64(F.col(id_col), text).alias("luck")]
    slim = scratch.table(docs.select(F.lit(0).alias("id"), *cols), "rows")
    placed, plan = _placed(slim, weights, cap, scratch, docs.select(F.struct("*").alias("row"), *cols))
    placed = placed.withColumn("tie", F.xxhash64(F.to_json("row")))
    return _copies(placed, plan).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def _placed(rows: DataFrame, weights, cap: int, scratch: Scratch, whole: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` (or ``whole``, the same rows with more columns) with key and salt, and the plan of their cells."""
    keyed = rows.withColumn("key", source_key(F.col("source")))
    largest = keyed.groupBy("key", "size").count().agg(F.max("count")).first()[0] or 0
    salt = F.pmod("luck", F.lit(-(-largest // CELL) or 1)).cast("int")
    plan = plan_copies(keyed.withColumn("salt", salt), weights, cap, scratch)
    return (keyed if whole is None else whole.withColumn("key", source_key(F.col("source")))).withColumn("salt", salt), plan


def _copies(placed: DataFrame, plan: DataFrame) -> DataFrame:
    cell = ["key", "size", "salt"]
    joined = placed.join(plan.withColumnRenamed("copies", "of_cell"), cell)
    nth = F.row_number().over(Window.partitionBy(*cell).orderBy("luck", *[c for c in ("tie",) if c in placed.columns]))
    more = (nth <= F.col("of_cell") % F.col("docs")).cast("long")
    return joined.withColumn("copies", F.floor(F.col("of_cell") / F.col("docs")) + more)
