"""Exact dedup: a tree merge of sorted digest runs."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot import join_groups
from .scratch import Scratch, parts_for

#: Runs that meet in one merge: 2 to the power of this.
FAN_BITS = 3
_RUN = "place long, digest binary, id long, members long"


def _merge(keep: str):
    """Collapse a sorted stream of (place, digest, id, members) to one entry per place and digest; only the open entry crosses a batch."""
    better = max if keep == "largest" else min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            place = table["place"].to_numpy()
            digest = table["digest"].combine_chunks()
            width = len(digest[0].as_py())
            raw = np.frombuffer(digest.buffers()[2], np.uint8)[digest.offset * width :][: len(digest) * width].reshape(-1, width)
            new = np.ones(len(place), bool)
            new[1:] = (place[1:] != place[:-1]) | (raw[1:] != raw[:-1]).any(axis=1)
            starts = np.flatnonzero(new)
            given = np.r_[0, np.cumsum(~table["id"].is_null().to_numpy())]
            ends = np.r_[starts[1:], len(place)]
            # ids are sorted in the order of preference with nulls last, so the first of an entry is its best
            best = table["id"].combine_chunks().take(pa.array(starts))
            members = np.add.reduceat(table["members"].to_numpy(), starts)
            assert ((given[ends] == given[starts]) | best.is_valid().to_numpy(zero_copy_only=False)).all(), "a run is out of order"
            entry = lambda i: [int(place[starts[i]]), raw[starts[i]].tobytes(), best[i].as_py(), int(members[i])]
            # the first entry may go on the one held from the batch before, and the last is held for the next; all between stay in Arrow
            first = entry(0)
            if held and held[:2] == first[:2]:
                ids = [x for x in (held[2], first[2]) if x is not None]
                first[2:] = [better(ids, default=None), held[3] + first[3]]
            elif held:
                yield _batch([held])
            if len(starts) == 1:
                held = first
                continue
            yield _batch([first])
            if len(starts) > 2:
                at = pa.array(starts[1:-1])
                yield pa.RecordBatch.from_arrays([pa.array(place[starts[1:-1]]), digest.take(at), best.slice(1, len(starts) - 2), pa.array(members[1:-1])], ["place", "digest", "id", "members"])
            held = entry(len(starts) - 1)
        if held:
            yield _batch([held])

    return run


def _batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["place", "digest", "id", "members"])


def text_digest(text: str):
    """48 bytes of a text (null: empty): its SHA-256, its length in bytes and its XXH64. The last two verify the first."""
    value = F.coalesce(F.col(text), F.lit(""))
    long = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0"))
    return F.concat(F.unhex(F.sha2(value, 256)), long(F.octet_length(value).cast("long")), long(F.xxhash64(value)))


def merge_tree(digests: DataFrame, scratch: Scratch, keep: str = "largest", fan_bits: int = FAN_BITS) -> DataFrame:
    """(digest, keep_id, group_size) of every digest in ``digests`` (id, digest).

    Every partition sorts its entries into a run and collapses equal digests. Then binomial
    rounds follow: in round r the runs whose places differ only in the r-th group of bits
    exchange entries, each taking those whose digest has its bits there, and merge what they
    got. After the last round a place holds all entries of its digests. A digest is collapsed
    before each exchange, so a hot one sends a place at most ``2 ** fan_bits`` entries.
    Rounds are ``log(places) / fan_bits``, and each moves at most one entry per run and digest.
    The runs that a place gets are merged by Spark's sort, which spills, and collapsed as they stream by.
    """
    count = parts_for(digests)
    bits = max(1, (count - 1).bit_length())
    better = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    merge = _merge(keep)
    runs = digests.select(F.pmod(F.spark_partition_id(), F.lit(1 << bits)).cast("long").alias("place"), "digest", F.col("id").cast("long").alias("id"), F.lit(1).cast("long").alias("members"))
    runs = runs.sortWithinPartitions("place", "digest", better).mapInArrow(merge, _RUN)
    lead = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    for low in range(0, bits, fan_bits):
        mask = ((1 << min(fan_bits, bits - low)) - 1) << low
        place = F.col("place").bitwiseAND(F.lit(~mask)).bitwiseOR(lead.bitwiseAND(F.lit(mask)))
        runs = runs.withColumn("place", place).withColumn("to", place.cast("int")).repartitionById(1 << bits, "to").drop("to")
        runs = runs.sortWithinPartitions("place", "digest", better).mapInArrow(merge, _RUN)
    return scratch.table(runs.select("digest", F.col("id").alias("keep_id"), F.col("members").alias("group_size")), "merged")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256): a row per row of ``docs``, dropped ones too.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the
    largest id stays (``keep="smallest"``: the smallest). Null ids lose to any other; a group
    with null ids only keeps them (keep_id null, kept true). Rows that repeat id and text are
    one document twice: they share its verdict, and all count in group_size. No rows give none;
    other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    digests = scratch.table(docs.select(F.col(id_col).cast("long").alias("id"), text_digest(text_col).alias("digest")), "digests")
    merged = merge_tree(digests, scratch, keep)
    out = join_groups(digests, merged, "digest", "group_size")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``docs`` with one row of each distinct text, that with the best id; all columns stay.

    Rows that repeat id and text become one.
    """
    scratch = Scratch(docs.sparkSession, "drop-copies")
    digests = docs.select(F.col(id_col).cast("long").alias("id"), text_digest(text_col).alias("digest"))
    merged = merge_tree(digests, scratch, keep)
    losers = merged.where("group_size > 1").select("digest", "keep_id", "group_size")
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), text_digest(text_col).alias("digest"))
    joined = join_groups(whole, scratch.table(losers, "repeated"), "digest", "group_size", "left")
    single = joined.where("group_size is null").select("row.*")
    among = joined.where("group_size is not null and id <=> keep_id").groupBy("digest").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(among)
