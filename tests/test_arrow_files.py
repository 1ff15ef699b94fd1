"""The Arrow source and sink: shares of files, pruned columns, failures that leave nothing."""

from pathlib import Path

import pyarrow as pa
import pyarrow.ipc as ipc
import pytest
from pyspark.sql import functions as F

from loomgraph.sources import scan_arrow, write_arrow
from loomgraph.sources.arrow_files import _files, _Reader


def names(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file())


def test_round_trip_and_columns(spark, tmp_path):
    df = spark.range(0, 1000, 1, 5).select("id", (F.col("id") % 7).cast("string").alias("s"), F.array("id").alias("a"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("n"))
    write_arrow(df, str(tmp_path / "t"))
    assert len(names(tmp_path / "t")) == 5
    back = scan_arrow(spark, str(tmp_path / "t"))
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(back.collect()) == sorted(df.collect())
    part = scan_arrow(spark, f"file://{tmp_path}/t", ["n", "id"])
    assert part.columns == ["n", "id"] and part.agg(F.sum("n"), F.sum("id")).first() == (sum(range(0, 1000, 3)), sum(range(1000)))
    write_arrow(df.where("id < 10"), str(tmp_path / "t"), overwrite=False)
    assert scan_arrow(spark, str(tmp_path / "t")).count() == 1010
    write_arrow(df.where("id < 10"), str(tmp_path / "t"))
    assert scan_arrow(spark, str(tmp_path / "t")).count() == 10


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    file = str(tmp_path / "one.arrow")
    with ipc.new_file(file, pa.schema([("x", pa.int64()), ("wide", pa.string()), ("u", pa.uint32())])) as writer:
        for i in range(40):
            writer.write_batch(pa.record_batch([pa.array(range(i * 10, i * 10 + 10)), pa.array(["w" * 2000] * 10), pa.array([2**32 - 1] * 10, pa.uint32())], names=["x", "wide", "u"]))
    size = _files(file)[0][1]
    shares = _Reader(file, ["x"], size // 8).partitions()
    assert len(shares) in (8, 9) and shares[0].of == len(shares)
    df = scan_arrow(spark, file, ["x", "u"], split=size // 8)
    assert df.rdd.getNumPartitions() == len(shares)
    by_task = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.max("u").alias("u")).collect()
    assert len(by_task) == len(shares) and {r["u"] for r in by_task} == {2**32 - 1} and df.agg(F.sum("x")).first()[0] == sum(range(400))
    # more shares than batches: some have none, no batch comes twice
    assert scan_arrow(spark, file, ["x"], split=100).count() == 400


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    good, path = spark.range(10), str(tmp_path / "t")
    write_arrow(good, path)
    before = names(path)
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        write_arrow(bad, path)
    assert names(path) == before and scan_arrow(spark, path).count() == 10


def test_odd_tables(spark, tmp_path):
    path = str(tmp_path / "none")
    with pytest.raises(Exception, match="no Arrow files"):
        scan_arrow(spark, path)
    write_arrow(spark.range(0).withColumn("t", F.lit("x")), path)
    back = scan_arrow(spark, path)
    assert back.count() == 0 and back.columns == ["id", "t"]
    nulls = spark.createDataFrame([(None, None), (1, "")], "a long, t string")
    write_arrow(nulls, path)
    assert sorted(map(str, scan_arrow(spark, path).collect())) == sorted(map(str, nulls.collect()))
