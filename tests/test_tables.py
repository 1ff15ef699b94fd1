import pyarrow as pa
import pytest

from loomgraph import sources as io
from loomgraph.metrics import MetricsSet, aggregate_metrics
from loomgraph.session import Publish
from loomgraph.subjects import Subject, visible


def table(spark, batches=3, rows=4):
    return spark.createDataFrame([(i, f"title{i}", b, i) for b in range(batches) for i in range(rows)], "ids int, title string, _batch_id long, _row_id long")


def test_ipc_round_trips(spark, tmp_path):
    df = table(spark)
    io.write_ipc_file(df, str(tmp_path / "t.arrow"))
    for back in (io.read_ipc_file(spark, str(tmp_path / "t.arrow")), io.read_ipc_stream(spark, io.to_ipc_stream(df))):
        assert back.count() == 12 and back.select("_batch_id").distinct().count() == 3
    with pytest.raises(ValueError):
        io.to_ipc_stream(df.limit(0))


def test_ipc_files_of_a_folder(spark, tmp_path):
    df, folder = table(spark), tmp_path / "f"
    for i, batches in enumerate(([0, 1], [2])):
        io.write_ipc_file(df.where(df["_batch_id"].isin(batches)), str(folder / f"{i}.arrow"))
    back = io.read_ipc_file(spark, str(folder))
    assert sorted((r["ids"], r["title"], r["_batch_id"]) for r in back.collect()) == sorted((r["ids"], r["title"], r["_batch_id"]) for r in df.collect())
    assert back.select("_batch_id", "_row_id").distinct().count() == 12
    with pa.OSFile(str(tmp_path / "none.arrow"), "wb") as f:
        pa.ipc.new_file(f, pa.schema([("a", pa.uint8())])).close()
    with pytest.raises(ValueError):
        io.read_ipc_file(spark, str(tmp_path / "none.arrow"))


def test_unsigned_values_are_widened(spark):
    batch = pa.RecordBatch.from_arrays([pa.array([2**31], pa.uint32()), pa.array([2**64 - 1], pa.uint64())], ["a", "b"])
    assert tuple(map(int, visible(io.read_record_batches(spark, [batch])).first())) == (2**31, 2**64 - 1)


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("a,b", None), ("c", 1)], "t string, n int")
    io.write_csv(df, str(tmp_path / "c"))
    back = io.read_csv(spark, str(tmp_path / "c"), "t string, n int", quote="'", null_value="NULL")
    assert sorted(map(tuple, back.collect()), key=str) == [("a,b", None), ("c", 1)]
    assert io.read_csv_text(spark, "a,b\nx,1\ny,2\n", "a string, b int").count() == 2
    assert io.read_csv_text(spark, "a,b\nx,1\n").count() == 1
    with pytest.raises(ValueError):
        io.read_csv_text(spark, "a,b,c\nx,1,2\n", "a string, b int")
    assert io.read_csv_text(spark, "a,b,c\nx,1,2\n", "a string, b int", lenient=True).count() == 0
    held = "a,b\n\"x, y\",1\n\"two\nlines \"\"said\"\"\",2\n"
    assert [tuple(r) for r in io.read_csv_text(spark, held, "a string, b int").collect()] == [("x, y", 1), ('two\nlines "said"', 2)]
    assert io.read_csv_text(spark, '"a, b";c\n1;2\n', "`a, b` int, c int", sep=";").count() == 1
    assert io.to_csv_text(df.coalesce(1)).splitlines() == ["t,n", "'a,b',NULL", "c,1"]


def test_json(spark, tmp_path):
    df = table(spark, 1, 2)
    assert io.read_json_lines(spark, io.to_json_lines(df).encode(), "ids int, title string").count() == 2
    assert io.read_json_lines(spark, b'{"a": 1}\n').first()["a"] == 1
    assert io.read_json_lines(spark, b'{"a": 1}\n{"a": 2.5, "b": "x"}\n').dtypes == [("a", "double"), ("b", "string")]
    assert io.read_json_values(spark, '[{"a": "x", "b": 1}]', "a string, b int").first() == ("x", 1)
    for bad in ('{"a": 1}', '[{"a": "x"}]'):
        with pytest.raises(ValueError):
            io.read_json_values(spark, bad, "a string, b int")
    assert io.to_json_objects(df) == [{"ids": 0, "title": "title0"}, {"ids": 1, "title": "title1"}]
    io.write_parquet(df, str(tmp_path / "p"))
    assert io.read_parquet(spark, str(tmp_path / "p"), ["ids"]).columns == ["ids"]


def test_publications(spark):
    old, one = Subject("t", table(spark)), spark.createDataFrame([(9, "x")], "ids int, title string")
    assert Publish("t").apply(old, one).count_rows() == 13 and Publish("t").apply(old, one).count_batches() == 4
    assert Publish("t", "replace").apply(old, one).count_rows() == 1
    assert Publish("t", "none").apply(old, one).count_rows() == 12
    assert Publish("t", "replace_last").apply(old, one).count_rows() == 9
    with pytest.raises(ValueError):
        Publish("t").apply(old, one.withColumnRenamed("ids", "id"))
    pieces = spark.createDataFrame([(str(i), 0, i) for i in range(4)], "title string, _batch_id long, _row_id long")
    new = Publish("t", "extend_chunks", "title").apply(old, pieces)
    assert new.count_rows() == 13 and new.column_as_strings("title")[-1] == "0123" and new.column_as_strings("ids")[-1] == ""


def test_metrics(spark):
    m = MetricsSet()
    for task, name, value in (("a", "output_rows", 3), ("b", "output_rows", 4), ("a", "start_timestamp", 5), ("b", "start_timestamp", 2), ("b", "end_timestamp", 9), ("a", "end_timestamp", 7), ("a", "x", 1)):
        m.add(task, name, value)
    assert m.output_rows() == 7 and m.elapsed_compute() is None and m.sum_by_name("x") == 1
    assert {x.name: x.value for x in m.aggregate_by_name()} == {"output_rows": 7, "start_timestamp": 2, "end_timestamp": 9, "x": 1}
    assert [x.name for x in m.aggregate_by_name().sorted_for_display()] == ["output_rows", "x", "start_timestamp", "end_timestamp"]
    assert [x.name for x in m.aggregate_by_name().timestamps_removed().sorted_for_display()] == ["output_rows", "x"]
    assert m.info(spark).where("task_name = 'All'").first()["metric_value"] == 7
    assert {r[0]: r[1] for r in aggregate_metrics(m.info(spark).where("task_name <> 'All'")).collect()}["end_timestamp"] == 9
