import pytest
from pyspark.sql import functions as F

from loomgraph.models import HashEmbedder, ScriptedChat, ServiceChat, ServiceEmbedder
from loomgraph.plans import SessionRegistry, chat_session, document_session, make_session, tool_session
from loomgraph.session import AddRows, Aggregator, FunctionProcessor, Message, MessageAggregator, Publish, RuntimeEnv, SessionBuilder, Subscribe, TaskPlan, config_of, responses
from loomgraph.streaming import similarity_stream, superstep_stream, windowed_counts
from loomgraph.subjects import Subject, visible

ROW = {"ids": 7, "title": "new"}


def batches(spark, n=3, rows=4):
    return spark.createDataFrame([(i, f"title{i}", b, i) for b in range(n) for i in range(rows)], "ids int, title string, _batch_id long, _row_id long")


def builder(spark, shared):
    subjects = ["state_1"] if shared else ["state_1", "state_2", "state_3"]
    processors = [AddRows(f"p{i}", ROW, [Publish(subjects[-1 if not shared and i == 3 else 0 if shared else i - 1])], [Subscribe(subjects[0 if shared else i - 1])]) for i in (1, 2, 3)]
    tasks = [TaskPlan(f"task_{i}", [f"p{i}"]) for i in (1, 2, 3)]
    out = AddRows("out", ROW, [], [Subscribe(s, last=True) for s in subjects])
    state = [Subject(s, batches(spark, 1, 1)) for s in subjects]
    return SessionBuilder("session_1").with_tasks([*tasks, TaskPlan("session_1", ["out"])]).with_processors([*processors, out]).with_runtime_envs([RuntimeEnv()]).with_state(state).with_max_iter(4)


def test_sequential_supersteps(spark):
    session = builder(spark, True).build(spark)
    said = session.run("state_1", batches(spark), "replace")
    assert [next(iter(x.values())).df.count() for x in said] == [6, 7, 8]
    state = session.state["state_1"]
    assert (state.count_batches(), state.count_rows()) == (768, 5376)
    assert session.metrics.output_rows() == 3 * (15 + 69 + 312 + 1392) + 6 + 7 + 8
    assert session.iter == 4 and session.metrics_info().where("task_name = 'All' and metric_name = 'output_rows'").first()["metric_value"] == session.metrics.output_rows()


def test_parallel_supersteps_and_tracker(spark, tmp_path):
    session = builder(spark, False).build(spark)
    assert session.superstep([session.message("state_1", batches(spark), "replace")]) == {}
    assert session.state["state_1"].count_batches() == 6 and session.state["state_2"].count_batches() == 1
    assert session.updated["session_1"]["state_1"] and not session.updated["task_1"]["state_1"]
    session.write_tracker(str(tmp_path / "t"))
    session.updated["session_1"]["state_1"] = False
    session.read_tracker(str(tmp_path / "t"))
    assert session.updated["session_1"]["state_1"]
    session.write_state(str(tmp_path), "a")
    before = session.get_json("state_1")
    session.state["state_1"] = Subject("state_1", batches(spark, 1, 1))
    session.read_state(str(tmp_path), "a")
    assert session.get_json("state_1") == before
    assert session.superstep() is None


def test_info_tables_and_values(spark):
    session = builder(spark, False).build(spark)
    assert session.subjects().count() == 6 and session.tasks_info().count() == 9
    session.put_csv("state_1", "ids,title\n5,x\n")
    assert session.state["state_1"].count_rows() == 2 and session.ready() == ["task_1"]
    session.put_json("state_1", '[{"ids": 6, "title": "y"}]', "replace")
    assert session.get_json("state_1") == [{"ids": 6, "title": "y"}] and session.get_csv("state_1") == "ids,title\n6,y\n"
    assert session.subject_with_schema(batches(spark)) == ["state_1", "state_2", "state_3"]
    session.put_csv("state_1", "a,b,c\n1,2,3\n", lenient=True)
    assert session.state["state_1"].count_rows() == 1
    assert config_of(spark.createDataFrame([('{"a": 1}',)], "values string")) == {"a": 1}


def test_mismatches_are_told(spark):
    with pytest.raises(ValueError, match="has no processors yet"):
        SessionBuilder("s").with_tasks([]).build(spark)
    b = builder(spark, True)
    b.processors = b.processors[1:]
    with pytest.raises(ValueError, match=r"processors of session session_1 .* missing \['p1'\]"):
        b.build(spark)
    b = builder(spark, True).with_runtime_envs([RuntimeEnv("x")])
    with pytest.raises(ValueError, match=r"runtime environments .* not used \['x'\]"):
        b.build(spark)
    b = builder(spark, True).with_state([])
    with pytest.raises(ValueError, match="subjects"):
        b.build(spark)


def test_a_failed_task_stops_the_others(spark):
    import time

    def fails(**tables):
        raise ValueError("no")

    def waits(state):
        slow = F.udf(lambda x: time.sleep(20) or x, "int")
        return {"other": visible(state).limit(1).withColumn("ids", slow("ids"))}

    steps = [FunctionProcessor("a", fails, [Publish("other")], [Subscribe("state")]), FunctionProcessor("b", waits, [Publish("other")], [Subscribe("state")])]
    state = [Subject(n, batches(spark, 1, 1)) for n in ("state", "other")]
    session = SessionBuilder("s").with_tasks([TaskPlan("a", ["a"]), TaskPlan("b", ["b"])]).with_processors(steps).with_runtime_envs([RuntimeEnv()]).with_state(state).build(spark)
    start = time.time()
    with pytest.raises(ValueError, match="no"):
        session.run("state", batches(spark), "replace")
    assert time.time() - start < 18 and session.state["other"].count_rows() == 1


def test_extend_writes_new_rows_only(spark):
    one = Subject("t", batches(spark))
    for n in range(1, 4):
        one = Publish("t").apply(one, batches(spark, 1, 2))
        assert len(one.paths) == n + 1 and one.count_rows() == 12 + 2 * n and one.count_batches() == 3 + n


def test_chat(spark):
    session = chat_session(spark)
    said = session.run("messages", spark.createDataFrame([("user", "hello you", "t")], "role string, content string, timestamp string"))
    assert [visible(m.df).first()["content"] for x in said for m in x.values()] == ["hello you"]
    assert session.state["messages"].count_rows() == 2


def test_documents(spark):
    docs = [(name, f"{name.lower()} " * 5 + "filler words here " * 150) for name in ("Proteins", "DNA", "Lipids", "Cells")]
    session = document_session(spark, embedder=HashEmbedder(64), k=3)
    session.superstep([session.message("documents", spark.createDataFrame(docs, "document_id string, text string"))])
    assert session.state["chunks"].count_rows() == session.state["doc_embeddings"].count_rows() == sum(-(-(len(t) - 64) // 448) for _, t in docs)
    said = session.run("queries", spark.createDataFrame([("q", "dna dna")], "query_id string, text string"))
    assert session.state["top_k"].count_rows() == 1 and "dna" in session.get_json("top_k")[0]["content"]
    assert "dna dna" in visible(next(iter(said[-1].values())).df).first()["content"]


def test_tools(spark):
    scores = Subject("scores", spark.createDataFrame([("0", 1.0), ("1", 3.0), ("2", 2.0)], "lhs_pk string, score float"))
    call = '<tool_call>\n{"name": "sort-scores-and-indices", "arguments": {"lhs_name": "scores", "lhs_pk": "lhs_pk", "lhs_values": "score"}}\n</tool_call>'

    class Once:
        def reply(self, prompt):
            yield "done" if "<|im_start|>tool" in prompt else call

    session = tool_session(spark, [scores], model=Once())
    said = session.run("messages", spark.createDataFrame([("user", "sort", "t")], "role string, content string, timestamp string"))
    assert [visible(m.df).first()["content"] for x in said for m in x.values()] == ["done"]
    assert '"lhs_pk":"1"' in session.get_json("messages")[-1]["content"].split("}")[0]
    assert next(iter(ScriptedChat(["a"]).reply(""))) == "a"


def test_registry_and_services(spark, tmp_path):
    registry = SessionRegistry(spark, str(tmp_path))
    session = registry.session("me@x", "Chat")
    session.put_json("messages", '[{"role": "user", "content": "a", "timestamp": "t"}]')
    registry.write("me@x", "Chat")
    assert SessionRegistry(spark, str(tmp_path)).read("me@x", "Chat").get_json("messages")[0]["content"] == "a"
    with pytest.raises(ValueError):
        make_session("nothing", spark)
    assert ServiceEmbedder(lambda url, body: {"data": [{"index": 0, "embedding": [1.0]}]}, "u", "m", 1).embed(["x"]).tolist() == [[1.0]]
    assert list(ServiceChat(lambda url, body: {"choices": [{"finish_reason": "stop", "message": {"content": "hi"}}]}, "u", "m").reply("x")) == ["hi"]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("user", "hello", "t")], "role string, content string, timestamp string").write.parquet(source)
    session, said = chat_session(spark), []
    stream = spark.readStream.schema("role string, content string, timestamp string").parquet(source)
    superstep_stream(stream, session, "messages", str(tmp_path / "c"), handle=said.append).trigger(availableNow=True).start().awaitTermination()
    assert len(said) == 1 and session.state["messages"].count_rows() == 2

    vectors = str(tmp_path / "v")
    spark.createDataFrame([("r", [1.0, 0.0])], "b string, v array<double>").write.parquet(vectors)
    left = spark.createDataFrame([("l", [1.0, 0.0])], "a string, v array<double>")
    rows = spark.readStream.schema("b string, v array<double>").parquet(vectors)
    similarity_stream(left, rows, "a", "b", "v", "v").writeStream.format("memory").queryName("scores").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("scores").first()["score"] == 1.0

    events = spark.createDataFrame([(1, "a", 2.0), (5000, "a", 3.0)], "s long, k string, value double").select(F.timestamp_seconds("s").alias("ts"), "k", "value")
    assert windowed_counts(events, "ts", "k").count() == 2


def test_aggregators(spark):
    a, b = batches(spark, 1, 2), batches(spark, 2, 2)
    other = spark.createDataFrame([("user", "x", "t", 0, 0)], "role string, content string, timestamp string, _batch_id long, _row_id long")
    box = {n: Message(n, n, "p", df, Publish(n)) for n, df in (("a", a), ("b", b), ("c", other))}
    with pytest.raises(ValueError, match="differ"):
        Aggregator("x", [Publish("all")]).process(box, None, "t")
    made = Aggregator("x", [Publish("all")]).process({k: box[k] for k in "ab"}, None, "t")
    assert made["all"].df.count() == 6 and made["all"].df.select("_batch_id").distinct().count() == 3
    with pytest.raises(ValueError, match="one subject"):
        Aggregator("x").process({k: box[k] for k in "ab"}, None, "t")
    made = MessageAggregator("x", [Publish("all")]).process(box, None, "t")
    assert set(made) == {"a", "b", "all"} and made["all"].df.count() == 1
    assert set(responses({"from_s_on_a": 1, "b": 2}, "s")) == {"from_s_on_a"}


def test_command_line(spark, tmp_path, capsys):
    from loomgraph.__main__ import main

    main(["chat", "--path", str(tmp_path), "--data", '{"content": "hello there"}'])
    assert '"content": "hello there"' in capsys.readouterr().out
    main(["get_state", "--path", str(tmp_path), "--data", '{"format": "csv_str"}'])
    assert len(capsys.readouterr().out.split("hello there")) == 3
    main(["put_state", "--path", str(tmp_path), "--data", '{"subject_name": "messages", "text": "role,content,timestamp\\nuser,x,t"}'])
    main(["subjects_info", "--path", str(tmp_path)])
    assert '"num_rows": 3' in capsys.readouterr().out
    spark.createDataFrame([("a", 0.5)], "id string, score float").write.parquet(str(tmp_path / "scores"))
    tools = ["--plan", "ToolChat", "--path", str(tmp_path / "s"), "--table", f"scores={tmp_path / 'scores'}"]
    main(["chat", *tools, "--data", '{"content": "no tool"}'])
    assert "no tool" in capsys.readouterr().out
    main(["get_state", *tools, "--data", '{"subject_name": "scores"}'])
    assert '"score": 0.5' in capsys.readouterr().out


def test_stateless_operators_take_streams(spark, tmp_path):
    from loomgraph.operators import chunk_documents

    docs = spark.createDataFrame([(i, "text " * (40 * i)) for i in range(5)], "id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "d"))
    chunk_documents(stream, "id", "text", 100, 10).writeStream.format("memory").queryName("chunks").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("chunks").collect())) == sorted(map(tuple, chunk_documents(docs, "id", "text", 100, 10).collect()))


def test_stream_against_a_large_held_side(spark, tmp_path):
    """The held side may have more than 10,000 rows, and scores may be rounded doubles."""
    held = spark.range(10_001).select(F.col("id").alias("a"), F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("v"))
    path = str(tmp_path / "v")
    spark.createDataFrame([(1, [0.0, 2.0]), (2, None)], "b long, v array<double>").write.parquet(path)
    made = similarity_stream(held, spark.readStream.schema("b long, v array<double>").parquet(path), "a", "b", "v", "v", 3)
    made.writeStream.format("memory").queryName("many_scores").trigger(availableNow=True).start().awaitTermination()
    found = {(r["b"], r["score"]): r["n"] for r in spark.table("many_scores").groupBy("b", "score").agg(F.count("*").alias("n")).collect()}
    assert found == {(1, 1.0): 3334, (1, 0.707): 3334, (1, 0.447): 3333, (2, None): 10_001}
