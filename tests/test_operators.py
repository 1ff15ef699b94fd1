import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph import functions as fn
from loomgraph import operators as op
from loomgraph.subjects import assign_batches, concat_batches, first_row, last_batch, visible, with_batches


def vectors(spark, name, values):
    return spark.createDataFrame([(str(i + 1), [float(x) for x in v]) for i, v in enumerate(values)], f"{name} string, embeddings array<float>")


def test_similarity_of_all_pairs(spark):
    lhs, rhs = vectors(spark, "lhs_pk", [[1, 1, 1, 1], [0, 1, 0, 1], [0, 0, 0, 1]]), vectors(spark, "rhs_pk", [[1, 1, 1, 1]] * 4)
    found = {(r[0], r[1]): r[2] for r in op.similarity_scores(lhs, rhs, "lhs_pk", "rhs_pk", "embeddings", "embeddings").collect()}
    assert len(found) == 12
    assert all(found[k, str(j)] == pytest.approx(v, rel=1e-6) for k, v in (("1", 1.0), ("2", 0.70710677), ("3", 0.5)) for j in range(1, 5))


def test_similarity_of_a_zero_vector_is_nan(spark):
    lhs, rhs = vectors(spark, "a", [[0, 0]]), vectors(spark, "b", [[1, 0]])
    assert math.isnan(op.similarity_scores(lhs, rhs, "a", "b", "embeddings", "embeddings").first()["score"])


def test_top_k_similar_is_the_head_of_all_scores(spark):
    lhs, rhs = vectors(spark, "id", [[1, 0], [1, 1]]), vectors(spark, "id", [[i, 7 - i] for i in range(1, 7)])
    best = {(r["id"], r["rank"]): r["id_rhs"] for r in op.top_k_similar(lhs, rhs, 2, "id", "id", "embeddings", "embeddings").collect()}
    assert best == {("1", 1): "6", ("1", 2): "5", ("2", 1): "3", ("2", 2): "4"}
    assert op.top_k_similar(lhs.limit(0), rhs, 2, "id", "id", "embeddings", "embeddings").count() == 0


def test_sort_scores(spark):
    df = spark.createDataFrame([("0", 1.0, 1), ("1", 0.0, 2), ("2", 3.0, 3), ("3", 2.0, 4)], "lhs_pk string, score float, metadata int")
    assert [tuple(r) for r in op.sort_scores(df, "score", "lhs_pk", ascending=True).collect()] == [("1", 0.0, 2), ("0", 1.0, 1), ("3", 2.0, 4), ("2", 3.0, 3)]
    assert [r[0] for r in op.sort_scores(df, "score").collect()] == ["2", "3", "0", "1"]


def test_chunks(spark):
    texts = ["01234597890123456789", "0123459789"]
    df = spark.createDataFrame([(str(i), texts[i % 2], i) for i in range(4)], "lhs_pk string, text string, metadata int")
    found = op.chunk_documents(df, "lhs_pk", "text", 10, 2).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in found] == ["0_0", "0_1", "0_2", "1_0", "2_0", "2_1", "2_2", "3_0"]
    assert [r["text"] for r in found[:4]] == [texts[0][:10], texts[0][8:18], texts[0][16:], texts[1]]
    with pytest.raises(ValueError):
        op.chunk_documents(df, "lhs_pk", "text", 10, 10)


@settings(max_examples=8, deadline=None)
@given(st.text(max_size=60), st.integers(2, 9))
def test_chunks_join_to_the_text(spark, text, size):
    text = text.replace("\x00", "").encode("utf-8", "ignore").decode()
    df = spark.createDataFrame([("a", text)], "id string, text string")
    found = [r["text"] for r in op.chunk_documents(df, "id", "text", size, 1).withColumn("n", F.split_part("chunk_id", F.lit("_"), F.lit(-1)).cast("int")).orderBy("n").collect()]
    assert found[0] + "".join(x[1:] for x in found[1:]) == text


def test_join_inner(spark, rows):
    lhs = spark.createDataFrame([(str(i), f"t{i}", i + 1) for i in range(4)], "lhs_pk string, lhs_text string, lhs_metadata int")
    rhs = spark.createDataFrame([("0", "a", 8), ("2", "b", 9), ("2", "c", 9)], "rhs_pk string, rhs_text string, rhs_metadata int")
    assert rows(op.join_inner(lhs, rhs, "lhs_pk", "rhs_pk"), "lhs_pk", "rhs_pk", "lhs_metadata", "rhs_metadata") == [("0", "0", 1, 8), ("2", "2", 3, 9), ("2", "2", 3, 9)]


def test_join_nulls_and_clashing_names(spark, rows):
    lhs = spark.createDataFrame([(None, 1), ("", None)], "k string, v int")
    rhs = spark.createDataFrame([(None, 2)], "k string, v int")
    assert op.join_inner(lhs, rhs, "k", "k").count() == 0
    assert rows(op.join_inner(lhs, rhs, "k", "k", null_mode="default")) == [("", 0, 2), ("", 1, 2)]


def test_limits_and_unions(spark):
    df = spark.range(10).orderBy("id")
    assert [r[0] for r in op.limit_offset(df, 3, 4).collect()] == [3, 4, 5, 6]
    assert op.union_tables([df, df]).count() == 20
    with pytest.raises(ValueError):
        op.union_tables([df, df.withColumnRenamed("id", "x")])
    assert [r[0] for r in op.top_k(spark.createDataFrame([(1, 2.0), (2, 5.0), (3, 5.0)], "id int, s double"), "s", 2, tie="id").collect()] == [2, 3]


def test_filters_and_nulls(spark, rows):
    df = spark.createDataFrame([(1, "ab"), (None, "bc"), (3, "c")], "a int, t string")
    assert op.null_counts(df).first() == (1, 0)
    assert op.filter_contains(df, "t", "b").count() == 2 and op.filter_equal(df, "a", 3).count() == 1 and op.filter_in(df, a=[1, 3], t=["c"]).count() == 1
    with pytest.raises(Exception, match="declared not null"):
        op.assert_not_null(df, ["a"]).collect()
    assert op.assert_not_null(df.where("a is not null"), ["a"]).count() == 2
    assert op.project(df, ["t", "nothing"]).columns == ["t"]
    assert op.fields_in_schemas(df, spark.createDataFrame([(1,)], "a int")) == ["a"]
    assert [r[0] for r in op.distinct_sorted(df.union(df), "t").collect()] == ["ab", "bc", "c"]


def batches(spark, sizes):
    return spark.createDataFrame([(b * 100 + i, b, i) for b, n in enumerate(sizes) for i in range(n)], "c0 long, _batch_id long, _row_id long")


@pytest.mark.parametrize(("fetch", "wanted"), [(None, [24, 24, 24, 8]), (50, [24, 24, 2]), (10, [10])])
def test_coalesced_batches(spark, fetch, wanted):
    out = assign_batches(batches(spark, [8] * 10), 21, fetch)
    assert [r["count"] for r in out.groupBy("_batch_id").count().orderBy("_batch_id").collect()] == wanted


def test_batches_of_a_table(spark):
    df = batches(spark, [2, 3])
    assert last_batch(df).count() == 3 and first_row(df).first()["c0"] == 0
    assert concat_batches(df).select("_batch_id").distinct().count() == 1


def test_summary(spark):
    df = spark.createDataFrame([(str(i), [float(i)], i) for i in range(1, 4)], "lhs_pk string, embeddings array<float>, n int")
    one = op.summarize(df, ["lhs_pk", "embeddings"], 2, order=["n"])
    assert one.count() == 1 and one.first()["role"] == "tool"
    assert json.loads(one.first()["content"]) == [{"embeddings": [1.0], "lhs_pk": "1"}, {"embeddings": [2.0], "lhs_pk": "2"}]
    assert [x["lhs_pk"] for x in json.loads(op.summarize(df, ["lhs_pk"], 2, True, ["n"]).first()["content"])] == ["1", "3"]


def test_tool_calls_of_local_models(spark):
    pieces = ['\n<tool_call>\n{"name": "get_current_', 'weather", "arguments": {"location": "San Francisco, CA", "format": "celsius"}}, {"name":', '"get_weather", "arguments": {"location": "Santa Ana, CA", "time": "08:00"}}\n</tool_call><|im_end|>\n']
    df = spark.createDataFrame([("assistant", x, i) for i, x in enumerate(pieces)], "role string, content string, n int")
    found = op.parse_tool_calls(df, ["n"]).orderBy("_row_id").collect()
    assert [r["name"] for r in found] == ["get_current_weather", "get_weather"] and {r["publisher"] for r in found} == {"message_parser_processor"}
    assert [r["values"] for r in found] == ['{"arguments":{"format":"celsius","location":"San Francisco, CA"},"name":"get_current_weather"}', '{"arguments":{"location":"Santa Ana, CA","time":"08:00"},"name":"get_weather"}']


def test_tool_calls_of_services_and_plain_text(spark):
    call = json.dumps([{"id": "1", "type": "function", "function": {"name": "f", "arguments": '{"b": 1, "a": "x"}'}}])
    df = spark.createDataFrame([("assistant", call, 0)], "role string, content string, n int")
    assert [(r["name"], r["values"]) for r in op.parse_tool_calls(df, ["n"]).collect()] == [("f", '{"arguments":{"a":"x","b":1},"name":"f"}')]
    plain = op.parse_tool_calls(spark.createDataFrame([("assistant", "hello", 0)], "role string, content string, n int"), ["n"]).collect()
    assert [(r["name"], r["values"]) for r in plain] == [(None, "hello")]
    tagged = '{"name":"f","parameters":{}}<|python_tag|>{"name":"g","parameters":{"x":1}}'
    assert [r["name"] for r in op.parse_tool_calls(spark.createDataFrame([("assistant", tagged, 0)], "role string, content string, n int"), ["n"]).collect()] == ["f", "g"]


def test_routes(spark, rows):
    df = spark.createDataFrame([("n1", "s1", "d1", "{}"), ("n2", "s2", "d2", "{}"), ("n2", "s2", "d3", "{}")], "name string, publisher string, subject string, values string").coalesce(1)
    assert rows(op.route_messages(df), "name", "subject") == [("from_s1_on_d1", "d1"), ("from_s2_on_d3", "d3")]


def test_extend_chunks_and_prompts(spark):
    df = spark.createDataFrame([("assistant", str(i), "t", i) for i in range(4)], "role string, content string, timestamp string, n int")
    one = op.extend_chunks(df, "content", ["n"]).collect()
    assert [(r["role"], r["content"]) for r in one] == [("assistant", "0123")]
    assert op.prompt(df.limit(1), ["n"], generate=True).first()[0] == "<|im_start|>assistant\n0<|im_end|>\n<|im_start|>assistant\n"
    query = spark.createDataFrame([("why?",)], "content string")
    assert [r["role"] for r in op.prepare_messages(None, query).collect()] == ["system", "user"]
    assert op.extend_chunks(df.limit(0), "content", ["n"]).count() == 0


def test_no_turn_is_lost_and_order_is_kept(spark):
    turns = spark.createDataFrame([(1, 3, "user", None), (1, 1, None, "b"), (1, 2, "assistant", "c"), (1, 0, "system", "a"), (2, 0, "user", "z")], "k int, n int, role string, content string").repartition(4)
    made = {r["k"]: r["prompt"] for r in op.prompt(turns, ["n"], ["k"]).collect()}
    assert made[1] == "<|im_start|>system\na<|im_end|>\n<|im_start|>user\nb<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    asked = spark.createDataFrame([(1, "q2", 0, 2), (1, None, 0, 1), (3, "q", 0, 0)], "k int, content string, _batch_id long, _row_id long").repartition(3)
    got = [tuple(r) for r in op.prepare_messages(turns, asked, order=["n"], keys=["k"]).collect()]
    assert got == [(1, 0, "system", "a"), (1, 1, None, "b"), (1, 2, "assistant", "c"), (1, 3, "user", None), (1, 4, "user", None), (1, 5, "user", "q2"), (3, 0, "user", "q")]
    assert [tuple(r) for r in op.prepare_messages(None, asked, "x{k}", keys=["k"], k=F.col("k").cast("string")).where("turn = 0").collect()] == [(1, 0, "system", "x1"), (3, 0, "system", "x3")]


def test_roles_and_text_functions(spark):
    df = spark.createDataFrame([(x,) for x in ("system", "user", "assistant", "tool_call", "function", "tool", "?")], "r string").coalesce(1)
    assert [r[0] for r in df.select(fn.message_role(F.col("r"))).collect()] == ["system", "user", "assistant", "tool", "function", "function", "user"]
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(fn.between_markers(F.lit("a<tool_call>\nx\n</tool_call>b"))) == "x"
    assert pick(fn.wrap_list(F.lit("{1}"))) == "[{1}]" and pick(fn.render_template("a {x} b", x=F.lit("q"))) == "a q b"
    assert pick(fn.human_size(F.lit(1500))) == "1.50KB" and pick(fn.human_size(F.lit(15))) == "15B"
    assert pick(fn.keep_last(F.array(*map(F.lit, range(5))), 2)) == [3, 4]
    assert len(pick(fn.timestamp_now())) == 24


def test_registry(spark):
    schema = json.loads(op.tool_schema("sort-scores-and-indices"))
    assert schema["function"]["parameters"]["required"] == ["lhs_name", "lhs_pk", "lhs_values"] and op.tool_schema("nothing") is None
    assert op.tool_catalog(spark, ["join-inner", "nothing"]).count() == 1 and op.tool_catalog(spark, ["nothing"]) is None
    config = op.OperatorConfig.from_tool_call('{"name": "human-in-the-loop", "arguments": {"lhs_args": "{\\"role\\": \\"assistant\\", \\"content\\": \\"RESPONSE\\"}"}}')
    assert tuple(visible(op.dispatch(config, None, None, spark)).first()) == ("assistant", "RESPONSE")
    with pytest.raises(ValueError):
        op.dispatch(op.OperatorConfig(which="sort-scores-and-indices", lhs_values="none"), with_batches(spark.range(1)))


def test_top_k_in_blocks(spark, rows, monkeypatch):
    """A query set of more rows than are broadcast at a time gives what one block gives."""
    from loomgraph.operators import similarity

    table = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "id long, v array<double>")
    queries = table.where("id < 11").withColumnsRenamed({"id": "query"})
    whole = rows(similarity.top_k_similar(queries, table, 3, "query", "id", "v", "v"))
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", 4)
    assert len(whole) == 33 and rows(similarity.top_k_similar(queries, table, 3, "query", "id", "v", "v")) == whole


def test_hash_embedder_hashes_a_word_once(monkeypatch):
    from loomgraph import models

    seen = []
    plain = models.hashlib.blake2b
    monkeypatch.setattr(models.hashlib, "blake2b", lambda word, **k: seen.append(word) or plain(word, **k))
    given = ["a b A", "", None, "Été b\tb c", "a"]
    got = models.HashEmbedder(16).embed(given)
    assert len(seen) == len(set(seen)) == 4
    want = np.zeros((5, 16))
    for row, text in zip(want, given, strict=True):
        for word in (text or "").lower().split():
            h = int.from_bytes(plain(word.encode(), digest_size=8).digest(), "little")
            row[h % 16] += 1 - 2 * (h >> 63)
    assert (got == want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)).all()
    assert models.HashEmbedder(16).embed([]).shape == (0, 16)


def test_vectors_without_direction_are_left_out_of_blocks(spark):
    from loomgraph.operators.similarity import _directed, has_direction

    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, inf]), (5, [None, 1.0]), (6, []), (7, [3.0]), (8, [-1e-30, 0.0])]
    df = spark.createDataFrame(rows, "k long, v array<float>").coalesce(1)
    want = [r["k"] for r in df.where(has_direction(F.col("v"))).collect()]
    batch = df.toArrow().combine_chunks().to_batches()[0]
    assert _directed(batch).column(0).to_pylist() == want == [0, 7, 8]
    assert _directed(batch.slice(1, 7)).column(0).to_pylist() == [7]


def test_a_stored_message_that_replaces_is_not_written_again(spark, monkeypatch):
    from loomgraph import session, subjects

    seen = []
    plain = subjects.store
    count = lambda df, path=None, *a: seen.append(path) or plain(df, path, *a)
    monkeypatch.setattr(subjects, "store", count)
    old = subjects.Subject("s", spark.createDataFrame([(1, "a")], "n int, t string"))
    new = subjects.with_batches(spark.createDataFrame([(2, "b"), (3, "c")], "n int, t string"))
    path = subjects.state_path(spark)
    df, _ = plain(new, path)
    got = session.Publish("s", "replace").apply(old, df, path)
    assert not seen and got.paths == (path,) and sorted(r["n"] for r in got.data.collect()) == [2, 3]
    more = session.Publish("s").apply(got, new)
    assert len(seen) == 1 and more.count_rows() == 4 and more.count_batches() == 2


@pytest.mark.parametrize("ranked", [1 << 21, 40, 7])
def test_places_of_pairs_against_an_order(spark, monkeypatch, ranked):
    from loomgraph.operators import similarity

    monkeypatch.setattr(similarity, "RANKED", ranked)
    monkeypatch.setattr(similarity, "LEFT", 4)
    monkeypatch.setattr(similarity, "RIGHT", 16)
    rng = np.random.default_rng(5)
    # a large group of equal vectors, so one score has very many pairs, opposite ones, and some without direction
    values = [[1.0, 2.0, 2.0]] * 40 + [[-1.0, -2.0, -2.0]] * 3 + rng.normal(size=(30, 3)).tolist() + [[0.0, 0.0, 0.0], None]
    df = spark.createDataFrame([(i * 7 % 1000, v) for i, v in enumerate(values)], "n long, v array<float>").repartition(3)
    pairs = op.score_pairs(df.where("n % 2 = 0"), df, "n", "n", "v", "v").collect()
    want = sorted(((-r["score"], r["n"] * 1000 + r["n_rhs"]), r["n"], r["n_rhs"], r["score"]) for r in pairs)
    got = sorted((r["place"], r["n"], r["n_rhs"], r["score"]) for r in op.rank_pairs(df.where("n % 2 = 0"), df, "n", "n", "v", "v", 1000).collect())
    assert got == [(i, *r[1:]) for i, r in enumerate(want)] and len(got) > 2000
    assert op.rank_pairs(df.limit(0), df, "n", "n", "v", "v").count() == 0


def test_ranked_pairs_are_exchanged_once_and_packed(spark):
    df = spark.range(3000).select(F.col("id").alias("n"), F.array(*[F.rand(i) - 0.5 for i in range(8)]).cast("array<float>").alias("v"))
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: (lambda it: [it.apply(i) for i in range(it.size())])(store.stageList(None, False, False, none, None))
    before = {s.stageId() for s in stages()}
    op.rank_pairs(df.where("n % 50 = 0"), df, "n", "n", "v", "v").write.format("noop").mode("overwrite").save()
    moved = sum(s.shuffleWriteBytes() + s.outputBytes() for s in stages() if s.stageId() not in before)
    assert moved < 9 * 3000 * 60 + 2_000_000


def test_all_scores_come_from_blocks_and_round_once(spark, rows, monkeypatch):
    """Scores of odd vectors are those of the column function, no interpreted function runs on a pair, and doubles are rounded once, not after a cast to float."""
    from loomgraph.functions.vectors import cosine
    from loomgraph.operators import similarity

    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [3.0, 4.0], [-4.0, 3.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0], [1.0, 2.0, 2.0], [3.0, 4.0]]
    df = spark.createDataFrame(list(enumerate(odd)), "n long, v array<double>").repartition(3)
    want = df.select("n", "v").crossJoin(df.select(F.col("n").alias("m"), F.col("v").alias("w"))).select("n", "m", cosine(F.col("v"), F.col("w")).cast("float").alias("s"))
    plain = lambda found: [tuple(str(x) for x in r) for r in found]
    right = df.withColumnRenamed("n", "m")
    for size in (similarity.LEFT, 2):
        monkeypatch.setattr(similarity, "LEFT", size)
        monkeypatch.setattr(similarity, "WAVE_BYTES", size * 16)
        scores = op.similarity_scores(df, right, "n", "m", "v", "v")
        assert plain(rows(scores)) == plain(rows(want)) and dict(scores.dtypes)["score"] == "float"
    assert "zip_with" not in scores._jdf.queryExecution().toString() and "lambda" not in scores._jdf.queryExecution().toString()
    below = 0.1235 - 1e-9
    pair = spark.createDataFrame([(1, [1.0, 0.0]), (2, [below, math.sqrt(1 - below * below)]), (3, [-1.0, 0.0])], "n long, v array<double>")
    got = {r["m"]: r["score"] for r in op.similarity_scores(pair.where("n = 1"), pair.withColumnRenamed("n", "m"), "n", "m", "v", "v", 3).collect()}
    assert got == {1: 1.0, 2: 0.123, 3: -1.0}
    assert similarity._rounded(np.array([0.0625, -0.0625, -0.0001, 0.4999, nan]), 3).astype(str).tolist() == ["0.063", "-0.063", "0.0", "0.5", "nan"]
