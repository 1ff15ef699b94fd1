"""Queries of scans, sinks, subjects, publications, sessions, models and metrics."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as op
from . import sources as io
from .functions import dot, human_size, keep_last, norm, render_template, timestamp_text, unit
from .metrics import aggregate_metrics, displayed_metrics, metric_info, sum_metrics, without_timestamps
from .models import EchoChat, ServiceChat, ServiceEmbedder, TableChat, answer, embed_texts
from .plans import SessionRegistry, chat_session, document_session, make_session, tool_session
from .query_base import example, query, table
from .session import ALWAYS, AddRows, Aggregator, Echo, FunctionProcessor, Message, MessageAggregator, Publish, RuntimeEnv, Session, SessionBuilder, Subscribe, Summary, TaskPlan, config_of, responses
from .storage import state_path
from .subjects import BATCH, ROW, Subject, assign_batches, concat_batches, first_row, numbered, replace_first_value, same_schema, visible

_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
_NAMES = "SELECT n_nationkey::INT AS ids, n_name AS title FROM nation"


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as (ids, title), a batch per region."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("ids"), F.col("n_name").alias("title"), F.col("n_regionkey").cast("long").alias(BATCH), F.col("n_nationkey").cast("long").alias(ROW))


def _one(spark: SparkSession, value, name: str, kind: str = "string") -> DataFrame:
    return spark.createDataFrame([(value,)], f"{name} {kind}")


# scans and sinks


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def ipc_file(spark, sf_dir):
    path = state_path(spark)
    io.write_arrow(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path)
    return io.scan_arrow(spark, path)


@query("SELECT ids, title, batch FROM (SELECT n_nationkey::INT AS ids, n_name AS title, dense_rank() OVER (ORDER BY n_regionkey) - 1 AS batch FROM nation)")
def ipc_stream(spark, sf_dir):
    """Batches stay batches."""
    return io.read_ipc_stream(spark, io.to_ipc_stream(_batched(spark, sf_dir))).select("ids", "title", F.col(BATCH).alias("batch"))


@query(_NATION)
def csv_text(spark, sf_dir):
    nation = _nation(spark, sf_dir)
    return io.read_csv_text(spark, io.to_csv_text(nation, quote='"', null_value=""), nation.schema)


@query(_NATION)
def json_lines_file(spark, sf_dir):
    nation, path = _nation(spark, sf_dir), state_path(spark)
    nation.write.json(path)
    return io.read_json_lines(spark, path, nation.schema)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def json_lines_bytes(spark, sf_dir):
    """The schema is inferred from all lines."""
    return io.read_json_lines(spark, io.to_json_lines(_nation(spark, sf_dir).select("n_nationkey", "n_name")).encode())


@query(_NATION)
def json_array(spark, sf_dir):
    nation = _nation(spark, sf_dir)
    return io.read_json_values(spark, io.to_json_bytes(nation).decode(), nation.schema)


@query("SELECT 'n' || n_nationkey AS k, n_regionkey::BIGINT AS v FROM nation")
def json_objects(spark, sf_dir):
    found = io.to_json_objects(_nation(spark, sf_dir))
    return io.read_json_values(spark, [{"k": f"n{x['n_nationkey']}", "v": x["n_regionkey"]} for x in found], "k string, v long")


@query("SELECT r_regionkey::BIGINT AS a, 2 AS batches FROM region")
def record_batches(spark, sf_dir):
    keys = [r[0] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_regionkey").collect()]
    df = io.read_record_batches(spark, [pa.RecordBatch.from_arrays([pa.array(x, pa.uint32())], ["a"]) for x in (keys[:2], keys[2:])])
    return visible(df).withColumn("batches", F.lit(df.select(BATCH).distinct().count()))


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY l_returnflag")
def parquet_scan(spark, sf_dir):
    rows = io.read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_returnflag", "l_quantity"])
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@example("SELECT * FROM (VALUES ('a', 1.0::DOUBLE), ('b', 2.5), ('c', NULL)) t(k, v)")
def inline_literals(spark, sf_dir):
    """A tool call's own rows; a column's type is that of all its values."""
    config = op.OperatorConfig(which="human-in-the-loop", lhs_args='[{"k": "a", "v": 1}, {"k": "b", "v": 2.5}, {"k": "c"}]')
    return visible(op.dispatch(config, None, None, spark))


# subjects, batches and rows


@query("SELECT n_nationkey::VARCHAR AS value FROM nation")
def column_as_strings(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in Subject("n", _batched(spark, sf_dir)).column_as_strings("ids")], "value string")


@query("SELECT c AS name FROM (VALUES ('vec_id'), ('label')) t(c)")
def type_projection(spark, sf_dir):
    """Columns of the supported types: of the embeddings all but the vectors."""
    return spark.createDataFrame([(c,) for c in op.columns_of_types(table(spark, sf_dir, "embeddings"))], "name string")


@query("SELECT min(n_nationkey)::INT AS ids, 'new' AS title FROM nation WHERE n_regionkey = (SELECT min(n_regionkey) FROM nation)")
def first_row_value(spark, sf_dir):
    return visible(replace_first_value(_batched(spark, sf_dir), "title", F.lit("new")))


@query("SELECT arg_min(n_nationkey, (n_regionkey, n_nationkey))::INT AS ids, arg_min(n_name, (n_regionkey, n_nationkey)) AS title FROM nation")
def first_row_of_subject(spark, sf_dir):
    return visible(first_row(_batched(spark, sf_dir)))


@query("SELECT count(*) AS rows, count(DISTINCT n_regionkey) AS batches FROM nation")
def subject_counts(spark, sf_dir):
    s = Subject("n", _batched(spark, sf_dir))
    return spark.createDataFrame([(s.count_rows(), s.count_batches())], "rows long, batches long")


@query("SELECT row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS place, n_name AS title, 0::BIGINT AS batch FROM nation")
def concat_to_one_batch(spark, sf_dir):
    one = concat_batches(_batched(spark, sf_dir))
    return numbered(one.orderBy(ROW), "place").select("place", "title", F.col(BATCH).alias("batch"))


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 300 AS batch FROM events QUALIFY row_number() OVER (ORDER BY event_id) <= 1000")
def coalesce_with_fetch(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 100").alias(BATCH), F.col("event_id").alias(ROW))
    return assign_batches(events, 300, 1000).select("event_id", F.col(BATCH).alias("batch"))


@query("SELECT n_regionkey::BIGINT AS part, n_nationkey::BIGINT AS n_nationkey FROM nation")
def ordered_partitions(spark, sf_dir):
    """Partitions in order, each as a list."""
    dealt = _nation(spark, sf_dir).select("n_nationkey", F.col("n_regionkey").cast("int").alias("to")).repartitionById(5, "to")
    return spark.createDataFrame([(i, k) for i, rows in enumerate(op.collect_partitions(dealt)) for k, _ in rows], "part long, n_nationkey long")


@query("SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE turn = 0")
def merge_streams(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return op.union_tables([rows, op.filter_equal(rows, "role", "user"), op.filter_equal(rows, "turn", 0)])


@query("SELECT event_id, place FROM (SELECT event_id, row_number() OVER (ORDER BY user_id DESC, event_id) - 1 AS place FROM events)")
def take_in_order(spark, sf_dir):
    """Rows gathered in another order."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    return numbered(op.sort_scores(rows, "user_id", "event_id"), "place").select("event_id", "place")


# messages


@query("SELECT name, accepted FROM (VALUES ('answers', TRUE), ('nations', FALSE)) t(name, accepted)")
def message_filter(spark, sf_dir):
    tables = {"answers": _chat(spark, sf_dir), "nations": _nation(spark, sf_dir)}
    return spark.createDataFrame([(k, op.has_message_columns(df)) for k, df in tables.items()], "name string, accepted boolean")


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("role", F.col("text").alias("content"), F.lit("t").alias("timestamp"), F.col("conv_id").cast("long").alias(BATCH), F.col("turn").cast("long").alias(ROW))


@query("SELECT 'a' AS name, count(*) AS rows FROM conversations UNION ALL SELECT 'all', 2 * count(*) FROM nation")
def aggregate_messages(spark, sf_dir):
    """Two tables of one schema as one message; a table of another passes on."""
    n = _batched(spark, sf_dir)
    box = {k: Message(k, k, "p", df, Publish(k)) for k, df in (("a", _chat(spark, sf_dir)), ("b", n), ("c", n))}
    made = Aggregator("x", [Publish("all")], forward=["a"]).process(box, None, "t")
    return spark.createDataFrame([(k, m.df.count()) for k, m in made.items()], "name string, rows long")


@query("SELECT role, text AS content FROM conversations UNION ALL SELECT role, text FROM conversations")
def aggregate_chat_messages(spark, sf_dir):
    chat = _chat(spark, sf_dir)
    box = {k: Message(k, k, "p", df, Publish(k)) for k, df in (("a", chat), ("b", chat), ("n", _batched(spark, sf_dir)))}
    return MessageAggregator("x", [Publish("all")]).process(box, None, "t")["all"].df.select("role", "content")


@query("SELECT 's' AS name, 's' AS subject, 'p' AS publisher, 'extend' AS how, n_nationkey::INT AS ids, n_name AS title FROM nation")
def message_ipc(spark, sf_dir):
    back = Message.from_ipc(spark, Message("s", "s", "p", _batched(spark, sf_dir), Publish("s")).to_ipc())
    return visible(back.df).select(F.lit(back.name).alias("name"), F.lit(back.subject).alias("subject"), F.lit(back.publisher).alias("publisher"), F.lit(back.publish.how).alias("how"), "ids", "title")


@example("SELECT unnest(['from_s_on_a']) AS name")
def response_filter(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in responses({"from_s_on_a": 1, "from_t_on_b": 2}, "_s_")], "name string")


@query("SELECT unnest(['n_name', 'n_regionkey']) AS field")
def schema_intersection(spark, sf_dir):
    nation = _nation(spark, sf_dir)
    return spark.createDataFrame([(x,) for x in op.fields_in_schemas(nation, nation.select("n_regionkey", "n_name", F.col("n_nationkey").cast("string").alias("n_nationkey")))], "field string")


@query("""SELECT conv_id, '[' || string_agg('{"role":"' || role || '","content":' || to_json(text) || '}', ',' ORDER BY turn) || ']' AS request FROM conversations GROUP BY conv_id""")
def chat_requests(spark, sf_dir):
    """A conversation's turns with their roles, as a chat service takes them."""
    return op.chat_request(table(spark, sf_dir, "conversations").withColumnRenamed("text", "content"), ["turn"], ["conv_id"])


@query("""SELECT conv_id, '<|im_start|>system' || chr(10) || '<tools>' || chr(10) || '{"t":1}' || chr(10) || '</tools><|im_end|>' || chr(10)
|| '<|im_start|>system' || chr(10) || '<documents>' || chr(10) || (SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) FROM nation) || chr(10) || '</documents><|im_end|>' || chr(10)
|| string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations GROUP BY conv_id""")
def prompt_with_tools(spark, sf_dir):
    docs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("text"), F.lit(0).cast("long").alias(BATCH), F.col("n_nationkey").cast("long").alias(ROW))
    return op.prompt(table(spark, sf_dir, "conversations").withColumnRenamed("text", "content"), ["turn"], ["conv_id"], True, ['{"t":1}'], docs)


@query("""SELECT conv_id, 0::BIGINT AS turn, 'system' AS role, 'You know documents.' AS content FROM conversations WHERE turn = 0
UNION ALL SELECT conv_id, 1 + turn, 'user', nullif(text, '') FROM conversations""")
def prepare_messages(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").select("conv_id", F.nullif(F.col("text"), F.lit("")).alias("content"), F.lit(0).cast("long").alias(BATCH), F.col("turn").alias(ROW))
    return op.prepare_messages(None, asked, "You know {what}.", keys=["conv_id"], what=F.lit("documents"))


@query("SELECT doc_id, 'Document ' || doc_id || ' in ' || lang || '.' AS text FROM documents")
def template_substitution(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", render_template("Document {id} in {lang}.", id=F.col("doc_id").cast("string"), lang=F.col("lang")).alias("text"))


@query("SELECT event_id, strftime(ts, '%a %b ') || lpad(day(ts)::VARCHAR, 2, ' ') || strftime(ts, ' %H:%M:%S %Y') AS stamp FROM events")
def timestamp_string(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", timestamp_text(F.col("ts")).alias("stamp"))


@query("""SELECT doc_id, CASE WHEN n < 1000 THEN n || 'B' WHEN n < 1000000 THEN printf('%.2fKB', n / 1000.0) ELSE printf('%.2fMB', n / 1000000.0) END AS size FROM (SELECT doc_id, doc_id * 16 AS n FROM documents)""")
def human_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", human_size(F.col("doc_id") * 16).alias("size"))


@query("SELECT doc_id, array_to_string(list_reverse(list_reverse(string_split(text, ' '))[1:5]), ' ') AS words FROM documents")
def keep_last_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(keep_last(F.split("text", " "), 5), " ").alias("words"))


@query("SELECT vec_id, 1.0::DOUBLE AS length, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS square FROM embeddings")
def vector_operations(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(unit(v)), 6).alias("length"), F.round(dot(v, v), 5).alias("square"))


# tools and operators by name


@example("""SELECT 'sort-scores-and-indices' AS tool_id, 'function' AS kind, 3 AS required UNION ALL SELECT 'human-in-the-loop', 'function', 1 UNION ALL SELECT 'chunk-documents', 'function', 3
UNION ALL SELECT 'join-inner', 'function', 3 UNION ALL SELECT 'relative-similarity-score', 'function', 3""")
def tool_catalog(spark, sf_dir):
    known = op.tool_catalog(spark, [*op.OPERATORS, "nothing"])
    return known.select("tool_id", F.get_json_object("tool", "$.type").alias("kind"), F.json_array_length(F.get_json_object("tool", "$.function.parameters.required")).alias("required"))


@query("SELECT conv_id, turn, 't' || conv_id AS lhs_name, role AS lhs_pk, 'sort-scores-and-indices' AS which, 'stream-lhs-stream-rhs' AS stream FROM conversations")
def operator_config(spark, sf_dir):
    """A tool call a turn, decoded batch by batch."""
    call = F.to_json(F.struct(F.lit("sort-scores-and-indices").alias("name"), F.struct(F.concat(F.lit("t"), "conv_id").alias("lhs_name"), F.col("role").alias("lhs_pk")).alias("arguments")))

    @F.pandas_udf("lhs_name string, lhs_pk string, which string, stream string")
    def decoded(calls: pd.Series) -> pd.DataFrame:
        found = [op.OperatorConfig.from_tool_call(c) for c in calls]
        return pd.DataFrame({n: [getattr(c, n) for c in found] for n in ("lhs_name", "lhs_pk", "which", "stream")}, dtype=object)

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", decoded(call).alias("c")).select("conv_id", "turn", "c.*")


@query("SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def dispatch_join(spark, sf_dir):
    config = op.OperatorConfig(which="join-inner", lhs_fk="n_regionkey", rhs_fk="r_regionkey")
    return op.dispatch(config, _nation(spark, sf_dir), table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query("SELECT doc_id || '_' || i AS chunk_id, doc_id, lang, substr(text, (i * 90 + 1)::INT, 100) AS text FROM (SELECT *, unnest(generate_series(0, CASE WHEN length(text) <= 100 THEN 0 ELSE ceil((length(text) - 10) / 90.0)::INT - 1 END)) AS i FROM documents)")
def dispatch_chunks(spark, sf_dir):
    config = op.OperatorConfig(which="chunk-documents", lhs_pk="doc_id", lhs_values="text", op_kwargs='{"size": 100, "overlap": 10}')
    return op.dispatch(config, table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


# models


def _service(url: str, body: dict) -> dict:
    """A stand-in: vectors of the texts' lengths, and answers that count the messages."""
    if url.endswith("/embeddings"):
        return {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
    said = body["messages"]
    return {"choices": [{"finish_reason": "stop", "message": {"content": f"{len(said)} {said[-1]['role']}"}}]}


@query("SELECT source, list_sort(list(length(text)::DOUBLE))[1] AS least, count(*) AS n FROM documents GROUP BY source")
def embed_by_service(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "text")
    made = embed_texts(docs, ServiceEmbedder(_service, "http://service", "m", 2), keep=["source"])
    return made.groupBy("source").agg(F.min(F.get("embeddings", F.lit(0)).cast("double")).alias("least"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, length(text)::DOUBLE AS a, 1.0::DOUBLE AS b FROM documents")
def fixed_size_lists(spark, sf_dir):
    """Vectors of one length from a model's batch."""
    made = embed_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), ServiceEmbedder(_service, "u", "m", 2), keep=["doc_id"])
    return made.select("doc_id", F.get("embeddings", F.lit(0)).cast("double").alias("a"), F.get("embeddings", F.lit(1)).cast("double").alias("b"))


@query("SELECT conv_id, count(*) || ' ' || arg_max(role, turn) AS content FROM conversations GROUP BY conv_id")
def chat_by_service(spark, sf_dir):
    """A service gets every conversation with its roles."""
    asked = chat_requests(spark, sf_dir).withColumnRenamed("request", "prompt")

    class Roles:
        def reply(self, prompt):
            return ServiceChat(_service, "http://service", "m").chat(json.loads(prompt))

    return answer(asked, Roles()).select("conv_id", "content")


@query("SELECT conv_id, arg_max(text, turn) AS content FROM conversations WHERE role = 'user' GROUP BY conv_id")
def chat_local(spark, sf_dir):
    """Pieces of a local model's answers, folded; it says the last user turn again."""
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    said = answer(op.prompt(rows, ["turn"], ["conv_id"], True).join(rows.where("role = 'user'").select("conv_id").distinct(), "conv_id", "left_semi"), EchoChat())
    return op.fold_chat(said, [BATCH, ROW], ["conv_id"]).select("conv_id", "content")


@example("SELECT * FROM (VALUES ('best', 'a a a'), ('top 1', 'a a a'), ('top half', 'a a a'), ('both', 'a a a')) t(mode, content)")
def sampling_modes(spark, sf_dir):
    """The modes that can only give the likeliest word give it."""
    modes = {"best": {"temperature": 0}, "top 1": {"top_k": 1}, "top half": {"top_p": 0.5}, "both": {"top_k": 2, "top_p": 0.5}}
    scores = {"x": {"a": 3.0, "b": 0.0}, "a": {"a": 3.0, "b": 0.0}}
    rows = [(m, "".join(TableChat(scores, most=3, **how).reply("<|im_start|>user\nx<|im_end|>\n"))) for m, how in modes.items()]
    return spark.createDataFrame(rows, "mode string, content string")


# sessions


def _session(spark: SparkSession, sf_dir: str, processors: list, plans: list, more: list | None = None, max_iter: int = 25) -> Session:
    state = [Subject("state", _batched(spark, sf_dir)), *(more or [])]
    return SessionBuilder("s").with_tasks(plans).with_processors(processors).with_runtime_envs([RuntimeEnv()]).with_state(state).with_max_iter(max_iter).build(spark)


def _published(spark: SparkSession, sf_dir: str, how: str, column: str | None = None, rows: DataFrame | None = None, custom=None) -> DataFrame:
    """Nations in a batch per region, and what a publication of region rows makes of them."""
    new = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("ids"), F.col("r_name").alias("title")) if rows is None else rows
    return Publish("state", how, column, custom).apply(Subject("state", _batched(spark, sf_dir)), new).data


@query(f"{_NAMES} UNION ALL SELECT r_regionkey::INT, r_name FROM region")
def publish_extend(spark, sf_dir):
    return _published(spark, sf_dir, "extend")


@query("SELECT r_regionkey::INT AS ids, r_name AS title FROM region")
def publish_replace(spark, sf_dir):
    return _published(spark, sf_dir, "replace")


@query(f"{_NAMES} WHERE n_regionkey < (SELECT max(n_regionkey) FROM nation) UNION ALL SELECT r_regionkey::INT, r_name FROM region")
def publish_replace_last(spark, sf_dir):
    return _published(spark, sf_dir, "replace_last")


@query(f"{_NAMES} UNION ALL SELECT NULL, string_agg(r_name, '' ORDER BY r_regionkey) FROM region")
def publish_extend_chunks(spark, sf_dir):
    pieces = table(spark, sf_dir, "region").select(F.col("r_name").alias("title"), F.lit(0).cast("long").alias(BATCH), F.col("r_regionkey").cast("long").alias(ROW))
    return _published(spark, sf_dir, "extend_chunks", "title", pieces)


@query(_NAMES)
def publish_none(spark, sf_dir):
    return _published(spark, sf_dir, "none")


@query("SELECT max(n_nationkey)::INT AS ids, 'r' || count(*) AS title FROM nation")
def publish_custom(spark, sf_dir):
    def longest(old: Subject, new: DataFrame) -> Subject:
        return Subject(old.name, old.data.agg(F.max("ids").alias("ids"), F.concat(F.lit("r"), F.count(F.lit(1))).alias("title")))

    return _published(spark, sf_dir, "custom", custom=longest)


def _readers(spark: SparkSession, sf_dir: str) -> Session:
    """A task for every way to subscribe, each telling how many rows it saw."""
    ways = {
        "update_full": Subscribe("state"),
        "update_last": Subscribe("state", last=True),
        "always_full": Subscribe("state", ALWAYS),
        "always_last": Subscribe("state", ALWAYS, True),
        "custom": Subscribe("state", custom=lambda session: session.state["state"].df.where("ids % 2 = 0")),
        "nothing": Subscribe(),
    }
    seen = lambda name: lambda **tables: spark.createDataFrame([(name, sum(t.count() for t in tables.values()))], "way string, rows long")
    steps = [FunctionProcessor(f"p_{k}", seen(k), [Publish("seen")], [s]) for k, s in ways.items()]
    return _session(spark, sf_dir, steps, [TaskPlan(k, [f"p_{k}"]) for k in ways], [Subject("seen", spark.createDataFrame([], "way string, rows long"))], 1)


@query("""WITH n AS (SELECT count(*) AS a, count(*) FILTER (n_regionkey = (SELECT max(n_regionkey) FROM nation)) AS l, count(*) FILTER (n_nationkey % 2 = 0) AS e FROM nation)
SELECT unnest(['update_full', 'update_last', 'always_full', 'always_last', 'custom', 'nothing']) AS way, unnest([a, l, a, l, e, 0]) AS rows FROM n""")
def subscriptions(spark, sf_dir):
    session = _readers(spark, sf_dir)
    session.run("state", _batched(spark, sf_dir), "replace")
    return session.state["seen"].data


@query("SELECT unnest(['always_full', 'always_last', 'nothing']) AS task")
def ready_tasks(spark, sf_dir):
    """Before anything changed, the tasks are ready that wait for no update."""
    return spark.createDataFrame([(x,) for x in _readers(spark, sf_dir).ready()], "task string")


@query("SELECT 3 AS steps, 64 * count(DISTINCT n_regionkey) AS batches FROM nation")
def superstep_counts(spark, sf_dir):
    session = _adders(spark, sf_dir, 3)
    return spark.createDataFrame([(session.iter, session.state["state"].count_batches())], "steps int, batches long")


def _adders(spark: SparkSession, sf_dir: str, steps: int) -> Session:
    """Three tasks that add a row to each batch of one subject, run for so many supersteps."""
    adders = [AddRows(f"p{i}", {"ids": 0, "title": "new"}, [Publish("state")], [Subscribe("state")]) for i in (1, 2, 3)]
    session = _session(spark, sf_dir, adders, [TaskPlan(f"t{i}", [f"p{i}"]) for i in (1, 2, 3)], max_iter=steps)
    session.run("state", _batched(spark, sf_dir), "replace")
    return session


@query("""WITH RECURSIVE s AS (SELECT 0 AS step, count(*) AS size, 1::HUGEINT AS n FROM nation GROUP BY n_regionkey
UNION ALL SELECT step + 1, size + more, n * CASE more WHEN 1 THEN 3 ELSE 1 END FROM s, (VALUES (0), (1)) t(more) WHERE step < 4)
SELECT size::BIGINT AS rows, sum(n)::BIGINT AS batches FROM s WHERE step = 4 GROUP BY size""")
def superstep_addrows(spark, sf_dir):
    """Four supersteps: batches by their rows at the end."""
    sizes = _adders(spark, sf_dir, 4).state["state"].df.groupBy(BATCH).agg(F.count(F.lit(1)).alias("rows"))
    return sizes.groupBy("rows").agg(F.count(F.lit(1)).alias("batches"))


@query("SELECT task_name, subject_name, status_value FROM (VALUES ('t1', 'state', FALSE), ('t2', 'other', TRUE)) t(task_name, subject_name, status_value)")
def tracker_round_trip(spark, sf_dir):
    """t1 publishes on what t2 waits for; the tracker is saved, cleared and read back."""
    take = lambda **tables: visible(next(iter(tables.values())))
    steps = [FunctionProcessor("p1", take, [Publish("other")], [Subscribe("state")]), FunctionProcessor("p2", take, [Publish("state", "none")], [Subscribe("other")])]
    session = _session(spark, sf_dir, steps, [TaskPlan("t1", ["p1"]), TaskPlan("t2", ["p2"])], [Subject("other", _batched(spark, sf_dir).limit(0))])
    session.superstep([session.message("state", _batched(spark, sf_dir), "replace")])
    path = state_path(spark)
    session.write_tracker(path)
    session.updated["t2"]["other"] = False
    session.read_tracker(path)
    return session.tracker()


@query(f"{_NAMES} UNION ALL SELECT r_regionkey::INT, r_name FROM region")
def state_round_trip(spark, sf_dir):
    session = _readers(spark, sf_dir)
    session.put_json("state", io.to_json_objects(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ids"), F.col("r_name").alias("title"))))
    path = state_path(spark)
    session.write_state(path, "a")
    session.state["state"] = Subject("state", _batched(spark, sf_dir).limit(0))
    session.read_state(path, "a")
    return session.state["state"].data


@query(f"{_NAMES} UNION ALL SELECT r_regionkey::INT, r_name FROM region")
def put_csv(spark, sf_dir):
    session = _readers(spark, sf_dir)
    session.put_csv("state", io.to_csv_text(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ids"), F.col("r_name").alias("title")), quote='"'))
    return session.state["state"].data


@query("SELECT r_regionkey::INT AS ids, r_name AS title FROM region")
def put_json_replace(spark, sf_dir):
    session = _readers(spark, sf_dir)
    session.put_json("state", io.to_json_objects(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ids"), F.col("r_name").alias("title"))), "replace")
    return session.state["state"].data


@query(_NAMES)
def get_csv(spark, sf_dir):
    session = _readers(spark, sf_dir)
    return io.read_csv_text(spark, session.get_csv("state").replace("'", ""), session.state["state"].schema)


@query(_NAMES)
def get_json(spark, sf_dir):
    session = _readers(spark, sf_dir)
    return io.read_json_values(spark, session.get_json("state"), session.state["state"].schema)


@query("""SELECT * FROM (VALUES ('seen', 'rows', 'bigint', 0), ('seen', 'way', 'string', 0)) t(subject_names, column_names, type_names, num_rows)
UNION ALL SELECT 'state', c, k, count(*) FROM nation, (VALUES ('ids', 'int'), ('title', 'string')) t(c, k) GROUP BY c, k""")
def subjects_info(spark, sf_dir):
    return _readers(spark, sf_dir).subjects()


@query("""SELECT w AS task_names, 'p_' || w AS processor_names, 'seen' AS subject_names, '+' AS pub_or_sub FROM (VALUES ('update_full'), ('update_last'), ('always_full'), ('always_last'), ('custom'), ('nothing')) t(w)
UNION ALL SELECT w, 'p_' || w, 'state', '-' FROM (VALUES ('update_full'), ('update_last'), ('always_full'), ('always_last'), ('custom')) t(w) UNION ALL SELECT 'nothing', 'p_nothing', '', '-'""")
def tasks_info(spark, sf_dir):
    return _readers(spark, sf_dir).tasks_info()


@query("""SELECT unnest(['t0', 't1', 't2', 'All']) AS task_name, 'output_rows' AS metric_name, unnest([n, n, n, 3 * n]) AS metric_value FROM (SELECT count(*) + count(DISTINCT n_regionkey) AS n FROM nation)""")
def metrics_info(spark, sf_dir):
    adders = [AddRows(f"p{i}", {"ids": 0, "title": "new"}, [Publish("state")], [Subscribe("state")]) for i in range(3)]
    session = _session(spark, sf_dir, adders, [TaskPlan(f"t{i}", [f"p{i}"]) for i in range(3)], max_iter=1)
    session.run("state", _batched(spark, sf_dir), "replace")
    return session.metrics_info().where("metric_name = 'output_rows'")


@query("SELECT 'seen' AS subject WHERE FALSE UNION ALL SELECT 'state'")
def subjects_by_schema(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in _readers(spark, sf_dir).subject_with_schema(_batched(spark, sf_dir))], "subject string")


@query(_NAMES)
def echo_task(spark, sf_dir):
    """The session's own task gives out what it reads."""
    session = _session(spark, sf_dir, [Echo("out", [], [Subscribe("state")])], [TaskPlan("s", ["out"])])
    said = list(session.stream([Message("from_user_on_state", "state", "user", _batched(spark, sf_dir), Publish("state", "replace"))]))
    return visible(said[0]["from_s_on_state"].df)


@query("SELECT n_nationkey::INT AS ids, n_name || '!' AS title FROM nation")
def forwarded_subscription(spark, sf_dir):
    """One processor forwards a table untouched that the next one changes."""
    first = FunctionProcessor("a", lambda **t: {"other": visible(t["seen"])}, [Publish("other")], [Subscribe("seen", ALWAYS), Subscribe("state")], ["state"])
    second = FunctionProcessor("b", lambda state, **t: {"other": visible(state).withColumn("title", F.concat("title", F.lit("!")))}, [Publish("other", "replace")], [])
    more = [Subject("seen", _batched(spark, sf_dir).limit(1)), Subject("other", _batched(spark, sf_dir).limit(0))]
    session = _session(spark, sf_dir, [first, second], [TaskPlan("t", ["a", "b"])], more)
    session.run("state", _batched(spark, sf_dir), "replace")
    return session.state["other"].data


@query("SELECT n_regionkey::BIGINT AS batch, count(*) + 1 AS rows FROM nation GROUP BY n_regionkey")
def add_rows(spark, sf_dir):
    box = {"state": Message("state", "state", "p", _batched(spark, sf_dir), Publish("state"))}
    made = AddRows("p", {"ids": 0, "title": "new"}).process(box, None, "t")["state"].df
    return made.groupBy(F.col(BATCH).alias("batch")).agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT 'tool' AS role, '[' || string_agg('{"title":"' || n_name || '"}', ',' ORDER BY n_regionkey, n_nationkey) || ']' AS content, '' AS timestamp FROM nation""")
def summary_processor(spark, sf_dir):
    box = {k: Message(k, k, "p", _batched(spark, sf_dir), Publish(k)) for k in ("state", "config")}
    return visible(Summary("p", ["title"], None, [Publish("out")], [], ["config"]).process(box, None, "t")["out"].df)


@query("SELECT 'One' AS subject, 'first' AS content UNION ALL SELECT 'Two', 'second'")
def dynamic_routing(spark, sf_dir):
    """Rows of a control table become messages on the subjects they name; unknown subjects are passed over."""
    rows = spark.createDataFrame([("a", "p", "One", "first"), ("b", "p", "Two", "second"), ("c", "p", "Three", "lost")], "name string, publisher string, subject string, `values` string")
    subjects = [Subject(n, spark.createDataFrame([], "`values` string")) for n in ("One", "Two")]
    plan = [Echo("e", [], [Subscribe("state"), Subscribe("One"), Subscribe("Two")])]
    session = _session(spark, sf_dir, plan, [TaskPlan("t", ["e"])], subjects)
    session.apply([session.message("calls", rows)])
    return session.state["One"].data.select(F.lit("One").alias("subject"), F.col("values").alias("content")).unionByName(session.state["Two"].data.select(F.lit("Two").alias("subject"), F.col("values").alias("content")))


@query("SELECT 'missing state' AS case_, TRUE AS told UNION ALL SELECT 'processor not planned', TRUE UNION ALL SELECT 'good', FALSE")
def session_validation(spark, sf_dir):
    echo = Echo("e", [], [Subscribe("state")])

    def told(processors, state):
        try:
            SessionBuilder("s").with_tasks([TaskPlan("t", ["e"])]).with_processors(processors).with_runtime_envs([RuntimeEnv()]).with_state(state).build(spark)
        except ValueError:
            return True
        return False

    good = [Subject("state", _batched(spark, sf_dir))]
    rows = [("missing state", told([echo], [])), ("processor not planned", told([echo, Echo("f")], good)), ("good", told([echo], good))]
    return spark.createDataFrame(rows, "case_ string, told boolean")


@query("SELECT 'a' AS task, 'state' AS subject, 'in' AS side UNION ALL SELECT 'a', 'seen', 'out'")
def task_subjects(spark, sf_dir):
    """What a task subscribes to and publishes on, derived from its processors."""
    step = FunctionProcessor("p", lambda **t: {}, [Publish("seen"), Publish("state", "none")], [Subscribe("state")])
    session = _session(spark, sf_dir, [step], [TaskPlan("a", ["p"])], [Subject("seen", _batched(spark, sf_dir).limit(0))])
    task = session.tasks["a"]
    return spark.createDataFrame([("a", x.subject, "in") for x in task.subscriptions] + [("a", x.subject, "out") for x in task.publications], "task string, subject string, side string")


@query("SELECT 'a' AS env, 1 AS shared")
def runtime_environment(spark, sf_dir):
    """Tasks of one environment share its services."""
    env = RuntimeEnv("a", {"cache": {}})
    step = Echo("e", [], [Subscribe("state")])
    built = SessionBuilder("s").with_tasks([TaskPlan("t", ["e"], "a"), TaskPlan("u", ["e"], "a")]).with_processors([step]).with_runtime_envs([env]).with_state([Subject("state", _batched(spark, sf_dir))]).build(spark)
    return spark.createDataFrame([("a", len({id(t.env.services["cache"]) for t in built.tasks.values()}))], "env string, shared int")


@example("SELECT 'b' AS k, 2::BIGINT AS v")
def config_subject(spark, sf_dir):
    found = config_of(_one(spark, '{"k": "b", "v": 2}', "`values`"))
    return spark.createDataFrame([(found["k"], found["v"])], "k string, v long")


# metrics


_METRICS = """m AS (SELECT 't' || user_id % 4 AS task, ['output_rows', 'elapsed_compute', 'hits', 'most', 'start_timestamp', 'end_timestamp'][event_id % 6 + 1] AS name, event_id % 5 AS shard, event_id AS value FROM events),
s AS (SELECT name, CASE name WHEN 'start_timestamp' THEN min(value) WHEN 'end_timestamp' THEN max(value) ELSE sum(value) END::BIGINT AS value,
  CASE name WHEN 'output_rows' THEN 0 WHEN 'elapsed_compute' THEN 1 WHEN 'start_timestamp' THEN 9 WHEN 'end_timestamp' THEN 10 ELSE 6 END AS kind FROM m GROUP BY name)"""


def _metric_rows(spark, sf_dir):
    """Events as metrics of four tasks."""
    names = F.array(*[F.lit(n) for n in ("output_rows", "elapsed_compute", "hits", "most", "start_timestamp", "end_timestamp")])
    name = F.get(names, (F.col("event_id") % 6).cast("int"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("task_name"), name.alias("metric_name"), (F.col("event_id") % 5).alias("shard"), F.col("event_id").alias("metric_value"))


@query(f"WITH {_METRICS} SELECT a.name, (SELECT sum(value)::BIGINT FROM m WHERE m.name = a.name) AS value FROM (SELECT unnest(['output_rows', 'elapsed_compute', 'nothing']) AS name) a")
def metric_sums(spark, sf_dir):
    return sum_metrics(_metric_rows(spark, sf_dir), ["output_rows", "elapsed_compute", "nothing"]).toDF("name", "value")


@query(f"WITH {_METRICS} SELECT row_number() OVER (ORDER BY kind, name) - 1 AS place, name, value FROM s")
def metric_display(spark, sf_dir):
    return displayed_metrics(aggregate_metrics(_metric_rows(spark, sf_dir))).toDF("place", "name", "value")


@query(f"WITH {_METRICS} SELECT row_number() OVER (ORDER BY kind, name) - 1 AS place, name, value FROM s WHERE name NOT LIKE '%timestamp'")
def metrics_without_timestamps(spark, sf_dir):
    return displayed_metrics(without_timestamps(aggregate_metrics(_metric_rows(spark, sf_dir)))).toDF("place", "name", "value")


@query(f"WITH {_METRICS} SELECT task, name, sum(value)::BIGINT AS value FROM (FROM m WHERE name IN ('output_rows', 'elapsed_compute')) GROUP BY ROLLUP (name, task) HAVING name IS NOT NULL".replace("SELECT task, name", "SELECT coalesce(task, 'All') AS task, name"))
def metric_totals(spark, sf_dir):
    rows = _metric_rows(spark, sf_dir).where(F.col("metric_name").isin("output_rows", "elapsed_compute"))
    return metric_info(rows.groupBy("task_name", "metric_name").agg(F.sum("metric_value").alias("metric_value"))).toDF("task", "name", "value")


@query(f"WITH {_METRICS} SELECT task, name, 'shard=' || shard AS labels, sum(value)::BIGINT AS value FROM m WHERE name IN ('hits', 'most') GROUP BY ALL")
def metric_labels(spark, sf_dir):
    rows = _metric_rows(spark, sf_dir).where(F.col("metric_name").isin("hits", "most"))
    label = F.concat(F.lit("shard="), F.col("shard").cast("string"))
    return rows.groupBy(F.col("task_name").alias("task"), F.col("metric_name").alias("name"), label.alias("labels")).agg(F.sum("metric_value").alias("value"))


# plans


@query("SELECT arg_max(text, (conv_id, turn)) AS content, count(*) + 1 AS messages FROM conversations")
def chat_plan(spark, sf_dir):
    """Whole conversations go in, the last user turn comes back, and the answer is in the subject too."""
    session = chat_session(spark)
    rows = _chat(spark, sf_dir).withColumn("role", F.lit("user"))
    said = session.run("messages", rows)
    return visible(said[-1]["from_chat_on_messages"].df).select("content", F.lit(session.state["messages"].count_rows()).alias("messages"))


_CHUNK_COUNT = "(SELECT sum(CASE WHEN length(text) <= 512 THEN 1 ELSE ceil((length(text) - 64) / 448.0) END)::BIGINT FROM documents)"


@query(f"""SELECT unnest(['documents', 'chunks', 'doc_embeddings', 'queries', 'q_embeddings', 'top_k', 'messages']) AS subject,
unnest([(SELECT count(*) FROM documents), {_CHUNK_COUNT}, {_CHUNK_COUNT}, 1, 1, 1, 1]) AS rows""")
def document_chat(spark, sf_dir):
    """Documents and a question through the whole session: how many rows every subject has in the end."""
    session = document_session(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    session.superstep([session.message("documents", docs)])
    session.run("queries", spark.createDataFrame([("q", "what of the license")], "query_id string, text string"))
    return spark.createDataFrame([(s.name, s.count_rows()) for s in session.state.values()], "subject string, rows long")


@query("""SELECT '[' || string_agg('{"n_nationkey":' || n_nationkey || '}', ',' ORDER BY n_nationkey DESC) || ']' AS content FROM (SELECT n_nationkey FROM nation ORDER BY n_nationkey DESC LIMIT 3)""")
def tool_chat(spark, sf_dir):
    """A model calls a tool on a table, which goes back to it as three rows, and then answers."""
    call = '<tool_call>\n{"name": "sort-scores-and-indices", "arguments": {"lhs_name": "nation", "lhs_pk": "n_nationkey", "lhs_values": "n_nationkey"}}\n</tool_call>'

    class Once:
        def reply(self, prompt):
            yield prompt.rpartition("<|im_start|>tool\n")[2].partition("<|im_end|>")[0] if "<|im_start|>tool" in prompt else call

    session = tool_session(spark, [Subject("nation", table(spark, sf_dir, "nation").select("n_nationkey"))], model=Once())
    said = session.run("messages", spark.createDataFrame([("user", "sort", "t")], "role string, content string, timestamp string"))
    return visible(next(iter(said[-1].values())).df).select("content")


@example("SELECT unnest(['Chat', 'DocChat']) AS plan, unnest([1, 7]) AS subjects, unnest([2, 5]) AS tasks, FALSE AS unknown")
def plan_factory(spark, sf_dir):
    def unknown():
        try:
            make_session("nothing", spark)
        except ValueError:
            return False
        return True

    made = [(p, make_session(p, spark)) for p in ("Chat", "DocChat")]
    return spark.createDataFrame([(p, len(s.state), len(s.tasks), unknown()) for p, s in made], "plan string, subjects int, tasks int, unknown boolean")


@query("SELECT 'me@xChat' AS name, role, text AS content FROM conversations")
def session_registry(spark, sf_dir):
    """A user's session is saved by name and read by another registry."""
    path = state_path(spark)
    registry = SessionRegistry(spark, path)
    session = registry.session("me@x", "Chat")
    session.apply([session.message("messages", _chat(spark, sf_dir), "replace")])
    registry.write("me@x", "Chat")
    back = SessionRegistry(spark, path).read("me@x", "Chat")
    return back.state["messages"].data.select(F.lit(back.name).alias("name"), "role", "content")


@query("SELECT 'same' AS a, TRUE AS b UNION ALL SELECT 'other', FALSE")
def schema_checks(spark, sf_dir):
    n = _batched(spark, sf_dir)
    return spark.createDataFrame([("same", same_schema(n, visible(n))), ("other", same_schema(n, n.withColumn("ids", F.col("ids").cast("long"))))], "a string, b boolean")
