"""Chat, retrieval-augmented answers, and tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import ChatModel, EchoChat, Embedder, HashEmbedder, answer, embed_texts
from ..operators import OperatorConfig, chunk_documents, dispatch, fold_chat, parse_tool_calls, prompt, summarize, tool_schema, top_k_similar
from ..operators.messages import has_message_columns
from ..session import ALWAYS, AddRows, Echo, FunctionProcessor, Processor, Publish, RuntimeEnv, Session, SessionBuilder, Subscribe, TaskPlan, config_of
from ..storage import store
from ..subjects import HIDDEN, Subject, visible, with_batches

MESSAGE = "role string, content string, timestamp string"


def _empty(spark: SparkSession, name: str, schema: str) -> Subject:
    return Subject(name, spark.createDataFrame([], schema))


class _Chat(Processor):
    """Answers the messages it reads, as one message."""

    def __init__(self, name: str, model: ChatModel, subject: str, publications, subscriptions):
        super().__init__(name, publications, subscriptions)
        self.model, self.subject = model, subject

    def process(self, inbox, session, task):
        found = [m.df.select("role", "content", *HIDDEN) for m in inbox.values() if has_message_columns(m.df)]
        history = found[0]
        for other in found[1:]:
            history = history.unionByName(other)
        said = fold_chat(answer(prompt(history, list(HIDDEN), generate=True), self.model))
        return self.forwarded(inbox) | {self.subject: self.message(self.subject, said)}


def chat_session(spark: SparkSession, name: str = "chat", model: ChatModel | None = None) -> Session:
    """messages to answer to messages; the session's own task gives the answers out."""
    talk = _Chat("chat_processor", model or EchoChat(), "messages", [Publish("messages")], [Subscribe("messages")])
    out = Echo("output_processor", [], [Subscribe("messages", last=True)])
    return (
        SessionBuilder(name)
        .with_tasks([TaskPlan("chat_task", ["chat_processor"]), TaskPlan(name, ["output_processor"])])
        .with_processors([talk, out])
        .with_runtime_envs([RuntimeEnv()])
        .with_state([_empty(spark, "messages", MESSAGE)])
        .build(spark)
    )


def retrieve(chunks: DataFrame, doc_embeddings: DataFrame, query_embeddings: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, chunk_id, score, rank, document_id, text): the k nearest chunks of every query, with their texts.

    Similarity, order and limit are one step that keeps k rows a task, so the table of all
    scores never exists; then k rows a query join the chunks.
    """
    best = top_k_similar(query_embeddings, doc_embeddings, k, "query_id", "chunk_id", "embeddings", "embeddings")
    return visible(chunks).join(F.broadcast(best), "chunk_id").select("query_id", "chunk_id", "score", "rank", "document_id", "text")


def document_session(spark: SparkSession, name: str = "doc_chat", embedder: Embedder | None = None, model: ChatModel | None = None, size: int = 512, overlap: int = 64, k: int = 3) -> Session:
    """documents are chunked and embedded, queries embedded; the k best chunks and the question are answered."""
    embedder, model = embedder or HashEmbedder(), model or EchoChat()

    def chunked(documents):
        chunks = chunk_documents(documents, "document_id", "text", size, overlap).select("chunk_id", "document_id", "text")
        return {"chunks": chunks, "doc_embeddings": embed_texts(chunks, embedder).select("chunk_id", "document_id", "embeddings")}

    def embedded(queries):
        return embed_texts(queries, embedder).select("query_id", "embeddings")

    def searched(chunks, doc_embeddings, q_embeddings):
        found = retrieve(chunks, doc_embeddings, visible(q_embeddings), k)
        return summarize(found.select("rank", "query_id", "text"), ["text"], None, order=["query_id", "rank"], stamp=F.lit(""))

    def asked(queries, top_k):
        question = visible(queries).select(F.lit("user").alias("role"), F.col("text").alias("content"), F.lit("").alias("timestamp"))
        history = visible(top_k).withColumn("_n", F.lit(0)).unionByName(question.withColumn("_n", F.lit(1)))
        return fold_chat(answer(prompt(history, ["_n", "content"], generate=True), model))

    steps = [
        FunctionProcessor("chunk_processor", chunked, [Publish("chunks", "replace"), Publish("doc_embeddings", "replace")], [Subscribe("documents")]),
        FunctionProcessor("embed_processor", embedded, [Publish("q_embeddings", "replace")], [Subscribe("queries", last=True)]),
        FunctionProcessor("search_processor", searched, [Publish("top_k", "replace")], [Subscribe("chunks", ALWAYS), Subscribe("doc_embeddings", ALWAYS), Subscribe("q_embeddings")]),
        FunctionProcessor("chat_processor", asked, [Publish("messages")], [Subscribe("queries", ALWAYS, True), Subscribe("top_k")]),
        Echo("output_processor", [], [Subscribe("messages", last=True)]),
    ]
    vectors = "embeddings array<float>"
    state = [
        _empty(spark, "documents", "document_id string, text string"),
        _empty(spark, "queries", "query_id string, text string"),
        _empty(spark, "chunks", "chunk_id string, document_id string, text string"),
        _empty(spark, "doc_embeddings", f"chunk_id string, document_id string, {vectors}"),
        _empty(spark, "q_embeddings", f"query_id string, {vectors}"),
        _empty(spark, "top_k", MESSAGE),
        _empty(spark, "messages", MESSAGE),
    ]
    tasks = [TaskPlan(t, [p]) for t, p in (("chunk_task", "chunk_processor"), ("embed_task", "embed_processor"), ("search_task", "search_processor"), ("chat_task", "chat_processor"), (name, "output_processor"))]
    return SessionBuilder(name).with_tasks(tasks).with_processors(steps).with_runtime_envs([RuntimeEnv()]).with_state(state).build(spark)


class _Parse(Processor):
    """Tool calls of the last answer go to the subjects of their names; plain text goes to the human."""

    def process(self, inbox, session, task):
        last = inbox["answers"].df
        calls, _ = store(parse_tool_calls(last))
        asked = fold_chat(last).join(F.broadcast(visible(calls).where("name is null").limit(1).select("values")), F.col("content") == F.col("values")).drop("values")
        rows = calls.where("name is not null")
        return {"calls": self.message("calls", rows.select("name", "publisher", "subject", "values"), Publish("calls")), "replies": self.message("replies", asked)}


class _Operate(Processor):
    """Runs the operator that a tool call names, and sums up its result for the model."""

    def __init__(self, name: str, tool: str, rows: int, publications, subscriptions):
        super().__init__(name, publications, subscriptions)
        self.tool, self.rows = tool, rows

    def process(self, inbox, session, task):
        config = OperatorConfig.from_tool_call(visible(inbox[self.tool].df).first()["values"])
        table = lambda n: session.state[n].df if n in session.state else None
        made = dispatch(config, table(config.lhs_name), table(config.rhs_name) if config.rhs_name else None, session.spark)
        order = [c for c in HIDDEN if c in made.columns]
        made = with_batches(visible(made)) if config.which == "sort-scores-and-indices" or not order else made
        return {"messages": self.message("messages", summarize(made, None, self.rows, stamp=F.lit("")))}


def tool_session(spark: SparkSession, tables: list[Subject], tool: str = "sort-scores-and-indices", name: str = "tool_chat", model: ChatModel | None = None, rows: int = 3) -> Session:
    """messages to model; its tool calls run operators on ``tables`` and go back to it, its plain answers come out."""
    ask = "human-in-the-loop"
    steps = [
        _Chat("chat_processor", model or EchoChat(), "answers", [Publish("answers")], [Subscribe("messages")]),
        _Parse("parser_processor", [Publish("calls"), Publish(tool), Publish(ask), Publish("replies")], [Subscribe("answers", last=True)]),
        _Operate("tool_processor", tool, rows, [Publish("messages")], [Subscribe(tool, last=True)]),
        _Operate("ask_processor", ask, rows, [Publish("replies")], [Subscribe(ask, last=True)]),
        Echo("output_processor", [], [Subscribe("replies", last=True)]),
        Echo("tables_processor", [], [*[Subscribe(t.name) for t in tables], Subscribe("calls")]),
    ]
    tasks = [TaskPlan(t, [p]) for t, p in (("chat_task", "chat_processor"), ("parser_task", "parser_processor"), ("tool_task", "tool_processor"), ("ask_task", "ask_processor"), (name, "output_processor"), ("tables_task", "tables_processor"))]
    state = [_empty(spark, s, MESSAGE) for s in ("messages", "answers", "replies")] + [_empty(spark, s, "values string") for s in (tool, ask)] + [_empty(spark, "calls", "name string, publisher string, subject string, values string"), *tables]
    return SessionBuilder(name).with_tasks(tasks).with_processors(steps).with_runtime_envs([RuntimeEnv()]).with_state(state).with_max_iter(8).build(spark)


PLANS = {"Chat": chat_session, "DocChat": document_session, "ToolChat": tool_session}


def make_session(plan: str, spark: SparkSession, **options) -> Session:
    if plan not in PLANS:
        raise ValueError(f"There is no session plan {plan!r}; there are {sorted(PLANS)}.")
    return PLANS[plan](spark, **options)


class SessionRegistry:
    """Sessions by user and plan, saved and restored as Parquet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.sessions = spark, path.rstrip("/"), {}

    def session(self, user: str, plan: str, **options) -> Session:
        key = f"{user}{plan}"
        if key not in self.sessions:
            self.sessions[key] = make_session(plan, self.spark, name=key, **options)
        return self.sessions[key]

    def write(self, user: str, plan: str, tag: str = "state") -> None:
        session = self.session(user, plan)
        session.write_state(self.path, tag)
        session.write_tracker(f"{self.path}/{tag}-{session.name}-tracker")

    def read(self, user: str, plan: str, tag: str = "state", **options) -> Session:
        session = self.session(user, plan, **options)
        session.read_state(self.path, tag)
        session.read_tracker(f"{self.path}/{tag}-{session.name}-tracker")
        return session


__all__ = ["PLANS", "AddRows", "SessionRegistry", "chat_session", "config_of", "document_session", "make_session", "retrieve", "tool_schema", "tool_session"]
