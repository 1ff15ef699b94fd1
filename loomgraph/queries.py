"""Queries over the test tables, one per operator, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as op
from .functions import chat_line, clean_tool_calls, message_role, norm
from .metrics import aggregate_metrics
from .operators.messages import ordered_text
from .query_base import ORACLE, QUERIES, query, table
from .sources import read_csv, write_csv
from .storage import shared_folder
from .subjects import assign_batches, first_batch, last_batch, visible

#: The query set of the searches: every row whose id is divisible by this.
EVERY = 50


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


_COSINE = "round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6)"
_CHUNKS = """SELECT doc_id || '_' || i AS chunk_id, doc_id, lang, source, n_chars, substr(text, (i * {step} + 1)::INT, {size}) AS text
FROM (SELECT *, unnest(generate_series(0, CASE WHEN length(text) <= {size} THEN 0 ELSE ceil((length(text) - {overlap}) / {step}.0)::INT - 1 END)) AS i FROM documents)"""


@query(_CHUNKS.format(size=512, overlap=64, step=448))
def chunk_documents(spark, sf_dir):
    return op.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(_CHUNKS.format(size=512, overlap=0, step=512))
def chunk_no_overlap(spark, sf_dir):
    return op.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text", 512, 0)


@query(f"SELECT q.vec_id AS query_id, e.vec_id, {_COSINE} AS score FROM embeddings q, embeddings e WHERE q.vec_id % {EVERY} = 0")
def cosine_similarity(spark, sf_dir):
    return op.score_pairs(_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), "query_id", "vec_id", "embedding", "embedding")


@query(f"SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 3) + 0.0 AS score FROM embeddings q, embeddings e WHERE q.vec_id % {EVERY} = 0")
def similarity_scores(spark, sf_dir):
    return op.similarity_scores(_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), "query_id", "vec_id", "embedding", "embedding", 3)


_RANKED = f"SELECT q.vec_id AS query_id, e.vec_id, {_COSINE} AS score FROM embeddings q, embeddings e WHERE q.vec_id % {EVERY} = 0"


@query(f"SELECT query_id, vec_id, score, row_number() OVER (ORDER BY score DESC, key) - 1 AS place FROM (SELECT *, query_id * 1000000000 + vec_id AS key FROM ({_RANKED}))")
def sort_scores(spark, sf_dir):
    return op.rank_pairs(_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), "query_id", "vec_id", "embedding", "embedding")


@query(f"SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM ({_RANKED}) QUALIFY rank <= 3")
def top_k_per_query(spark, sf_dir):
    return op.top_k_similar(_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), 3, "query_id", "vec_id", "embedding", "embedding")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length FROM embeddings")
def vector_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("length"))


@query("SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey, o_totalprice, c_custkey::VARCHAR AS c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), "o_totalprice")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name")
    return op.join_inner(orders, customers, "o_custkey", "c_custkey")


@query("""WITH l AS (SELECT coalesce(nullif(lang, 'de'), '') AS lang, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT doc_id, coalesce(nullif(lang, 'de'), '') AS lang FROM documents) SELECT l.lang, n, doc_id FROM l JOIN r ON l.lang = r.lang""")
def join_inner_null_default(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.col("lang"), F.lit("de")).alias("lang"))
    return op.join_inner(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), docs, "lang", "lang", null_mode="default")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 20 OFFSET 10")
def limit_offset(spark, sf_dir):
    return op.limit_offset(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").orderBy("event_id"), 10, 20)


@query("SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'user'")
def union_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return op.union_tables([op.filter_equal(rows, "role", "user"), rows.where("role <> 'user'")])


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id")
def extend_chunks(spark, sf_dir):
    return op.extend_chunks(table(spark, sf_dir, "conversations"), "text", ["turn"], ["conv_id"])


_JSON = """'{"event_type":"' || event_type || '","user_id":' || user_id || '}'"""


@query(f"SELECT event_id, {_JSON} AS json FROM events")
def summary_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("json"))


@query(f"SELECT 'tool' AS role, '[' || string_agg({_JSON}, ',' ORDER BY event_id) || ']' AS content, '' AS timestamp FROM (FROM events ORDER BY event_id LIMIT 3)")
def summary_top_rows(spark, sf_dir):
    return op.summarize(table(spark, sf_dir, "events"), ["user_id", "event_type"], 3, order=["event_id"], stamp=F.lit(""))


@query(f"SELECT 'tool' AS role, '[' || string_agg({_JSON}, ',' ORDER BY event_id) || ']' AS content, '' AS timestamp FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE n IN (1, 3, 5)")
def summary_legacy_stride(spark, sf_dir):
    return op.summarize(table(spark, sf_dir, "events"), ["user_id", "event_type"], 3, True, ["event_id"], F.lit(""))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def project_columns(spark, sf_dir):
    return op.project(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_orderkey", "l_linenumber", "unknown"])


@query("SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in ("doc_id", "text", "lang", "source", "n_chars")) + " FROM documents")
def not_null_check(spark, sf_dir):
    return op.null_counts(table(spark, sf_dir, "documents"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IS NOT NULL")
def not_null_passes(spark, sf_dir):
    return op.assert_not_null(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["event_id", "event_type"])


@query("SELECT event_id, props->>'$.k' AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT conv_id, turn::BIGINT AS call, 'f' || conv_id % 3 AS name, 'message_parser_processor' AS publisher, 'f' || conv_id % 3 AS subject,
'{"arguments":{"turn":' || turn || '},"name":"f' || conv_id % 3 || '"}' AS values FROM conversations""")
def tool_call_parse(spark, sf_dir):
    call = F.concat(F.when(F.col("turn") == 0, '<tool_call>\n{"name":"f').otherwise(', {"name":"f'), F.col("conv_id") % 3, F.lit('", "arguments":{"turn":'), F.col("turn"), F.lit("}}"))
    pieces = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("assistant").alias("role"), call.alias("content"))
    ends = pieces.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select("conv_id", "turn", F.lit("assistant").alias("role"), F.lit("\n</tool_call>").alias("content"))
    calls = op.parse_tool_calls(pieces.unionByName(ends), ["turn"], ["conv_id"])
    return calls.select("conv_id", F.col("_row_id").alias("call"), "name", "publisher", "subject", "values")


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN '[{"name":"f' || turn || '"}]' ELSE '[{"name":"f' || turn || '"},{"arguments":{}}]' END AS json FROM conversations""")
def tool_call_clean(spark, sf_dir):
    name = F.concat(F.lit('{"name":"f'), F.col("turn"), F.lit('"'))
    text = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("x<tool_call>\n"), name, F.lit("}\n</tool_call>y"))).otherwise(F.concat(F.lit('['), name, F.lit('},<|python_tag|>{"parameters":{}}]')))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", clean_tool_calls(text).alias("json"))


@query("SELECT 'from_' || arg_max(role, turn) || '_on_' || conv_id AS name, conv_id::VARCHAR AS subject, arg_max(text, turn) AS values FROM conversations GROUP BY conv_id")
def route_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return op.route_messages(rows.select(F.col("conv_id").cast("string").alias("name"), F.col("role").alias("publisher"), F.col("conv_id").cast("string").alias("subject"), F.col("text").alias("values"), F.lit(0).cast("long").alias("_batch_id"), F.col("turn").alias("_row_id")))


@query("""SELECT conv_id, turn, CASE r WHEN 'tool' THEN 'function' WHEN 'tool_call' THEN 'tool' WHEN 'function' THEN 'function' WHEN 'other' THEN 'user' ELSE r END AS role
FROM (SELECT *, CASE turn % 5 WHEN 1 THEN 'tool' WHEN 2 THEN 'tool_call' WHEN 3 THEN 'other' ELSE role END AS r FROM conversations)""")
def role_mapping(spark, sf_dir):
    role = F.when(F.col("turn") % 5 == 1, "tool").when(F.col("turn") % 5 == 2, "tool_call").when(F.col("turn") % 5 == 3, "other").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", message_role(role).alias("role"))


_SAID = "CASE WHEN conv_id % 7 = 0 AND turn % 2 = 1 THEN NULL ELSE text END"
_WHO = "CASE WHEN conv_id % 5 = 0 AND turn % 2 = 0 THEN NULL ELSE role END"
_LINE = f"'<|im_start|>' || coalesce({_WHO}, 'user') || chr(10) || coalesce({_SAID}, '') || '<|im_end|>' || chr(10)"


def _turns(spark, sf_dir):
    """Conversations some of whose turns have no role or no content."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_WHO).alias("role"), F.expr(_SAID).alias("content"))


@query(f"SELECT conv_id, string_agg({_LINE}, '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations GROUP BY conv_id")
def prompt_build(spark, sf_dir):
    return op.prompt(_turns(spark, sf_dir), ["turn"], ["conv_id"], generate=True)


@query(f"SELECT conv_id, turn, {_LINE} AS line FROM conversations")
def chat_lines(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", chat_line(F.col("role"), F.col("content")).alias("line"))


@query("SELECT DISTINCT source FROM documents")
def distinct_sorted(spark, sf_dir):
    return op.distinct_sorted(table(spark, sf_dir, "documents"), "source")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr') AND source IN ('src1', 'src2')")
def filter_rows(spark, sf_dir):
    return op.filter_in(table(spark, sf_dir, "documents"), lang=["de", "fr"], source=["src1", "src2"]).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE contains(text, 'the')")
def filter_substring(spark, sf_dir):
    return op.filter_contains(table(spark, sf_dir, "documents"), "text", "the").select("doc_id", "lang")


@query("""SELECT metric_name, CASE metric_name WHEN 'start_timestamp' THEN min(v) WHEN 'end_timestamp' THEN max(v) ELSE sum(v) END::BIGINT AS metric_value
FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'start_timestamp' WHEN 1 THEN 'end_timestamp' ELSE 'output_rows' END AS metric_name, event_id AS v FROM events) GROUP BY metric_name""")
def metrics_aggregate(spark, sf_dir):
    name = F.when(F.col("user_id") % 3 == 0, "start_timestamp").when(F.col("user_id") % 3 == 1, "end_timestamp").otherwise("output_rows")
    return aggregate_metrics(table(spark, sf_dir, "events").select(name.alias("metric_name"), F.col("event_id").alias("metric_value")))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.expr("event_id div 100").alias("_batch_id"), F.col("event_id").alias("_row_id"))


@query("SELECT event_id, event_type FROM events WHERE event_id // 100 = (SELECT max(event_id // 100) FROM events)")
def subscribe_last_batch(spark, sf_dir):
    return visible(last_batch(_events(spark, sf_dir)))


@query("SELECT event_id, event_type FROM events WHERE event_id // 100 = (SELECT min(event_id // 100) FROM events)")
def human_in_the_loop(spark, sf_dir):
    return visible(first_batch(_events(spark, sf_dir)))


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 300 AS batch FROM events")
def coalesce_batches(spark, sf_dir):
    return assign_batches(_events(spark, sf_dir), 300).select("event_id", F.col("_batch_id").alias("batch"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    nation, path = table(spark, sf_dir, "nation"), f"{shared_folder(spark)}/loomgraph/csv-{spark.sparkContext.applicationId}"
    write_csv(nation, path)
    return read_csv(spark, path, nation.schema, quote="'", null_value="NULL")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def row_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


_RAG = f"""WITH c AS (SELECT *, i AS nth FROM ({_CHUNKS.format(size=512, overlap=64, step=448).replace("SELECT doc_id ||", "SELECT i, doc_id ||")})),
s AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM ({_RANKED}) QUALIFY rank <= 3)
SELECT query_id, count(*) AS chunks, string_agg(chunk_id || ' ' || text, chr(10) ORDER BY rank, nth) AS content FROM s JOIN c ON c.doc_id = s.vec_id GROUP BY query_id"""


@query(_RAG)
def rag_pipeline(spark, sf_dir):
    """Retrieval: rank the documents' vectors against the queries, and join all chunks of the three best documents, with their texts."""
    chunks = op.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    best = op.top_k_similar(_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), 3, "query_id", "vec_id", "embedding", "embedding")
    found = op.join_inner(best.drop("score"), chunks, "vec_id", "doc_id")
    found = found.select("query_id", "rank", F.split_part("chunk_id", F.lit("_"), F.lit(-1)).cast("int").alias("nth"), F.concat_ws(" ", "chunk_id", "text").alias("said"))
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks"), ordered_text("said", ["rank", "nth"], "\n").alias("content"))


from . import scale_queries, state_queries  # noqa: E402, F401
