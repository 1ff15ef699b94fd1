"""Chat messages: folds, prompts, summaries, tool calls and routes."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import GENERATION_PROMPT, chat_line, clean_tool_calls, message_role, render_template, timestamp_now
from ..subjects import BATCH, HIDDEN, ROW, visible, with_batches

PARSER = "message_parser_processor"
SYSTEM = "You are a helpful assistant."
_CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"


def has_message_columns(df: DataFrame) -> bool:
    return {"role", "content", "timestamp"} <= set(df.columns)


def ordered_text(column: str, order: list[str], sep: str = "") -> Column:
    """All values of a group in order, joined."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(column).alias("_text"))))
    return F.array_join(F.transform(items, lambda x: x["_text"]), sep)


def extend_chunks(df: DataFrame, column: str, order: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """One row (per ``keys``): the column's values in order as one text, the first row's other columns."""
    order = order or list(HIDDEN)
    df = with_batches(df) if order == list(HIDDEN) else df
    keys = keys or []
    place = F.struct(*order)
    others = [c for c in df.columns if c not in (column, *order, *keys, *HIDDEN)]
    out = df.groupBy(*keys).agg(ordered_text(column, order).alias(column), *[F.min_by(c, place).alias(c) for c in others], F.count(F.lit(1)).alias("_n")).where("_n > 0")
    return out.select(*[c for c in df.columns if c in (*keys, column, *others)])


def fold_chat(df: DataFrame, order: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """A chat response's pieces as one message: contents joined, first role and time."""
    return extend_chunks(df, "content", order, keys)


def prepare_messages(history: DataFrame | None, query: DataFrame, system: str = SYSTEM, order: list[str] | None = None, keys: list[str] | None = None, **values: Column) -> DataFrame:
    """(keys ..., turn, role, content): per ``keys`` the history, or else a system message from a template, then the user's queries (content).

    ``turn`` numbers the rows of a key from 0, so nothing rests on the order in which a table is read: first the history by ``order``, without it by its
    batches and rows, then the queries by theirs. Nulls stay. A key is one conversation, of a prompt's length; keys without a query are not asked for, and give no rows.
    """
    keys = keys or []
    spark = query.sparkSession
    asked = query.select(*keys).distinct() if keys else spark.range(1).select()
    if history is None:
        history, order = asked.select(*keys, F.lit("system").alias("role"), render_template(system, **values).alias("content"), F.lit(0).alias("_first")), ["_first"]
    elif keys:
        history = history.join(asked, keys, "left_semi")

    def placed(df: DataFrame, part: int, by: list[str] | None, role: Column) -> DataFrame:
        df = df if by else with_batches(df)
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*(by or HIDDEN)))
        return df.select(*keys, F.lit(part).alias("_part"), nth.alias("_nth"), role.alias("role"), "content")

    rows = placed(history, 0, order, F.col("role")).unionByName(placed(query, 1, None, F.lit("user")))
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("_part", "_nth")) - 1
    return rows.withColumn("turn", turn.cast("long")).select(*keys, "turn", "role", "content").orderBy(*keys, "turn")


def prompt(df: DataFrame, order: list[str], keys: list[str] | None = None, generate: bool = False, tools: list[str] | None = None, documents: DataFrame | None = None) -> DataFrame:
    """The chat template over all rows (per ``keys``) in order, as ``prompt``.

    ``tools``, JSON schemas, and ``documents`` (text, in their own order; a small table) stand before the
    messages, each as a system message of its own.
    """
    lines = df.withColumn("_line", chat_line(F.col("role"), F.col("content")))
    text = ordered_text("_line", order)
    text = F.concat(text, F.lit(GENERATION_PROMPT)) if generate else text
    made = lines.groupBy(*(keys or [])).agg(text.alias("prompt"))
    if documents is not None:
        held = with_batches(documents).agg(ordered_text("text", list(HIDDEN), "\n").alias("_documents"))
        said = chat_line(F.lit("system"), F.concat(F.lit("<documents>\n"), F.col("_documents"), F.lit("\n</documents>")))
        made = made.crossJoin(F.broadcast(held)).withColumn("prompt", F.concat(said, "prompt")).drop("_documents")
    if tools:
        said = chat_line(F.lit("system"), F.lit("<tools>\n" + "\n".join(tools) + "\n</tools>"))
        made = made.withColumn("prompt", F.concat(said, "prompt"))
    return made


def chat_request(df: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys ..., request): the messages in order as a JSON list of {"role", "content"}, with the roles that chat services know."""
    one = F.to_json(F.struct(message_role(F.col("role")).alias("role"), F.coalesce("content", F.lit("")).alias("content")))
    return df.withColumn("_json", one).groupBy(*(keys or [])).agg(F.concat(F.lit("["), ordered_text("_json", order, ","), F.lit("]")).alias("request"))


def summarize(df: DataFrame, columns: list[str] | None = None, rows: int | None = None, legacy_stride: bool = False, order: list[str] | None = None, stamp: Column | None = None) -> DataFrame:
    """One ``tool`` message whose content is the first rows as a JSON list of objects, keys sorted, nulls left out.

    ``legacy_stride`` takes every second row, as many. Only the rows kept are gathered.
    """
    order = order or [c for c in HIDDEN if c in df.columns]
    df = df if order else with_batches(df)
    order = order or list(HIDDEN)
    names = sorted(c for c in df.columns if c not in HIDDEN and (columns is None or c in columns))
    if rows is not None and legacy_stride:
        kept = df.orderBy(*order).limit(2 * rows).select(*order, *[c for c in names if c not in order])
        nth = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct(*names)).alias("_json")))), lambda x: x["_json"])
        content = F.filter(nth, lambda _, i: i % 2 == 0)
    else:
        kept = df if rows is None else df.orderBy(*order).limit(rows)
        content = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct(*names)).alias("_json")))), lambda x: x["_json"])
    text = F.concat(F.lit("["), F.array_join(content, ","), F.lit("]"))
    return kept.agg(text.alias("content")).select(F.lit("tool").alias("role"), "content", (timestamp_now() if stamp is None else stamp).alias("timestamp"))


def _sorted_json(value: Column) -> Column:
    """JSON with its keys sorted at all levels."""
    return F.to_json(F.parse_json(value))


def parse_tool_calls(df: DataFrame, order: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys ..., name, publisher, subject, values) of every tool call in the joined content.

    A JSON list of service calls, whose arguments are text, comes first; then the cleaned text of
    local models as a list of objects. What is neither gives its message back as one row with
    null name and subject and the content as values. ``values`` is {"arguments", "name"} with sorted keys.
    """
    joined = fold_chat(df, order, keys)
    keys = keys or []
    service = F.from_json("content", _CALLS, {"mode": "PERMISSIVE"})
    whole = F.size(F.coalesce(service, F.array().cast(_CALLS))) > 0
    service = F.when(whole & F.forall(service, lambda c: c["function"]["name"].isNotNull() & c["function"]["arguments"].isNotNull()), service)
    cleaned = clean_tool_calls(F.col("content"))
    local = F.when(F.schema_of_variant(F.try_parse_json(cleaned)).like("ARRAY%"), F.from_json(cleaned, "array<string>"))
    local = F.when(F.size(local) > 0, F.when(F.forall(local, lambda c: F.get_json_object(c, "$.name").isNotNull()), local))
    calls = F.coalesce(
        F.transform(service, lambda c: F.struct(c["function"]["name"].alias("name"), F.concat(F.lit('{"arguments":'), _sorted_json(c["function"]["arguments"]), F.lit(',"name":'), F.to_json(F.struct(c["function"]["name"].alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c["function"]["name"].alias("x")))) - 6), F.lit("}")).alias("values"))),
        F.transform(local, lambda c: F.struct(F.get_json_object(c, "$.name").alias("name"), _sorted_json(c).alias("values"))),
        F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("content").alias("values"))),
    )
    rows = joined.select(*keys, F.posexplode(calls).alias("_nth", "_call"))
    return rows.select(*keys, F.col("_nth").cast("long").alias(ROW), F.col("_call.name").alias("name"), F.lit(PARSER).alias("publisher"), F.col("_call.name").alias("subject"), F.col("_call.values").alias("values"))


def route_messages(df: DataFrame) -> DataFrame:
    """Rows (name, publisher, subject, values) as messages (name, subject, values): ``from_publisher_on_subject``; of one name the last row counts."""
    df = with_batches(df)
    place = F.struct(BATCH, ROW)
    last = df.groupBy("name").agg(F.max_by(F.struct("publisher", "subject", "values"), place).alias("x"))
    return last.select(F.concat(F.lit("from_"), F.col("x.publisher"), F.lit("_on_"), F.col("x.subject")).alias("name"), "x.subject", "x.values")
