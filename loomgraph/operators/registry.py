"""Operators by name, their JSON tool schemas, and calls of them by configuration."""

import json
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import read_json_values
from ..subjects import first_batch, with_batches
from .chunking import chunk_documents
from .relational import join_inner, sort_scores
from .similarity import similarity_scores

#: Names and descriptions that models are told.
SIMILARITY, SORT, CHUNK, JOIN, ASK = "relative-similarity-score", "sort-scores-and-indices", "chunk-documents", "join-inner", "human-in-the-loop"
_SAYS = {
    SIMILARITY: "Compute the relative similarity score between two different lists of embedding vectors",
    SORT: "Sort the the list of computed scores in ascending order",
    CHUNK: "Chunk documents by splitting the document text",
    JOIN: "Join two tables on their foreign keys",
    ASK: "Ask a question to clarify the user's query, ask a questionn to get additional information that the user did not provide, confirm a choice of tool, confirm arguments for a tool before answering the user's query or calling a tool, or provide the answer to the user's query.",
}
_ARGUMENTS = {
    "lhs_name": "The name of the left hand side table",
    "lhs_pk": "The primary key column identifier for the left hand side table",
    "lhs_values": "The values column identifier for the left hand side table",
}
_ANSWER = 'The question or answer for the user. Format lhs_arg value as JSON according to the schema {"role": "assistant", "content": "`RESPONSE`"} where `RESPONSE` is where you put your question or answer for the user'


#: The names of the fields, which tool calls and config tables use.
@dataclass
class OperatorConfig:
    """What an operator is called with; a one-row subject or a tool call's arguments."""

    lhs_name: str = "lhs_name"
    rhs_name: str | None = None
    lhs_pk: str = "lhs_pk"
    rhs_pk: str | None = None
    lhs_fk: str = "lhs_fk"
    rhs_fk: str | None = None
    lhs_values: str = "lhs_values"
    rhs_values: str | None = None
    lhs_args: str | None = None
    rhs_args: str | None = None
    op_kwargs: str | None = None
    stream: str = "stream-lhs-stream-rhs"
    which: str = SIMILARITY
    cpu: bool = False

    @classmethod
    def of(cls, values: dict) -> "OperatorConfig":
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known and v is not None})

    @classmethod
    def from_tool_call(cls, values: str) -> "OperatorConfig":
        """From {"name", "arguments"}: the arguments, ``which`` being the name."""
        call = json.loads(values)
        return cls.of(call.get("arguments", {}) | {"which": call["name"]})

    @property
    def kwargs(self) -> dict:
        return json.loads(self.op_kwargs) if self.op_kwargs else {}


def _similarity(c: OperatorConfig, lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    return similarity_scores(lhs, rhs, c.lhs_pk, c.rhs_pk, c.lhs_values, c.rhs_values)


def _sort(c: OperatorConfig, lhs: DataFrame, rhs: DataFrame | None) -> DataFrame:
    return sort_scores(lhs, c.lhs_values, c.lhs_pk, **c.kwargs)


def _chunk(c: OperatorConfig, lhs: DataFrame, rhs: DataFrame | None) -> DataFrame:
    return chunk_documents(lhs, c.lhs_pk, c.lhs_values, **c.kwargs)


def _join(c: OperatorConfig, lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    return join_inner(lhs, rhs, c.lhs_fk, c.rhs_fk, **c.kwargs)


def _ask(c: OperatorConfig, lhs: DataFrame, rhs: DataFrame | None) -> DataFrame:
    return first_batch(with_batches(lhs))


OPERATORS = {SIMILARITY: _similarity, SORT: _sort, CHUNK: _chunk, JOIN: _join, ASK: _ask}
_BINARY = {SIMILARITY: ("rhs_pk", "rhs_values"), JOIN: ("rhs_fk",)}


def dispatch(config: OperatorConfig, lhs: DataFrame | None, rhs: DataFrame | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Run the configured operator; inline arguments stand in for a missing side. Missing columns raise."""
    if config.which not in OPERATORS:
        raise ValueError(f"There is no operator {config.which!r}.")
    if lhs is None and config.lhs_args and spark is not None:
        lhs = _inline(spark, config.lhs_args)
    if rhs is None and config.rhs_args and spark is not None:
        rhs = _inline(spark, config.rhs_args)
    if lhs is None or config.which in _BINARY and rhs is None:
        raise ValueError(f"{config.which} lacks a table.")
    needed = {SIMILARITY: ("lhs_pk", "lhs_values"), SORT: ("lhs_values",), CHUNK: ("lhs_pk", "lhs_values"), JOIN: ("lhs_fk",), ASK: ()}
    for side, names in ((lhs, needed[config.which]), (rhs, _BINARY.get(config.which, ()))):
        for name in names:
            if getattr(config, name) not in side.columns:
                raise ValueError(f"{config.which}: {name} {getattr(config, name)!r} is not among {side.columns}.")
    return OPERATORS[config.which](config, lhs, rhs)


def _inline(spark: SparkSession, args: str) -> DataFrame:
    found = json.loads(args)
    found = found if isinstance(found, list) else [found]
    kinds = {str: "string", bool: "boolean", int: "long", float: "double"}
    types: dict[str, set[str]] = {}
    for one in found:
        for k, v in one.items():
            types.setdefault(k, set()).update(() if v is None else [kinds.get(type(v), "array<double>")])
    wide = lambda t: next(iter(t)) if len(t) == 1 else "double" if t == {"long", "double"} else "string"
    values = [{k: str(one[k]) if one.get(k) is not None and wide(t) == "string" else one.get(k) for k, t in types.items()} for one in found]
    return read_json_values(spark, values, ", ".join(f"`{k}` {wide(t)}" for k, t in types.items()))


def tool_schema(name: str) -> str | None:
    """The JSON function schema that a model is told; None for unknown names."""
    if name not in _SAYS:
        return None
    told = {"lhs_args": _ANSWER} if name == ASK else _ARGUMENTS
    properties = {k: {"type": "string", "description": v} for k, v in told.items()}
    return json.dumps({"type": "function", "function": {"name": name, "description": _SAYS[name], "parameters": {"type": "object", "properties": properties, "required": list(told)}}})


def tool_catalog(spark: SparkSession, names: list[str]) -> DataFrame | None:
    """(tool_id, tool) of the known names; None if there is none."""
    rows = [(n, tool_schema(n)) for n in names if n in _SAYS]
    return spark.createDataFrame(rows, "tool_id string, tool string") if rows else None
