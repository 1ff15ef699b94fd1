"""Operators: pure functions of DataFrames."""

from .aggregates import estimate_counts, grouping_distinct, merge_sketches, sketches
from .bloom import bloom_anti_join, bloom_semi_join, build_bloom
from .chunking import chunk_documents
from .intervals import interval_join
from .messages import chat_request, extend_chunks, fold_chat, has_message_columns, parse_tool_calls, prepare_messages, prompt, route_messages, summarize
from .ordered import asof_join, running, sessions
from .registry import OPERATORS, OperatorConfig, dispatch, tool_catalog, tool_schema
from .relational import (
    assert_not_null,
    collect_partitions,
    columns_of_types,
    distinct_sorted,
    fields_in_schemas,
    filter_contains,
    filter_equal,
    filter_in,
    join_inner,
    join_tables,
    limit_offset,
    null_counts,
    project,
    sort_scores,
    top_k,
    union_tables,
)
from .similarity import rank_pairs, score_pairs, similarity_scores, top_k_similar
from .text_index import RankedIndex, SubstringIndex
from .vector_index import VectorIndex

__all__ = [x for x in dir() if not x.startswith("_")]
