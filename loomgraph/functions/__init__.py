"""Scalar functions, all columns in and out."""

from .text import between_markers, chat_line, chat_template, clean_tool_calls, human_size, keep_last, message_role, render_template, timestamp_now, timestamp_text, wrap_list
from .vectors import cosine, dot, norm, unit

__all__ = ["between_markers", "chat_line", "chat_template", "clean_tool_calls", "cosine", "dot", "human_size", "keep_last", "message_role", "norm", "render_template", "timestamp_now", "timestamp_text", "unit", "wrap_list"]
