"""Structured Streaming forms of the operators and of sessions."""

from .adapters import similarity_stream, superstep_stream, windowed_counts
from .stateful import dedup_stream, run_stream, session_stream, use_rocks

__all__ = ["dedup_stream", "run_stream", "session_stream", "similarity_stream", "superstep_stream", "use_rocks", "windowed_counts"]
