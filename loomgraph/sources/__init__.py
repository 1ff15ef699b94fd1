"""Readers and writers of subjects."""

from .arrow_files import ArrowFiles, scan_arrow, write_arrow
from .readers import read_csv, read_csv_text, read_ipc_file, read_ipc_stream, read_json_lines, read_json_values, read_parquet, read_record_batches
from .writers import to_csv_text, to_ipc_stream, to_json_bytes, to_json_lines, to_json_objects, write_csv, write_ipc_file, write_parquet

__all__ = [x for x in dir() if x.startswith(("read_", "write_", "to_"))]
