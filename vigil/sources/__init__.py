"""Sources S1-S9 as DataFrames and the outbox sink S10."""

from vigil.sources.documents import json_documents, json_field, parse_documents
from vigil.sources.files import (commented_csv, file_listing, line_export, ndjson_export, parsed_lines,
                                 snapshot_diff, table_files, with_row_order)
from vigil.sources.offsets import kafka_end_offsets, offsets_from_log
from vigil.sources.runs import runs_frame, runs_from_event_log, runs_from_json
from vigil.sources.sinks import outbox_batch_writer, write_outbox, write_results
from vigil.sources.tables import jdbc_source, parquet_table, register_views, table_source

__all__ = [
    "jdbc_source", "table_source", "parquet_table", "register_views", "file_listing", "line_export", "ndjson_export",
    "parsed_lines", "with_row_order", "commented_csv", "json_documents", "json_field", "parse_documents", "offsets_from_log",
    "kafka_end_offsets", "runs_frame", "runs_from_json", "runs_from_event_log", "table_files", "snapshot_diff", "write_outbox", "write_results", "outbox_batch_writer",
]
