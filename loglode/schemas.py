"""Explicit schemas of the stored tables and documents."""

from __future__ import annotations

ERROR_MESSAGE = "STRUCT<message: STRING, log_level: STRING, source_type: STRING>"
POSTING = "STRUCT<chunk_id: STRING, original_message: STRING, log_level: STRING, source_type: STRING>"
CHUNK = (
    "STRUCT<chunk_id: STRING, file_path: STRING, function_name: STRING, class_name: STRING, line_start: INT, "
    "line_end: INT, signature: STRING, code: STRING, docstring: STRING, leading_comment: STRING, "
    f"error_messages: ARRAY<{ERROR_MESSAGE}>, log_levels: ARRAY<STRING>>"
)
STATS = (
    "STRUCT<files_processed: BIGINT, files_failed: BIGINT, functions_found: BIGINT, errors_found: BIGINT, "
    "start_time: DOUBLE, elapsed_seconds: DOUBLE>"
)
INDEX_DOCUMENT = (
    "STRUCT<schema_version: STRING, created_at: STRING, "
    f"chunks: ARRAY<{CHUNK}>, error_index: MAP<STRING, ARRAY<{POSTING}>>, stats: {STATS}, "
    "total_chunks: BIGINT, total_errors: BIGINT>"
)
FILES = "machine_id STRING, version_id STRING, path STRING, length BIGINT, is_symlink BOOLEAN, content BINARY"
MACHINES = (
    "id STRING, display_name STRING, printer_model STRING, printing_type STRING, created_at TIMESTAMP_NTZ, "
    "updated_at TIMESTAMP_NTZ, active_version_id STRING"
)
VERSIONS = (
    "id STRING, machine_id STRING, created_at TIMESTAMP_NTZ, indexed_at TIMESTAMP_NTZ, schema_version STRING, "
    "gcs_bucket STRING, gcs_object STRING, file_sha256 STRING, total_chunks INT, total_errors INT, "
    "stats_json STRING, is_active BOOLEAN"
)
REGISTRY_EVENTS = "machine_id STRING, version_id STRING, op STRING, ts TIMESTAMP_NTZ"
MANIFEST_ENTRY = "path STRING, type STRING, size BIGINT, sha256 STRING, link_target STRING, error STRING"
