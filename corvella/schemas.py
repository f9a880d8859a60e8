"""The tables of the platform as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

METADATA_DDL = (
    "STRUCT<source: STRING, format: STRING, page: INT, content_type: STRING, bbox: ARRAY<DOUBLE>, reading_order: INT, table_index: INT, row_range: STRING, columns: ARRAY<STRING>, "
    "image_index: INT, vision_provider: STRING, vision_model: STRING, sheet_name: STRING, total_rows: INT, title: STRING, continuation: BOOLEAN>"
)
USERS = "user_id INT, user_api_key STRING, user_name STRING, is_active BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP"
PROJECTS = "id INT, project_id INT, project_uuid STRING, user_id INT, created_at TIMESTAMP, updated_at TIMESTAMP"
ASSETS = "asset_id INT, asset_uuid STRING, asset_type STRING, asset_name STRING, asset_size INT, asset_config STRING, asset_project_id INT, created_at TIMESTAMP, updated_at TIMESTAMP"
CHUNKS = f"chunk_id INT, chunk_uuid STRING, chunk_text STRING, chunk_metadata {METADATA_DDL}, chunk_order INT, chunk_project_id INT, chunk_asset_id INT, created_at TIMESTAMP, updated_at TIMESTAMP"
LEDGER = "execution_id BIGINT, task_name STRING, task_args_hash STRING, worker_task_id STRING, status STRING, task_args STRING, result STRING, started_at TIMESTAMP, completed_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"
COLLECTION = f"id BIGINT, project_key INT, dim INT, text STRING, vector ARRAY<FLOAT>, metadata {METADATA_DDL}, chunk_id INT"
ELEMENTS = "file_id STRING, page INT, elem_id INT, page_w DOUBLE, page_h DOUBLE, content_type STRING, bbox STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>, text STRING, table_index INT, image_index INT, xref INT, n_bytes INT"
RAW_TABLES = "file_id STRING, page INT, table_index INT, header ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>"

ASSET_TYPES = ("file", "url", "structured_data")
TASK_STATES = ("PENDING", "STARTED", "RETRY", "SUCCESS", "FAILURE")


def parsed(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
