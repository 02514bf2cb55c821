"""The tables of a store, as Spark schemas. Ids are strings; times are ISO texts, compared as texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

VERSION = 1

_TABLES = {
    "harnesses": "id string, name string, version string, display_name string, source string, log_format string",
    "models": "id string, raw_name string, name string, creator string, family string, version string, variant string, released string",
    "providers": "id string, name string, display_name string, billing_model string",
    "tools": "id string, name string, category string, description string",
    "tool_aliases": "id string, raw_name string, harness_id string, tool_id string",
    "pricing": "id string, model_id string, provider_id string, input_per_mtok double, output_per_mtok double",
    "workspaces": "id string, path string, git_remote string, discovered_at string",
    "conversations": "id string, external_id string, harness_id string, workspace_id string, branch string, started_at string, ended_at string",
    "prompts": "id string, conversation_id string, external_id string, timestamp string",
    "responses": "id string, conversation_id string, prompt_id string, model_id string, provider_id string, external_id string, timestamp string, input_tokens bigint, output_tokens bigint",
    "tool_calls": "id string, response_id string, conversation_id string, tool_id string, external_id string, input string, result string, result_hash string, status string, timestamp string",
    "prompt_content": "id string, prompt_id string, block_index int, block_type string, content string",
    "response_content": "id string, response_id string, block_index int, block_type string, content string",
    "conversation_attributes": "id string, conversation_id string, key string, value string, scope string",
    "prompt_attributes": "id string, prompt_id string, key string, value string, scope string",
    "response_attributes": "id string, response_id string, key string, value string, scope string",
    "tool_call_attributes": "id string, tool_call_id string, key string, value string, scope string",
    "tags": "id string, name string, description string, created_at string",
    "workspace_tags": "id string, workspace_id string, tag_id string, applied_at string",
    "conversation_tags": "id string, conversation_id string, tag_id string, applied_at string",
    "tool_call_tags": "id string, tool_call_id string, tag_id string, applied_at string",
    "prompt_tags": "id string, prompt_id string, tag_id string, applied_at string",
    "ingested_files": "id string, path string, file_hash string, harness_id string, conversation_id string, ingested_at string, error string",
    "content_blobs": "hash string, content string, ref_count bigint, created_at string",
    "active_sessions": "harness_session_id string, adapter_name string, workspace_path string, started_at string, last_seen_at string",
    "pending_tags": "id string, harness_session_id string, tag_name string, entity_type string, exchange_index int, created_at string",
    "chunks": "id string, conversation_id string, chunk_type string, text string, embedding array<float>, token_count int, source_ids array<string>, created_at string",
    "index_meta": "key string, value string",
}

#: The natural key of a table: two rows that agree in it are one.
KEYS = {
    "harnesses": ["name"], "models": ["raw_name"], "providers": ["name"], "tools": ["name"], "tool_aliases": ["raw_name", "harness_id"], "pricing": ["model_id", "provider_id"],
    "workspaces": ["path"], "conversations": ["harness_id", "external_id"], "prompts": ["conversation_id", "external_id"], "responses": ["conversation_id", "external_id"],
    "prompt_content": ["prompt_id", "block_index"], "response_content": ["response_id", "block_index"], "tags": ["name"], "ingested_files": ["path"], "content_blobs": ["hash"],
    "workspace_tags": ["workspace_id", "tag_id"], "conversation_tags": ["conversation_id", "tag_id"], "tool_call_tags": ["tool_call_id", "tag_id"], "prompt_tags": ["prompt_id", "tag_id"],
    "active_sessions": ["harness_session_id"], "pending_tags": ["harness_session_id", "tag_name", "entity_type", "exchange_index"], "index_meta": ["key"],
}

#: Children by parent: (table, column) pairs that go with a deleted row.
CHILDREN = {
    "conversations": [("prompts", "conversation_id"), ("responses", "conversation_id"), ("tool_calls", "conversation_id"), ("conversation_attributes", "conversation_id"), ("conversation_tags", "conversation_id"), ("chunks", "conversation_id")],
    "prompts": [("prompt_content", "prompt_id"), ("prompt_attributes", "prompt_id"), ("prompt_tags", "prompt_id")],
    "responses": [("response_content", "response_id"), ("response_attributes", "response_id")],
    "tool_calls": [("tool_call_attributes", "tool_call_id"), ("tool_call_tags", "tool_call_id")],
    "tags": [("workspace_tags", "tag_id"), ("conversation_tags", "tag_id"), ("tool_call_tags", "tag_id"), ("prompt_tags", "tag_id")],
}

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "array<float>": T.ArrayType(T.FloatType()), "array<string>": T.ArrayType(T.StringType())}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split(" ") for c in columns.split(", "))])


SCHEMAS: dict[str, T.StructType] = {name: _schema(columns) for name, columns in _TABLES.items()}

Store = dict[str, DataFrame]


def empty_store(spark: SparkSession) -> Store:
    """SNK-09: all tables, without rows."""
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def read_store(spark: SparkSession, path: str, tables: list[str] | None = None) -> Store:
    """SRC-13: the tables of a store under path, read lazily and never inferred."""
    return {name: spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}") for name in tables or SCHEMAS}


def write_store(store: Store, path: str) -> None:
    """A new snapshot. A snapshot is never written over one that is being read."""
    for name, table in store.items():
        table.select(*SCHEMAS[name].names).write.parquet(f"{path}/{name}")


def conform(table: DataFrame, name: str) -> DataFrame:
    """SNK-09: table with the columns and types of this version; columns that an older one lacks are null."""
    from pyspark.sql import functions as F

    return table.select(*((F.col(f.name) if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]))


def has_table(store: Store, name: str) -> bool:
    """FLT-25: whether a store has a table that it may lack."""
    return name in store
