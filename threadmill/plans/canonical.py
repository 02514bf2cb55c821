"""The driver's tables seen as a store: the same projection twice, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.schema import Store

#: Shell commands that stand in for what events don't have; an event takes the one at event_id mod their number.
COMMANDS = ["git status", "git add .", "git log -3", "cd /x && git diff", "git push", "pytest -q", "uv run pytest", "ruff check", "ls -la", "cat a | head", "grep x y", "docker ps", "python run.py", "npm test", "uv pip list", "curl http://h", "gh pr list", "yadm status", "echo hi", "foo bar"]

#: Added to the label of some vectors: chunks of conversations that don't exist. Likewise no conversation is in a workspace whose number ends in 9.
ORPHAN = 1 << 40

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _iso(c: str) -> Column:
    return F.date_format(c, ISO)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def store(spark: SparkSession, sf_dir: str) -> Store:
    t = lambda name: read(spark, sf_dir, name)
    lines = t("lineitem")
    line_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    command = F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("event_id") % len(COMMANDS) + 1).cast("int"))
    conversations = t("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("external_id"), F.col("o_orderpriority").alias("harness_id"), (F.col("o_custkey") - (F.col("o_custkey") % 10 == 9).cast("long")).alias("workspace_id"), F.col("o_orderstatus").alias("branch"), _iso("o_orderdate").alias("started_at"))
    statuses = t("orders").select(F.col("o_orderkey").alias("conversation_id"), F.concat(F.lit("status:"), F.col("o_orderstatus")).alias("tag_id"))
    classes = t("orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("conversation_id"), F.concat(F.lit("prio:"), F.substring("o_orderpriority", 1, 1)).alias("tag_id"))
    segments = t("customer").select(F.col("c_custkey").alias("workspace_id"), F.concat(F.lit("segment:"), F.col("c_mktsegment")).alias("tag_id"))
    kind = F.when(F.col("event_type") == "click", "vcs").when(F.col("event_type") == "view", "test").otherwise("file")
    call_tags = t("events").select(F.col("event_id").alias("tool_call_id"), F.concat(F.lit("shell:"), kind).alias("tag_id"))
    names = statuses.select("tag_id").union(classes.select("tag_id")).union(segments.select("tag_id")).union(call_tags.select("tag_id")).distinct()
    return {
        "harnesses": t("orders").select(F.col("o_orderpriority").alias("id"), F.col("o_orderpriority").alias("name")).distinct(),
        "workspaces": t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("path"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("host/"), F.lower("c_mktsegment"), F.lit("/"), (F.col("c_custkey") % 40).cast("string"))).alias("git_remote")),
        "conversations": conversations,
        "responses": lines.select(line_id.alias("id"), F.col("l_orderkey").alias("conversation_id"), F.col("l_partkey").alias("model_id"), F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey")).alias("provider_id"), _iso("l_shipdate").alias("timestamp"), F.when(F.col("l_linenumber") != 3, (F.col("l_quantity") * 100).cast("long")).alias("input_tokens"), F.floor("l_extendedprice").cast("long").alias("output_tokens")),
        "prompts": lines.where("l_returnflag = 'R'").select(line_id.alias("id"), F.col("l_orderkey").alias("conversation_id"), _iso("l_shipdate").alias("timestamp")),
        "models": t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("raw_name"), F.col("p_brand").alias("name")),
        "providers": t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        "pricing": lines.where("(l_partkey + l_suppkey) % 3 <> 0").select(F.col("l_partkey").alias("model_id"), F.col("l_suppkey").alias("provider_id")).distinct().join(t("part").select(F.col("p_partkey").alias("model_id"), (F.col("p_retailprice") / 100).alias("input_per_mtok"), (F.col("p_retailprice") / 20).alias("output_per_mtok")), "model_id"),
        "tools": t("events").select(F.col("event_type").alias("id"), F.col("event_type").alias("name"), F.substring("event_type", 1, 1).alias("category")).distinct(),
        "tool_calls": t("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("conversation_id"), F.col("event_type").alias("tool_id"), F.concat(F.lit('{"command":"'), command, F.lit('"}')).alias("input"), F.col("props").alias("result"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), F.date_format("ts", ISO).alias("timestamp")),
        "tags": names.select(F.col("tag_id").alias("id"), F.col("tag_id").alias("name"), F.lit(None).cast("string").alias("description")),
        "conversation_tags": statuses.union(classes),
        "workspace_tags": segments,
        "tool_call_tags": call_tags,
        "prompt_tags": statuses.limit(0).select(F.col("conversation_id").alias("prompt_id"), "tag_id"),
        "ingested_files": t("pages").select(F.col("url").alias("path"), F.sha2("html", 256).alias("file_hash"), F.element_at(F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])), (F.col("page_id") % 4 + 1).cast("int")).alias("harness_id"), F.col("page_id").alias("conversation_id"), F.when(F.col("page_id") % 50 == 7, "broken").alias("error")),
        "chunks": chunks(spark, sf_dir),
    }


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("chunk_id"), (F.col("label") + F.when(F.col("vec_id") % 25 == 13, ORPHAN).otherwise(0)).cast("long").alias("conversation_id"), F.concat(F.lit("chunk "), F.col("vec_id")).alias("text"), "embedding", F.array(F.col("vec_id")).alias("source_ids"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")


_ISO_SQL = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
_LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_LIST = "[" + ", ".join("'" + c + "'" for c in COMMANDS) + "]"

SQL = {
    "c_harnesses": "SELECT DISTINCT o_orderpriority AS id, o_orderpriority AS name FROM orders",
    "c_workspaces": "SELECT c_custkey AS id, c_name AS path, CASE WHEN c_custkey % 5 <> 0 THEN 'host/' || lower(c_mktsegment) || '/' || CAST(c_custkey % 40 AS VARCHAR) END AS git_remote FROM customer",
    "c_conversations": f"SELECT o_orderkey AS id, 'o' || o_orderkey AS external_id, o_orderpriority AS harness_id, o_custkey - CASE WHEN o_custkey % 10 = 9 THEN 1 ELSE 0 END AS workspace_id, o_orderstatus AS branch, {_ISO_SQL.format('o_orderdate')} AS started_at FROM orders",
    "c_responses": f"SELECT {_LINE_ID} AS id, l_orderkey AS conversation_id, l_partkey AS model_id, CASE WHEN l_suppkey % 10 <> 0 THEN l_suppkey END AS provider_id, {_ISO_SQL.format('l_shipdate')} AS timestamp, CASE WHEN l_linenumber <> 3 THEN CAST(trunc(l_quantity * 100) AS BIGINT) END AS input_tokens, CAST(floor(l_extendedprice) AS BIGINT) AS output_tokens FROM lineitem",
    "c_prompts": f"SELECT {_LINE_ID} AS id, l_orderkey AS conversation_id, {_ISO_SQL.format('l_shipdate')} AS timestamp FROM lineitem WHERE l_returnflag = 'R'",
    "c_models": "SELECT p_partkey AS id, p_name AS raw_name, p_brand AS name FROM part",
    "c_providers": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
    "c_pricing": "SELECT model_id, provider_id, p_retailprice / 100 AS input_per_mtok, p_retailprice / 20 AS output_per_mtok FROM (SELECT DISTINCT l_partkey AS model_id, l_suppkey AS provider_id FROM lineitem WHERE (l_partkey + l_suppkey) % 3 <> 0) JOIN part ON p_partkey = model_id",
    "c_tools": "SELECT DISTINCT event_type AS id, event_type AS name, substr(event_type, 1, 1) AS category FROM events",
    "c_tool_calls": f"SELECT event_id AS id, user_id AS conversation_id, event_type AS tool_id, '{{\"command\":\"' || {_LIST}[event_id % {len(COMMANDS)} + 1] || '\"}}' AS input, props AS result, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, {_ISO_SQL.format('ts')} AS timestamp FROM events",
    "c_conversation_tags": "SELECT o_orderkey AS conversation_id, 'status:' || o_orderstatus AS tag_id FROM orders UNION ALL SELECT o_orderkey, 'prio:' || substr(o_orderpriority, 1, 1) FROM orders WHERE o_orderkey % 2 = 0",
    "c_workspace_tags": "SELECT c_custkey AS workspace_id, 'segment:' || c_mktsegment AS tag_id FROM customer",
    "c_tool_call_tags": "SELECT event_id AS tool_call_id, 'shell:' || CASE event_type WHEN 'click' THEN 'vcs' WHEN 'view' THEN 'test' ELSE 'file' END AS tag_id FROM events",
    "c_tags": "SELECT DISTINCT tag_id AS id, tag_id AS name FROM (SELECT tag_id FROM c_conversation_tags UNION ALL SELECT tag_id FROM c_workspace_tags UNION ALL SELECT tag_id FROM c_tool_call_tags)",
    "c_files": "SELECT url AS path, sha256(html) AS file_hash, ['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'][page_id % 4 + 1] AS harness_id, page_id AS conversation_id, CASE WHEN page_id % 50 = 7 THEN 'broken' END AS error FROM pages",
    "c_chunks": f"SELECT vec_id AS chunk_id, CAST(label + CASE WHEN vec_id % 25 = 13 THEN {ORPHAN} ELSE 0 END AS BIGINT) AS conversation_id, 'chunk ' || vec_id AS text, embedding FROM embeddings",
}


def with_store(sql: str) -> str:
    """An oracle text over the store's tables, whose names begin with c_."""
    ctes = ", ".join(f"{name} AS ({text})" for name, text in SQL.items())
    return f"WITH {ctes}, {sql.strip()[5:]}" if sql.strip().startswith("WITH ") else f"WITH {ctes} {sql}"
