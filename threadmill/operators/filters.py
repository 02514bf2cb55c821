"""Predicates, id sets and lookups. Each takes and returns DataFrames; sets of ids are DataFrames with a column `id`.

Substring tests fold the case of letters, and `%` and `_` in what is asked for are wildcards, as in LIKE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions.scalars import all_of, any_of, json_text
from threadmill.schema import Store


def substring(c: Column, value: str) -> Column:
    return c.ilike(f"%{value}%")


def in_workspace(value: str) -> Column:
    """FLT-01: of a row with path and git_remote."""
    return substring(F.col("path"), value) | F.coalesce(substring(F.col("git_remote"), value), F.lit(False))


def of_model(value: str) -> Column:
    """FLT-02: of a row with raw_name and name."""
    return substring(F.col("raw_name"), value) | substring(F.col("name"), value)


def since(value: str) -> Column:
    """FLT-03: from this ISO text on."""
    return F.col("started_at") >= value


def before(value: str) -> Column:
    """FLT-03: earlier than this ISO text."""
    return F.col("started_at") < value


def where_all(table: DataFrame, *conditions: Column | None) -> DataFrame:
    """FLT-00: the rows that meet all conditions that are given."""
    given = [c for c in conditions if c is not None]
    return table.where(all_of(given)) if given else table


def tag_named(tag: str) -> Column:
    """FLT-07: a name, compared exactly; or with a colon at its end all that begins so, whatever the case."""
    return F.col("name").ilike(f"{tag}%") if tag.endswith(":") else F.col("name") == tag


def tagged(store: Store, tags: list[str], entity: str = "conversation") -> DataFrame:
    """JON-05: ids of entities with one of the tags."""
    names = store["tags"].where(any_of([tag_named(t) for t in tags])).select(F.col("id").alias("tag_id"))
    return store[f"{entity}_tags"].join(names, "tag_id", "left_semi").select(F.col(f"{entity}_id").alias("id")).distinct()


def with_any_tag(rows: DataFrame, store: Store, tags: list[str], key: str = "id") -> DataFrame:
    """FLT-04, JON-06: semi join."""
    return rows.join(tagged(store, tags).withColumnRenamed("id", key), key, "left_semi") if tags else rows


def with_all_tags(rows: DataFrame, store: Store, tags: list[str], key: str = "id") -> DataFrame:
    """FLT-05: one semi join a tag."""
    for tag in tags:
        rows = with_any_tag(rows, store, [tag], key)
    return rows


def without_tags(rows: DataFrame, store: Store, tags: list[str], key: str = "id") -> DataFrame:
    """FLT-06, FLT-15, JON-07: anti join."""
    return rows.join(tagged(store, tags).withColumnRenamed("id", key), key, "left_anti") if tags else rows


def using_tool(rows: DataFrame, store: Store, tool: str, key: str = "id") -> DataFrame:
    """FLT-08: conversations that called the tool."""
    ids = store["tool_calls"].join(store["tools"].where(F.col("name") == tool).select(F.col("id").alias("tool_id")), "tool_id", "left_semi").select(F.col("conversation_id").alias(key))
    return rows.join(ids, key, "left_semi")


def using_tool_tag(rows: DataFrame, store: Store, tag: str, key: str = "id") -> DataFrame:
    """FLT-09: conversations with a tool call that has the tag."""
    calls = store["tool_calls"].select(F.col("id"), F.col("conversation_id").alias("c"))
    ids = calls.join(tagged(store, [tag], "tool_call"), "id", "left_semi").select(F.col("c").alias(key))
    return rows.join(ids, key, "left_semi")


def by_id(rows: DataFrame, value: str, key: str = "id") -> DataFrame:
    """FLT-11: the row with this id, or the first whose id begins so."""
    return rows.where(F.col(key).startswith(value)).orderBy((F.col(key) != value), F.col(key)).limit(1)


def in_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """FLT-12: rows whose id is in a set of any size."""
    return rows.join(ids.select(F.col("id").alias(key)), key, "left_semi")


def text_blocks(content: DataFrame) -> DataFrame:
    """FLT-13: text blocks that have a text, and the text."""
    return content.where((F.col("block_type") == "text") & json_text(F.col("content")).isNotNull()).withColumn("text", json_text(F.col("content")))


def at_least(rows: DataFrame, threshold: float) -> DataFrame:
    """FLT-14."""
    return rows.where(F.col("score") >= threshold)


def active_conversations(store: Store, live_paths: DataFrame) -> DataFrame:
    """FLT-16: ids of conversations whose file is live. live_paths: path."""
    known = store["ingested_files"].where(F.col("conversation_id").isNotNull())
    return known.join(live_paths.select("path"), "path", "left_semi").select(F.col("conversation_id").alias("id")).distinct()


FILE_TOOLS = ["file.read", "file.write", "file.edit"]


def file_calls(store: Store) -> DataFrame:
    """FLT-17: tool calls that touch a file, with the tool's name as `tool`."""
    tools = store["tools"].where(F.col("name").isin(FILE_TOOLS)).select(F.col("id").alias("tool_id"), F.col("name").alias("tool"))
    return store["tool_calls"].join(F.broadcast(tools), "tool_id")  # three tools at most


def metadata_candidates(store: Store, workspace: str | None = None, model: str | None = None, since_: str | None = None, before_: str | None = None, tags: list[str] | None = None, all_tags: list[str] | None = None, no_tags: list[str] | None = None) -> DataFrame | None:
    """RET-03: ids of conversations that meet the metadata filters; None without a filter."""
    if not any((workspace, model, since_, before_, tags, all_tags, no_tags)):
        return None
    rows = where_all(store["conversations"], since(since_) if since_ else None, before(before_) if before_ else None)
    if workspace:
        rows = rows.join(store["workspaces"].where(in_workspace(workspace)).select(F.col("id").alias("workspace_id")), "workspace_id", "left_semi")
    if model:
        models = store["models"].where(of_model(model)).select(F.col("id").alias("model_id"))
        rows = rows.join(store["responses"].join(models, "model_id", "left_semi").select(F.col("conversation_id").alias("id")), "id", "left_semi")
    return without_tags(with_all_tags(with_any_tag(rows, store, tags or []), store, all_tags or []), store, no_tags or []).select("id").distinct()


def intersect_or_all(recall: DataFrame, candidates: DataFrame) -> DataFrame:
    """SET-01: the ids in both; all candidates where no id is. One pass decides, without a job of its own."""
    marked = candidates.select("id").distinct().join(recall.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    some = marked.agg(F.max(F.coalesce("hit", F.lit(False))).alias("some"))
    return marked.crossJoin(F.broadcast(some)).where(F.col("hit").isNotNull() | ~F.col("some")).select("id")  # one row


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET-02 to SET-05: ids of a that aren't in b."""
    return a.select("id").distinct().join(b.select("id"), "id", "left_anti")


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SET-07, STR-04: of the rows with equal keys the first."""
    best = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("row")
    return rows.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(best).select("row.*")


def newest_session(sessions: DataFrame, workspace: str) -> DataFrame:
    """FLT-24: the session last seen in a workspace."""
    return sessions.where(F.col("workspace_path") == workspace).orderBy(F.desc("last_seen_at"), "harness_session_id").limit(1)


def times_of(rows: DataFrame, table: DataFrame, key: str, ts: str) -> DataFrame:
    """FLT-23: rows and the time of what they name, '' where there is none."""
    return rows.join(table.select(F.col("id").alias(key), F.col(ts).alias("time")), key, "left").withColumn("time", F.coalesce("time", F.lit("")))


def found(store: Store, table: str, **key) -> DataFrame:
    """FLT-21: the rows of a table with this key; a null meets nulls."""
    rows = store[table]
    for column, value in key.items():
        rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
    return rows


#: Of each child table the order in which its rows stand under their parent.
CHILD_ORDER = {"prompts": ["timestamp", "id"], "responses": ["timestamp", "id"], "tool_calls": ["timestamp", "id"], "prompt_content": ["block_index"], "response_content": ["block_index"], "conversation_tags": ["tag_id"]}


def children_of(store: Store, table: str, parent: str, ids: DataFrame) -> DataFrame:
    """FLT-22: the rows of a child table under these parents (id), with their place, from 0."""
    rows = store[table].join(ids.select(F.col("id").alias(parent)), parent, "left_semi")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(parent).orderBy(*CHILD_ORDER[table])) - 1)
