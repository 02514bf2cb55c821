"""Changes to a store: vocabularies, tags, ledgers, blobs, merges, deletions. A change takes tables and returns new ones.

Tables are immutable snapshots: nothing is updated in place, a caller writes what comes back to a new path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.functions.scalars import command_of, is_binary_block, is_derivative, may_hold_binary, model_name, result_without_binary, shell_category, stable_id, without_binary
from threadmill.plans.tables import settled
from threadmill.schema import CHILDREN, KEYS, SCHEMAS, Store, conform

#: Name, category, description. Fixed values.
CANONICAL_TOOLS = [
    ("file.read", "file", "Read file contents"),
    ("file.write", "file", "Write/create a file"),
    ("file.edit", "file", "Edit/modify existing file"),
    ("file.glob", "file", "Find files by pattern"),
    ("shell.execute", "shell", "Execute shell commands"),
    ("shell.stdin", "shell", "Send input to running shell"),
    ("search.grep", "search", "Search file contents"),
    ("search.web", "search", "Web search"),
    ("web.fetch", "web", "Fetch URL content"),
    ("task.spawn", "task", "Launch subtask/agent"),
    ("task.output", "task", "Get task output"),
    ("task.kill", "task", "Kill running task"),
    ("ui.ask", "ui", "Ask user a question"),
    ("ui.todo", "ui", "Write todo items"),
    ("notebook.edit", "notebook", "Edit notebook cell"),
    ("skill.invoke", "skill", "Invoke a skill"),
]


def upsert(table: DataFrame, new: DataFrame, keys: list[str], keep_new: bool) -> DataFrame:
    """Rows of both, one a key: the new row (DO UPDATE) or the old one (DO NOTHING). Nulls in a key are no match, so such rows all stay."""
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    new = new.select(*table.columns)
    one = new.where(complete).dropDuplicates(keys)
    rest = new.where(~complete)
    if keep_new:
        return table.join(one.select(*keys), keys, "left_anti").unionByName(one).unionByName(rest)
    return table.unionByName(one.join(table.select(*keys), keys, "left_anti").select(*table.columns)).unionByName(rest)


def get_or_create(store: Store, name: str, rows: DataFrame) -> DataFrame:
    """DML-01: a vocabulary table with the rows whose natural key it lacked; their ids come from that key."""
    keys = KEYS[name]
    given = rows.withColumn("id", stable_id(F.lit(name), *(F.col(k) for k in keys)))
    return upsert(store[name], conform(given, name), keys, keep_new=False)


def seed_tools(spark: SparkSession) -> DataFrame:
    """DML-02: the canonical tools."""
    rows = spark.createDataFrame(CANONICAL_TOOLS, "name string, category string, description string")
    return conform(rows.withColumn("id", stable_id(F.lit("tools"), F.col("name"))), "tools")


def register_aliases(store: Store, harness_id: str, aliases: dict[str, str] | DataFrame) -> DataFrame:
    """DML-02: tool_aliases with a harness's names (raw_name, tool); those of unknown tools are left out."""
    given = aliases if isinstance(aliases, DataFrame) else store["tools"].sparkSession.createDataFrame(sorted(aliases.items()), "raw_name string, tool string")
    rows = given.join(store["tools"].select(F.col("id").alias("tool_id"), F.col("name").alias("tool")), "tool").withColumn("harness_id", F.lit(harness_id))
    return get_or_create(store, "tool_aliases", rows)


def canonical_tool(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """FN-25: calls (raw_name) with `tool`: the canonical name, the raw one where it has none. aliases: raw_name, tool."""
    return calls.join(aliases.select("raw_name", "tool"), "raw_name", "left").withColumn("tool", F.coalesce("tool", "raw_name"))


# --- Tags ---------------------------------------------------------------------------------------------------------


def create_tag(store: Store, name: str, at: str, description: str | None = None) -> Store:
    """DML-03: the tag, if there is none of this name."""
    row = store["tags"].sparkSession.createDataFrame([(name, description, at)], "name string, description string, created_at string")
    return store | {"tags": get_or_create(store, "tags", row)}


def apply_tag(store: Store, entity: str, ids: DataFrame, name: str, at: str) -> Store:
    """DML-03: the tag on these entities (column id), once each."""
    store = create_tag(store, name, at)
    table = f"{entity}_tags"
    tag = store["tags"].where(F.col("name") == name).select(F.col("id").alias("tag_id"))
    rows = ids.select(F.col("id").alias(f"{entity}_id")).distinct().crossJoin(F.broadcast(tag)).withColumn("applied_at", F.lit(at))  # one tag
    return store | {table: get_or_create(store, table, rows)}


def remove_tag(store: Store, entity: str, ids: DataFrame, name: str) -> Store:
    """DML-03: these entities without the tag."""
    tag = store["tags"].where(F.col("name") == name).select(F.col("id").alias("tag_id"))
    gone = ids.select(F.col("id").alias(f"{entity}_id")).crossJoin(F.broadcast(tag))
    return store | {f"{entity}_tags": store[f"{entity}_tags"].join(gone, [f"{entity}_id", "tag_id"], "left_anti")}


def rename_tag(store: Store, old: str, new: str) -> Store:
    """DML-03: an error if there is no such tag, or one of the new name."""
    names = {r[0] for r in store["tags"].where(F.col("name").isin(old, new)).select("name").collect()}  # two at most
    if old not in names:
        raise KeyError(f"there is no tag {old}")
    if new in names:
        raise ValueError(f"there is a tag {new} already")
    return store | {"tags": store["tags"].withColumn("name", F.when(F.col("name") == old, new).otherwise(F.col("name")))}


def delete_tag(store: Store, name: str) -> tuple[Store, int]:
    """DML-03: the store without the tag, and how many entities had it; -1 if there is no such tag."""
    tag = store["tags"].where(F.col("name") == name).select("id")
    if tag.isEmpty():
        return store, -1
    n = sum(store[t].join(tag.withColumnRenamed("id", c), c, "left_semi").count() for t, c in CHILDREN["tags"])
    return delete_rows(store, "tags", tag), n


def auto_shell_tags(store: Store, at: str, program: str) -> Store:
    """DML-04, DML-06: shell calls tagged by category, conversations that search this history tagged as derivative. Each call is read and judged once; what was found is stored."""
    calls = store["tool_calls"].join(store["tools"].select(F.col("id").alias("tool_id"), F.col("name").alias("tool")), "tool_id")
    category = F.when(F.col("tool") == "shell.execute", shell_category(command_of(F.col("input"))))
    judged = settled(calls.select("id", "conversation_id", category.alias("category"), is_derivative(F.col("tool"), F.col("input"), program).alias("derived")), "shell-calls")
    shell = judged.where("category IS NOT NULL").select("id", F.concat(F.lit("shell:"), F.col("category")).alias("name"))
    names = shell.select("name").distinct().select("name", F.lit(None).cast("string").alias("description"), F.lit(at).alias("created_at"))
    store = store | {"tags": settled(get_or_create(store, "tags", names), "shell-tags")}
    rows = shell.join(store["tags"].select(F.col("id").alias("tag_id"), "name"), "name").select(F.col("id").alias("tool_call_id"), "tag_id", F.lit(at).alias("applied_at"))
    store = store | {"tool_call_tags": get_or_create(store, "tool_call_tags", rows)}
    return apply_tag(store, "conversation", judged.where("derived").select(F.col("conversation_id").alias("id")), f"{program}:derivative", at)


# --- Deletions and merges --------------------------------------------------------------------------------------------


def delete_rows(store: Store, name: str, ids: DataFrame) -> Store:
    """DML-05: rows with these ids, and all that hangs on them. Full-text entries are rebuilt from what is left."""
    for child, column in CHILDREN.get(name, []):
        gone = store[child].join(ids.select(F.col("id").alias(column)), column, "left_semi")
        store = delete_rows(store, child, gone.select("id")) if child in CHILDREN else store | {child: store[child].join(ids.select(F.col("id").alias(column)), column, "left_anti").select(*SCHEMAS[child].names)}
    return store | {name: store[name].join(ids.select("id"), "id", "left_anti")}


def delete_workspaces(store: Store, ids: DataFrame) -> Store:
    """DML-05: conversations of a deleted workspace stay, without one."""
    gone = ids.select(F.col("id").alias("workspace_id"), F.lit(True).alias("__gone"))
    rows = store["conversations"].join(gone, "workspace_id", "left").withColumn("workspace_id", F.when(F.col("__gone").isNull(), F.col("workspace_id"))).select(*SCHEMAS["conversations"].names)
    tags = store["workspace_tags"].join(ids.select(F.col("id").alias("workspace_id")), "workspace_id", "left_anti").select(*SCHEMAS["workspace_tags"].names)
    return store | {"conversations": rows, "workspace_tags": tags, "workspaces": store["workspaces"].join(ids.select("id"), "id", "left_anti")}


def workspace_keepers(store: Store) -> DataFrame:
    """DML-08, T27: (id, keeper): of workspaces with one remote the one with most conversations, then the smallest id."""
    n = store["conversations"].groupBy(F.col("workspace_id").alias("id")).agg(F.count("*").alias("n"))
    rows = store["workspaces"].where("git_remote IS NOT NULL").join(n, "id", "left").fillna(0, ["n"])
    best = rows.groupBy("git_remote").agg(F.min_by("id", F.struct(-F.col("n"), F.col("id"))).alias("keeper"))
    return rows.join(best, "git_remote").where("id <> keeper").select("id", "keeper")


def merge_workspaces(store: Store) -> Store:
    """DML-08: workspaces of one remote become one, with all their conversations and tags."""
    keepers = workspace_keepers(store)
    moved = keepers.select(F.col("id").alias("workspace_id"), "keeper")
    place = lambda t: store[t].join(moved, "workspace_id", "left").withColumn("workspace_id", F.coalesce("keeper", "workspace_id")).select(*SCHEMAS[t].names)
    return store | {"conversations": place("conversations"), "workspace_tags": place("workspace_tags").dropDuplicates(["workspace_id", "tag_id"]), "workspaces": store["workspaces"].join(keepers.select("id"), "id", "left_anti")}


def with_remotes(store: Store, remotes: DataFrame) -> Store:
    """DML-08: workspaces with the remotes found for their paths (path, git_remote), where they had none."""
    rows = store["workspaces"].join(remotes.select("path", F.col("git_remote").alias("__found")), "path", "left")
    return store | {"workspaces": rows.withColumn("git_remote", F.coalesce("git_remote", "__found")).select(*SCHEMAS["workspaces"].names)}


# --- Blobs and backfills ------------------------------------------------------------------------------------------------


def blobs_of(calls: DataFrame, at: str) -> DataFrame:
    """SNK-02, DML-07: results by content, with how many calls refer to each."""
    rows = calls.where(F.col("result").isNotNull()).select(F.sha2("result", 256).alias("hash"), F.col("result").alias("content"))
    return rows.groupBy("hash").agg(F.first("content").alias("content"), F.count("*").alias("ref_count")).withColumn("created_at", F.lit(at))


def to_blobs(store: Store, at: str) -> Store:
    """DML-07: inline results move into blobs; references are counted anew over all calls."""
    calls = store["tool_calls"].withColumn("result_hash", F.coalesce("result_hash", F.sha2("result", 256)))
    contents = store["content_blobs"].select("hash", "content", "created_at").unionByName(blobs_of(store["tool_calls"], at).select("hash", "content", "created_at")).groupBy("hash").agg(F.first("content").alias("content"), F.min("created_at").alias("created_at"))
    refs = calls.where("result_hash IS NOT NULL").groupBy(F.col("result_hash").alias("hash")).agg(F.count("*").alias("ref_count"))
    blobs = contents.join(refs, "hash").select(*SCHEMAS["content_blobs"].names)  # without a reference a blob goes
    return store | {"tool_calls": calls.withColumn("result", F.lit(None).cast("string")).select(*SCHEMAS["tool_calls"].names), "content_blobs": blobs}


def blob_errors(store: Store) -> DataFrame:
    """AGG-26: hashes that calls name and no blob has, and blobs whose content has another hash or count."""
    refs = store["tool_calls"].where("result_hash IS NOT NULL").groupBy(F.col("result_hash").alias("hash")).agg(F.count("*").alias("n"))
    both = store["content_blobs"].join(refs, "hash", "full")
    finding = F.when(F.col("content").isNull(), "missing").when(F.sha2("content", 256) != F.col("hash"), "changed").when(F.coalesce("n", F.lit(0)) != F.col("ref_count"), "count")
    return both.select("hash", finding.alias("finding")).where("finding IS NOT NULL")


def backfill_models(store: Store) -> Store:
    """DML-06: models with the parts of their raw names."""
    rows = store["models"].withColumn("m", model_name(F.col("raw_name")))
    return store | {"models": rows.select("id", "raw_name", *(F.col("m")[c].alias(c) for c in ("name", "creator", "family", "version", "variant", "released")))}


def backfill_providers(store: Store) -> Store:
    """DML-06: responses without a provider get that of their conversation's harness, by its source."""
    of = store["conversations"].select(F.col("id").alias("conversation_id"), "harness_id").join(store["harnesses"].select(F.col("id").alias("harness_id"), F.col("source").alias("name")), "harness_id").join(store["providers"].select("name", F.col("id").alias("__p")), "name").select("conversation_id", "__p")
    rows = store["responses"].join(of, "conversation_id", "left").withColumn("provider_id", F.coalesce("provider_id", "__p"))
    return store | {"responses": rows.select(*SCHEMAS["responses"].names)}


def upsert_attributes(store: Store, entity: str, rows: DataFrame, order: Column | None = None) -> DataFrame:
    """DML-10: attributes (entity id, key, value, scope), the last one of each; a null scope never meets another."""
    table, key = f"{entity}_attributes", f"{entity}_id"
    if order is not None:
        last = F.max_by(F.struct("value"), order)
        given = rows.where("scope IS NOT NULL").groupBy(key, "key", "scope").agg(last.alias("v")).select(key, "key", "scope", "v.value")
        rows = given.unionByName(rows.where("scope IS NULL").select(key, "key", "scope", "value"))
    made = conform(rows.withColumn("id", stable_id(F.lit(table), F.col(key), F.col("key"), F.coalesce("scope", F.concat(F.lit("?"), F.col("value"))))), table)
    return upsert(store[table], made, [key, "key", "scope"], keep_new=True)


def backfill_attributes(store: Store, logs) -> Store:
    """JON-14, DML-06: what the logs still say of answers and the store lacks: a record meets the response of its conversation's and its own external id. Zeros and empty values are left out."""
    records = logs.records.where("kind = 'response' AND external_id IS NOT NULL").join(logs.sessions.select("path", "session", F.col("external_id").alias("session_id")), ["path", "session"])
    said = records.select("session_id", "external_id", "seq", F.explode("attributes").alias("key", "value")).where("value IS NOT NULL AND value NOT IN ('', '0')")
    known = store["responses"].select(F.col("id").alias("response_id"), "conversation_id", "external_id").join(store["conversations"].select(F.col("id").alias("conversation_id"), F.col("external_id").alias("session_id")), "conversation_id")
    rows = said.join(known, ["session_id", "external_id"]).select("response_id", "key", "value", "seq", F.lit("provider").alias("scope"))
    return store | {"response_attributes": upsert_attributes(store, "response", rows, F.col("seq"))}


def filter_binary(store: Store) -> Store:
    """DML-06: contents and results without binary data; only what may hold some is parsed."""
    out = dict(store)
    for name in ("prompt_content", "response_content"):
        out[name] = store[name].withColumn("content", F.when(may_hold_binary(F.col("content")) & is_binary_block(F.col("content")), without_binary(F.col("content"))).otherwise(F.col("content")))
    out["tool_calls"] = store["tool_calls"].withColumn("result", F.when(F.length("result") > 0, result_without_binary(F.col("result"))).otherwise(F.col("result")))
    return out


def tag_by_search(store: Store, scores: DataFrame, threshold: float, name: str, at: str) -> Store:
    """DML-11: conversations (conversation_id, max_score) from this score on get the tag."""
    return apply_tag(store, "conversation", scores.where(F.col("max_score") >= threshold).select(F.col("conversation_id").alias("id")), name, at)


# --- Ingest ledger and incremental ingest --------------------------------------------------------------------------------

#: What names a file in the ledger.
LEDGER_KEYS = tuple(KEYS["ingested_files"])


def to_ingest(found: DataFrame, ledger: DataFrame, keys: Sequence[str] = LEDGER_KEYS) -> DataFrame:
    """STR-01, STR-03, SET-05: files (path, file_hash) that the ledger lacks or has with another hash; `known` says which. A failed file comes back only when it changed.

    keys: what names a file, where one path may stand for several; both sides have these columns, and the ledger has one row of each."""
    before = ledger.select(*keys, F.lit(True).alias("known"), F.col("file_hash").alias("was"), F.col("conversation_id").alias("old_conversation_id"))
    joined = found.join(before, list(keys), "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return joined.where(~F.col("known") | ~F.col("was").eqNullSafe(F.col("file_hash"))).select(*found.columns, "old_conversation_id", "known")


def latest_sessions(rows: DataFrame) -> DataFrame:
    """STR-02: of the conversations of one harness and external_id the one that ended last, then the last path."""
    best = F.max_by(F.struct(*rows.columns), F.struct(F.coalesce("ended_at", F.lit("")), "path")).alias("row")
    return rows.groupBy("harness_id", "external_id").agg(best).select("row.*")


def newer_sessions(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """STR-02: sessions that the store lacks, or has with an earlier end."""
    was = conversations.select("harness_id", "external_id", F.col("ended_at").alias("was"), F.lit(True).alias("known"))
    joined = rows.join(was, ["harness_id", "external_id"], "left")
    newer = F.col("known").isNull() | F.coalesce(F.try_to_timestamp("ended_at") > F.try_to_timestamp("was"), F.col("was").isNull() & F.col("ended_at").isNotNull())
    return joined.where(newer).drop("was", "known")


def record_files(store: Store, files: DataFrame, at: str, keys: Sequence[str] = LEDGER_KEYS) -> DataFrame:
    """SNK-07: the ledger with these files (path, file_hash, harness_id, conversation_id, error); an empty file has no conversation, a failed one an error. keys: as in to_ingest()."""
    rows = files.withColumn("ingested_at", F.lit(at)).withColumn("id", stable_id(F.lit("ingested_files"), *(F.col(k) for k in keys)))
    return upsert(store["ingested_files"], conform(rows, "ingested_files"), list(keys), keep_new=True)


def clear_ledger(store: Store, paths: DataFrame | None = None) -> DataFrame:
    """SNK-07: the ledger without these paths, or empty."""
    ledger = store["ingested_files"]
    return ledger.limit(0) if paths is None else ledger.join(paths.select("path"), "path", "left_anti")


# --- Live sessions -----------------------------------------------------------------------------------------------------


def register_sessions(sessions: DataFrame, seen: DataFrame) -> DataFrame:
    """STR-05: sessions after these were seen: the first start, the last sighting, the newest of the rest."""
    both = sessions.unionByName(seen.select(*sessions.columns))
    last = lambda c: F.max_by(c, "last_seen_at").alias(c)
    return both.groupBy("harness_session_id").agg(last("adapter_name"), last("workspace_path"), F.min("started_at").alias("started_at"), F.max("last_seen_at").alias("last_seen_at"))


def unregister(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """STR-05."""
    return sessions.join(ids.select(F.col("id").alias("harness_session_id")), "harness_session_id", "left_anti")


def queue_tags(pending: DataFrame, new: DataFrame) -> DataFrame:
    """STR-06: the queue with new tags; no exchange is an exchange like any other when it comes to what is there already."""
    rows = pending.unionByName(new.select(*pending.columns))
    w = Window.partitionBy("harness_session_id", "tag_name", "entity_type", "exchange_index").orderBy("created_at", "id")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def consume_tags(store: Store, conversations: DataFrame, at: str) -> Store:
    """STR-06: queued tags of the sessions of these conversations (session_id, conversation_id) are applied: to the conversation, or to the prompt at their exchange."""
    due = store["pending_tags"].join(conversations.select(F.col("session_id").alias("harness_session_id"), "conversation_id"), "harness_session_id")
    names = due.select(F.col("tag_name").alias("name"), F.lit(None).cast("string").alias("description"), F.lit(at).alias("created_at")).distinct()
    store = store | {"tags": get_or_create(store, "tags", names)}
    tagged = due.join(store["tags"].select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name")), "tag_name").withColumn("applied_at", F.lit(at))
    w = Window.partitionBy("conversation_id").orderBy("timestamp", "id")
    prompts = store["prompts"].withColumn("place", F.row_number().over(w) - 1).select("conversation_id", "place", F.col("id").alias("prompt_id"))
    on_prompt = tagged.where("exchange_index IS NOT NULL").withColumn("place", F.col("exchange_index")).join(prompts, ["conversation_id", "place"])
    done = store | {"conversation_tags": get_or_create(store, "conversation_tags", tagged.where("exchange_index IS NULL")), "prompt_tags": get_or_create(store, "prompt_tags", on_prompt)}
    left = store["pending_tags"].join(conversations.select(F.col("session_id").alias("harness_session_id")), "harness_session_id", "left_anti").select(*SCHEMAS["pending_tags"].names)
    return done | {"pending_tags": left}


def expire_sessions(store: Store, cutoff: str) -> Store:
    """STR-07: sessions last seen before the cutoff go, and queued tags of sessions that aren't there."""
    sessions = store["active_sessions"].where(F.col("last_seen_at") >= cutoff)
    pending = store["pending_tags"].join(sessions.select("harness_session_id"), "harness_session_id", "left_semi").select(*SCHEMAS["pending_tags"].names)
    return store | {"active_sessions": sessions, "pending_tags": pending}


def stale_session_counts(store: Store, cutoff: str) -> DataFrame:
    """STR-07, CHK-11: sessions to expire, and queued tags of none or of those."""
    alive = store["active_sessions"].where(F.col("last_seen_at") >= cutoff).select("harness_session_id")
    sessions = store["active_sessions"].where(F.col("last_seen_at") < cutoff).agg(F.count("*").alias("sessions"))
    return sessions.crossJoin(store["pending_tags"].join(alive, "harness_session_id", "left_anti").agg(F.count("*").alias("tags")))  # rows of one


TTL_HOURS = 48
