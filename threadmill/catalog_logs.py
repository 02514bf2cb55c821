"""Queries of the log readers, of what is made of their records, and of live sessions: the driver's conversations and events, written as logs of each format and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill import schema
from threadmill.catalog import over_tables
from threadmill.functions import scalars
from threadmill.operators import maintenance
from threadmill.plans import canonical
from threadmill.plans.tables import new_path, settled
from threadmill.sources import lines as log_lines
from threadmill.sources import logs
from threadmill.streaming import live, sessions

AT = "2026-01-01T00:00:00Z"
def _time() -> Column:
    return F.concat(F.lit("2024-01-01T00:00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit("Z"))

_T = "t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, '2024-01-01T00:00:' || lpad(CAST(turn AS VARCHAR), 2, '0') || 'Z' AS ts FROM conversations)"


def _files(rows: DataFrame, line: Column, path: Column, head: list[Column] | None = None, order: str = "turn") -> DataFrame:
    """A file per conversation: a line per row, in order, after the lines of its head."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"])
    text = F.array_join(F.concat(F.array(*head), lines) if head else lines, "\n")
    return rows.groupBy("conv_id").agg(text.alias("text")).select(path.alias("path"), "text", F.sha2("text", 256).alias("file_hash"))


def _object(**parts: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def _id() -> Column:
    return F.col("conv_id").cast("string")

def _uuid() -> Column:
    return F.concat_ws("-", "conv_id", "turn")

def _said() -> Column:
    return F.regexp_extract(F.get_json_object(F.get("blocks", F.lit(0))["content"], "$.text"), r"(?s)^(.*)$", 1)



def typed(spark: SparkSession, sf_dir: str) -> logs.Logs:
    """The conversations as JSON lines of typed messages; some answers with cache tokens."""
    answer = F.col("role") == "assistant"
    usage = _object(input_tokens=F.col("turn"), output_tokens=F.length("text"), cache_read_input_tokens=F.when(F.col("conv_id") % 3 == 0, F.col("turn") * 10))
    message = _object(role=F.col("role"), content=F.col("text"), model=F.when(answer, F.concat(F.lit("claude-opus-4-"), (F.col("conv_id") % 2).cast("string"), F.lit("-20250101"))), usage=F.when(answer, usage))
    line = F.to_json(_object(type=F.col("role"), sessionId=_id(), cwd=F.concat(F.lit("/w/"), (F.col("conv_id") % 5).cast("string")), uuid=_uuid(), timestamp=_time(), message=message))
    return logs.claude_code(_files(canonical.turns(spark, sf_dir), line, F.concat(F.lit("/h/.claude/projects/p/"), _id(), F.lit(".jsonl"))))


def enveloped(spark: SparkSession, sf_dir: str) -> logs.Logs:
    """As JSON lines of events with payloads, after one of the session and one of the model."""
    text = F.array(_object(type=F.when(F.col("role") == "user", "input_text").otherwise("output_text"), text=F.col("text")))
    line = F.to_json(_object(type=F.lit("response_item"), timestamp=_time(), payload=_object(type=F.lit("message"), role=F.col("role"), content=text)))
    head = [F.to_json(_object(type=F.lit("session_meta"), timestamp=F.lit(AT), payload=_object(id=_id(), cwd=F.lit("/w")))), F.to_json(_object(type=F.lit("turn_context"), payload=_object(model=F.lit("m-1"))))]
    return logs.codex_cli(_files(canonical.turns(spark, sf_dir), line, F.concat(F.lit("/h/.codex/sessions/"), _id(), F.lit(".jsonl")), head))


def whole(spark: SparkSession, sf_dir: str) -> logs.Logs:
    """As one JSON object a file; the projects' folders are known by their hashes."""
    kind = F.when(F.col("role") == "assistant", "gemini").otherwise(F.col("role"))
    message = _object(type=kind, id=_uuid(), timestamp=_time(), content=F.col("text"), model=F.when(kind == "gemini", "gemini-2.5-pro"), tokens=F.when(kind == "gemini", _object(input=F.col("turn"), output=F.length("text"))))
    folder = F.concat(F.lit("/w/"), (F.col("conv_id") % 5).cast("string"))
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"])
    made = canonical.turns(spark, sf_dir).groupBy("conv_id").agg(messages.alias("messages"))
    text = F.to_json(_object(sessionId=_id(), projectHash=F.sha2(folder, 256), startTime=F.lit("2024-01-01T00:00:00Z"), lastUpdated=F.lit(AT), messages=F.col("messages")))
    known = spark.range(4).select(F.concat(F.lit("/w/"), F.col("id").cast("string")).alias("path"))
    return logs.gemini_cli(made.select(F.concat(F.lit("/h/.gemini/tmp/p/chats/"), _id(), F.lit(".json")).alias("path"), text.alias("text")), known)


def _flat() -> Column:
    return F.trim(F.regexp_replace("text", "[ \t\r\n\f]+", " "))

_FLAT_SQL = "trim(regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


def markdown(spark: SparkSession, sf_dir: str) -> logs.Logs:
    """As Markdown histories: users' lines, assistants' lines, and the system's as a tool's; a second session follows."""
    line = F.concat(F.when(F.col("role") == "user", "#### ").when(F.col("role") == "system", "> ").otherwise(""), _flat())
    files = _files(canonical.turns(spark, sf_dir), line, F.concat(F.lit("/w/"), _id(), F.lit("/.aider.chat.history.md")), [F.lit("# aider chat started at 2024-01-02 03:04:05")])
    return logs.aider(files.withColumn("text", F.concat("text", F.lit("\n\n# aider chat started at 2024-01-03 03:04:05\n\n#### again\n> Tokens: 4.5k sent, 1.2k received. Cost: $0.02\n"))))


over_tables("src01_records", f"""WITH {_T} SELECT '/h/.claude/projects/p/' || conv_id || '.jsonl' AS path, seq, CASE role WHEN 'user' THEN 'prompt' ELSE 'response' END AS kind, 'claude_code::' || conv_id || '-' || turn AS external_id, ts AS timestamp,
  CASE role WHEN 'assistant' THEN 'claude-opus-4-' || conv_id % 2 || '-20250101' END AS model, CASE role WHEN 'assistant' THEN turn END AS input_tokens, CASE role WHEN 'assistant' THEN length(text) END AS output_tokens, text FROM t WHERE role IN ('user', 'assistant')""")(
    lambda s, d: typed(s, d).records.select("path", "seq", "kind", "external_id", "timestamp", "model", "input_tokens", "output_tokens", _said().alias("text"))
)
over_tables("src01_sessions", f"""WITH {_T} SELECT '/h/.claude/projects/p/' || conv_id || '.jsonl' AS path, 'claude_code::' || conv_id AS external_id, '/w/' || conv_id % 5 AS workspace_path, min(ts) AS started_at, max(ts) AS ended_at
FROM t WHERE role IN ('user', 'assistant') GROUP BY conv_id HAVING bool_or(role = 'user')""")(lambda s, d: typed(s, d).sessions.select("path", "external_id", "workspace_path", "started_at", "ended_at"))
over_tables("src02_records", f"WITH {_T} SELECT '/h/.codex/sessions/' || conv_id || '.jsonl' AS path, seq + 2 AS seq, CASE role WHEN 'user' THEN 'prompt' ELSE 'response' END AS kind, ts AS timestamp, CASE role WHEN 'assistant' THEN 'm-1' END AS model, text FROM t WHERE role IN ('user', 'assistant')")(
    lambda s, d: enveloped(s, d).records.select("path", "seq", "kind", "timestamp", "model", _said().alias("text"))
)
over_tables("src02_sessions", f"WITH {_T} SELECT '/h/.codex/sessions/' || conv_id || '.jsonl' AS path, 'codex_cli::' || conv_id AS external_id, '/w' AS workspace_path, min(ts) AS started_at, '{AT}' AS ended_at FROM t GROUP BY conv_id")(lambda s, d: enveloped(s, d).sessions.select("path", "external_id", "workspace_path", "started_at", "ended_at"))
over_tables("src03_records", f"""WITH {_T} SELECT '/h/.gemini/tmp/p/chats/' || conv_id || '.json' AS path, seq, CASE role WHEN 'user' THEN 'prompt' ELSE 'response' END AS kind, 'gemini_cli::' || conv_id || '-' || turn AS external_id,
  CASE role WHEN 'assistant' THEN 'gemini-2.5-pro' END AS model, CASE role WHEN 'assistant' THEN turn END AS input_tokens, CASE role WHEN 'assistant' THEN length(text) END AS output_tokens, nullif(text, '') AS text FROM t WHERE role IN ('user', 'assistant')""")(
    lambda s, d: whole(s, d).records.select("path", "seq", "kind", "external_id", "model", "input_tokens", "output_tokens", _said().alias("text"))
)
over_tables("src12_projects", "SELECT DISTINCT 'gemini_cli::' || conv_id AS external_id, CASE WHEN conv_id % 5 < 4 THEN '/w/' || conv_id % 5 END AS workspace_path FROM conversations")(lambda s, d: whole(s, d).sessions.select("external_id", "workspace_path"))
over_tables("src04_records", f"""WITH f AS (SELECT conv_id, turn, role, {_FLAT_SQL} AS said FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM f)
SELECT '/w/' || conv_id || '/.aider.chat.history.md' AS path, seq, CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'response' ELSE 'call' END AS kind, '2024-01-02T03:04:05' AS timestamp, said AS text FROM k WHERE said <> ''""")(
    lambda s, d: logs.first_sessions(markdown(s, d)).records.select("path", "seq", "kind", "timestamp", _said().alias("text"))
)
over_tables("src04_costs", "SELECT DISTINCT '/w/' || conv_id || '/.aider.chat.history.md' AS path, '4500' AS sent, '1200' AS received, '0.02' AS cost FROM conversations")(
    lambda s, d: markdown(s, d).records.where("session = 1 AND kind = 'call'").select("path", F.col("attributes")["approx_input_tokens"].alias("sent"), F.col("attributes")["approx_output_tokens"].alias("received"), F.col("attributes")["approx_cost"].alias("cost"))
)
over_tables("str04_first_sessions", "SELECT DISTINCT '/w/' || conv_id || '/.aider.chat.history.md' AS path, 'aider::/w/' || conv_id || '::2024-01-02T03:04:05' AS external_id FROM conversations")(lambda s, d: logs.first_sessions(markdown(s, d)).sessions.select("path", "external_id"))


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files some of which hold lines that are no JSON."""
    line = F.when((F.col("conv_id") + F.col("turn")) % 11 == 3, '{"broken').otherwise(F.to_json(_object(turn=F.col("turn"), text=F.col("text"))))
    return logs.json_lines(_files(canonical.turns(spark, sf_dir), line, F.concat(F.lit("/l/"), _id())))


_BAD = "(conv_id + turn) % 11 = 3"
over_tables("src05_strict", f"WITH {_T} SELECT '/l/' || conv_id AS path, seq, turn FROM t WHERE conv_id NOT IN (SELECT conv_id FROM t WHERE {_BAD})")(lambda s, d: logs.strict(_broken(s, d))[0].select("path", "seq", F.try_variant_get("v", "$.turn", "bigint").alias("turn")))
over_tables("src05_errors", f"WITH {_T} SELECT '/l/' || conv_id AS path, 'line ' || (min(seq) + 1) || ' is no JSON' AS error FROM t WHERE {_BAD} GROUP BY conv_id")(lambda s, d: logs.strict(_broken(s, d))[1])
over_tables("src06_tolerant", f"WITH {_T} SELECT '/l/' || conv_id AS path, seq, text FROM t WHERE NOT ({_BAD})")(lambda s, d: logs.tolerant(_broken(s, d))[0].select("path", "seq", F.try_variant_get("v", "$.text", "string").alias("text")))
over_tables("src06_rejected", f"WITH {_T} SELECT '/l/' || conv_id AS path, seq + 1 AS line_no, '{{\"broken' AS raw FROM t WHERE {_BAD}")(lambda s, d: logs.tolerant(_broken(s, d))[1])
over_tables("src11_tail", f"WITH {_T} SELECT '/l/' || conv_id AS path, seq FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) <= 2")(lambda s, d: live.tail(_broken(s, d), 2).select("path", "seq"))


def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readers of files once one for a tenth of the pages is registered."""
    logs.register("own_pages", logs.claude_code, "me", "jsonl", {}, "file", r"[0-9]*7(\.html?)?$")
    try:
        found = canonical.read(spark, sf_dir, "pages").select(F.concat(F.lit("/srv/"), F.col("page_id")).alias("path"))
        return logs.discovered(found.union(found.select(F.concat(F.lit("/h/.codex/sessions/"), F.element_at(F.split("path", "/"), -1), F.lit("x.jsonl"))))).select("path", "harness")
    finally:
        logs.unregister("own_pages")


def _overruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readers of session files once a drop-in has claimed those of even pages, which a package's reader claims in vain."""
    logs.register("even", logs.codex_cli, "me", "jsonl", place=r"[02468]\.jsonl$")
    logs.register("package", logs.codex_cli, "me", "jsonl", place=r"\.jsonl$", origin="package")
    try:
        assert not logs.register("even", logs.claude_code, "other", "jsonl", place=r"never$", origin="package")
        found = canonical.read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/h/.codex/sessions/"), F.col("page_id"), F.when(F.col("page_id") % 3 == 0, ".jsonl").otherwise(".json")).alias("path"))
        return logs.discovered(found).select("page_id", "harness")
    finally:
        logs.unregister("even")
        logs.unregister("package")


over_tables("set09_priorities", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'package' END AS harness FROM pages WHERE page_id % 3 = 0")(_overruled)
over_tables("src16_content", "SELECT conv_id, turn, CASE turn % 4 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS n, CASE turn % 4 WHEN 2 THEN NULL ELSE coalesce(text, '') END AS first FROM conversations")(
    lambda s, d: canonical.turns(s, d).withColumn("t", F.coalesce("text", F.lit(""))).withColumn("v", F.parse_json(
        F.when(F.col("turn") % 4 == 0, F.to_json(_object(content=F.col("t")))).when(F.col("turn") % 4 == 1, F.to_json(_object(content=_object(text=F.col("t")))))
        .when(F.col("turn") % 4 == 2, F.lit('{"content":null}')).otherwise(F.to_json(_object(content=F.array(_object(text=F.col("t")), _object(text=F.lit("more"))))))))
    .withColumn("e", logs.content_elements("$.content")).select("conv_id", "turn", F.size("e").alias("n"), F.coalesce(F.try_variant_get(F.get("e", F.lit(0)), "$.text", "string"), F.try_variant_get(F.get("e", F.lit(0)), "$", "string")).alias("first"))
)
def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after a stream of the events, each a sighting of its user: who wasn't seen for 48 hours before the watermark is gone."""
    path = new_path(spark, "session-events")
    rows = canonical.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("harness_session_id"), F.lit("seen").alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started_at"))
    kinds = dict(c.split(" ") for c in sessions.EVENTS.split(", "))
    rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items())).coalesce(1).write.parquet(f"{path}/in")
    sessions.start(spark.readStream.schema(sessions.EVENTS).parquet(f"{path}/in"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return sessions.current(spark, f"{path}/out")[0].select("harness_session_id", "started_at", "last_seen_at")


over_tables("str05_session_stream", """WITH e AS (SELECT user_id, ts, max(ts) OVER () AS newest FROM events)
SELECT CAST(user_id AS VARCHAR) AS harness_session_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS started_at, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_seen_at FROM e GROUP BY user_id, newest HAVING max(ts) + INTERVAL 48 HOUR > newest - INTERVAL 2 HOUR""")(_streamed)
over_tables("src14_registry", "SELECT '/srv/' || page_id AS path, 'own_pages' AS harness FROM pages WHERE page_id % 10 = 7 UNION ALL SELECT '/h/.codex/sessions/' || page_id || 'x.jsonl', 'codex_cli' FROM pages")(_registered)

_ON_DISK: dict[tuple[str, str], str] = {}


def _on_disk(spark: SparkSession, sf_dir: str) -> str:
    """The turns as text files, a line each: the turn, its role, and the text in one line."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _ON_DISK:
        path = new_path(spark, "lines")
        name = F.concat(F.lit("conv="), "conv_id", F.lit(".txt")).alias("name")
        log_lines.write(canonical.turns(spark, sf_dir).select(name, "turn", F.concat_ws(" ", "turn", "role", F.regexp_replace("text", "[\r\n]+", " ")).alias("line")), path, "turn")
        _ON_DISK[key] = path
    return _ON_DISK[key]


def _conv() -> Column:
    return F.regexp_extract("path", r"/conv=(\d+)\.txt$", 1).cast("long").alias("conv_id")


_LINE_SQL = r"turn || ' ' || role || ' ' || regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g')"
over_tables("src11_tail_seek", f"SELECT conv_id, rtrim({_LINE_SQL}) AS line FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")(
    lambda s, d: log_lines.read(s, _on_disk(s, d), "*.txt", last=2).select(_conv(), F.rtrim("line").alias("line"))
)
over_tables("src08_split_lines", "SELECT conv_id, turn, CAST(sum(CASE role WHEN 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS exchange FROM conversations")(
    lambda s, d: log_lines.fold_splits(log_lines.read(s, _on_disk(s, d), "*.txt", split_bytes=2000), F.split("line", " ")[1] == "user").select(_conv(), F.split("line", " ")[0].cast("long").alias("turn"), "exchange")
)


def _with_blocks(spark: SparkSession, sf_dir: str) -> logs.Logs:
    """Typed messages whose content is a list: a text, and an image for some; for others a text alone, as a string."""
    text = F.to_json(_object(type=F.lit("text"), text=F.col("text")))
    image = F.lit('{"type":"image","source":{"type":"base64","media_type":"image/png","data":"QUJDRA=="}}')
    content = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("["), text, F.lit(","), image, F.lit("]"))).otherwise(F.to_json(F.struct(F.col("text").alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("text").alias("x")))) - 6))
    head = F.to_json(_object(type=F.col("role"), uuid=_uuid(), timestamp=_time()))
    line = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"message":{"content":'), F.col("content"), F.lit("}}"))
    rows = canonical.turns(spark, sf_dir).withColumn("head", head).withColumn("content", content)
    return logs.claude_code(_files(rows, line, F.concat(F.lit("/b/"), _id(), F.lit(".jsonl"))))


over_tables("src07_blocks", f"""WITH {_T}, u AS (SELECT * FROM t WHERE role IN ('user', 'assistant'))
SELECT '/b/' || conv_id || '.jsonl' AS path, seq, 0 AS k, 'text' AS block_type, text, CAST(NULL AS INT) AS size FROM u UNION ALL SELECT '/b/' || conv_id || '.jsonl', seq, 1, 'image', NULL, 8 FROM u WHERE turn % 3 = 0""")(
    lambda s, d: _with_blocks(s, d).records.select("path", "seq", F.posexplode("blocks").alias("k", "b")).select("path", "seq", "k", "b.block_type", F.get_json_object("b.content", "$.text").alias("text"), F.get_json_object("b.content", "$.source.original_size").cast("int").alias("size"))
)


def _calls(spark: SparkSession, sf_dir: str) -> logs.Logs:
    """Events as tool uses and, for most, their results, each user's in a file of its own."""
    events = canonical.read(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), "event_id", "event_type", "props")
    use = F.to_json(_object(type=F.lit("assistant"), uuid=F.col("event_id").cast("string"), message=_object(role=F.lit("assistant"), content=F.array(_object(type=F.lit("tool_use"), id=F.col("event_id").cast("string"), name=F.col("event_type"), input=_object(n=F.col("event_id")))))))
    result = F.to_json(_object(type=F.lit("user"), message=_object(role=F.lit("user"), content=F.array(_object(type=F.lit("tool_result"), tool_use_id=F.col("event_id").cast("string"), content=F.col("props"), is_error=F.col("event_type") == "error")))))
    uses = events.select("conv_id", (F.col("event_id") * 2).alias("turn"), use.alias("line"))
    both = uses.union(events.where("event_id % 4 <> 0").select("conv_id", (F.col("event_id") * 2 + 1).alias("turn"), result.alias("line")))
    return logs.claude_code(_files(both, F.col("line"), F.concat(F.lit("/c/"), _id(), F.lit(".jsonl"))))


over_tables("src09_linked_calls", """SELECT '/c/' || user_id || '.jsonl' AS path, CAST(event_id AS VARCHAR) AS id, event_type AS name, '{"n":' || event_id || '}' AS input, CASE WHEN event_id % 4 <> 0 THEN props END AS content,
  CASE WHEN event_id % 4 = 0 THEN 'pending' WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status FROM events""")(
    lambda s, d: logs.linked_calls(_calls(s, d).records).select("path", "id", "name", "input", F.get_json_object("result", "$.content").alias("content"), "status")
)
over_tables("src10_time_bounds", f"WITH {_T} SELECT '/h/.claude/projects/p/' || conv_id || '.jsonl' AS path, min(ts) AS first, max(ts) AS last FROM t WHERE role IN ('user', 'assistant') GROUP BY conv_id")(lambda s, d: logs.time_bounds(typed(s, d).records))

_PLACES = ["/h/.claude/projects/p/{}.jsonl", "/h/.codex/sessions/2024/{}.jsonl", "/h/.gemini/tmp/x/chats/{}.json", "/w/{}/.aider.chat.history.md", "/h/.claude/{}.jsonl"]
over_tables("src08_discovered", "SELECT page_id, ['claude_code', 'codex_cli', 'gemini_cli', 'aider'][page_id % 5 + 1] AS harness FROM pages WHERE page_id % 5 < 4")(
    lambda s, d: logs.discovered(canonical.read(s, d, "pages").select("page_id", F.replace(F.get(F.array(*map(F.lit, _PLACES)), (F.col("page_id") % 5).cast("int")), F.lit("{}"), F.col("page_id").cast("string")).alias("path"))).select("page_id", "harness")
)

# --- The store made of the records -------------------------------------------------------------------------------------


def _store(spark: SparkSession, sf_dir: str) -> schema.Store:
    return logs.flatten(typed(spark, sf_dir), AT)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, read again, and counted."""
    path = new_path(spark, "store")
    made = _store(spark, sf_dir)
    schema.write_store(schema.empty_store(spark) | made, path)
    again = schema.read_store(spark, path)
    counts = [again[t].agg(F.lit(t).alias("table"), F.count("*").alias("rows")) for t in ("conversations", "prompts", "prompt_content", "responses", "response_content", "response_attributes", "models", "workspaces", "tool_calls")]
    out = counts[0]
    for more in counts[1:]:
        out = out.union(more)
    return out


_ANSWERS = f"{_T}, a AS (SELECT * FROM t WHERE role = 'assistant' AND EXISTS (SELECT 1 FROM conversations u WHERE u.conv_id = t.conv_id AND u.role = 'user' AND u.turn < t.turn)), u AS (SELECT * FROM t WHERE role = 'user')"
over_tables("src13_store_scan", f"""WITH {_ANSWERS} SELECT 'conversations' AS "table", count(DISTINCT conv_id) AS rows FROM u UNION ALL SELECT 'prompts', count(*) FROM u UNION ALL SELECT 'prompt_content', count(*) FROM u
UNION ALL SELECT 'responses', count(*) FROM a UNION ALL SELECT 'response_content', count(*) FROM a UNION ALL SELECT 'response_attributes', count(*) FROM a WHERE conv_id % 3 = 0 AND turn * 10 <> 0 UNION ALL SELECT 'models', count(DISTINCT conv_id % 2) FROM a
UNION ALL SELECT 'workspaces', count(DISTINCT conv_id % 5) FROM u UNION ALL SELECT 'tool_calls', 0""")(_stored)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = {name: settled(table) for name, table in _store(spark, sf_dir).items() if name in ("prompts", "prompt_content", "responses", "response_content")}
    said = lambda table, key: store[table].select(key, F.get_json_object("content", "$.text").alias(table))
    rows = store["responses"].select(F.col("id").alias("response_id"), "prompt_id", F.col("external_id").alias("answer")).join(said("response_content", "response_id"), "response_id")
    rows = rows.join(store["prompts"].select(F.col("id").alias("prompt_id"), F.col("external_id").alias("asked")), "prompt_id").join(said("prompt_content", "prompt_id"), "prompt_id")
    return rows.select("asked", "answer", F.col("prompt_content").alias("prompt"), F.col("response_content").alias("response"))


over_tables("snk01_flatten", f"""WITH {_ANSWERS}, p AS (SELECT a.conv_id, a.turn, a.text, max(u.turn) AS asked FROM a JOIN u ON u.conv_id = a.conv_id AND u.turn < a.turn GROUP BY ALL)
SELECT 'claude_code::' || p.conv_id || '-' || p.asked AS asked, 'claude_code::' || p.conv_id || '-' || p.turn AS answer, u.text AS prompt, p.text AS response FROM p JOIN u ON u.conv_id = p.conv_id AND u.turn = p.asked""")(_answers)


def _backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store without attributes, and what its logs still say of them."""
    found = typed(spark, sf_dir)
    store = {name: settled(table) for name, table in logs.flatten(found, AT).items() if name in ("conversations", "responses", "response_attributes")}
    bare = store | {"response_attributes": store["response_attributes"].limit(0)}
    done = maintenance.backfill_attributes(bare, found)["response_attributes"]
    return done.join(store["responses"].select(F.col("id").alias("response_id"), "external_id"), "response_id").select("external_id", "key", "value", "scope")


over_tables("jon14_backfilled_attributes", f"WITH {_ANSWERS} SELECT 'claude_code::' || conv_id || '-' || turn AS external_id, 'cache_read_input_tokens' AS key, CAST(turn * 10 AS VARCHAR) AS value, 'provider' AS scope FROM a WHERE conv_id % 3 = 0 AND turn > 0")(_backfilled)

# --- Live sessions -----------------------------------------------------------------------------------------------------

_SESSIONS = f"{_T}, s AS (SELECT conv_id, count(*) FILTER (role = 'user') AS exchanges, max(ts) AS last_activity FROM t WHERE role IN ('user', 'assistant') GROUP BY conv_id HAVING bool_or(role = 'user'))"
over_tables("str09_session_list", f"WITH {_SESSIONS} SELECT CAST(conv_id AS VARCHAR) AS session_id, exchanges, last_activity FROM s")(lambda s, d: live.session_list(typed(s, d)).select("session_id", "exchanges", "last_activity"))
over_tables("srt09_latest_sessions", f"WITH {_SESSIONS} SELECT CAST(conv_id AS VARCHAR) AS session_id FROM s ORDER BY last_activity DESC, '/h/.claude/projects/p/' || conv_id || '.jsonl' LIMIT 15")(lambda s, d: live.session_list(typed(s, d), limit=15).select("session_id"))
over_tables("str13_in_workspace", f"WITH {_SESSIONS} SELECT CAST(conv_id AS VARCHAR) AS session_id FROM s WHERE conv_id % 5 = 3")(lambda s, d: live.filtered(live.session_list(typed(s, d)), main_only=True, workspace="W/3").select("session_id"))
over_tables("str11_by_prefix", f"WITH {_SESSIONS} SELECT CAST(conv_id AS VARCHAR) AS session_id FROM s WHERE CAST(conv_id AS VARCHAR) LIKE '1%'")(lambda s, d: live.by_prefix(live.session_list(typed(s, d)), "1").select("session_id"))
over_tables("str10_live_exchanges", f"""WITH {_ANSWERS}, x AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS exchange, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS until FROM u)
SELECT '/h/.claude/projects/p/' || x.conv_id || '.jsonl' AS path, exchange, x.text AS prompt_text, coalesce(string_agg(a.text, chr(10) ORDER BY a.turn), '') AS response_text, CAST(coalesce(sum(length(a.text)), 0) AS BIGINT) AS output_tokens
FROM x LEFT JOIN a ON a.conv_id = x.conv_id AND a.turn > x.turn AND (x.until IS NULL OR a.turn < x.until) GROUP BY ALL""")(lambda s, d: live.live_exchanges(typed(s, d)).select("path", "exchange", "prompt_text", "response_text", "output_tokens"))
over_tables("str12_last_exchange", f"WITH {_T}, u AS (SELECT * FROM t WHERE role = 'user') SELECT '/h/.claude/projects/p/' || conv_id || '.jsonl' AS path, text AS prompt_text FROM u QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")(lambda s, d: live.live_exchanges(typed(s, d), last=1).select("path", "prompt_text"))
over_tables("str08_live_files", "SELECT page_id FROM pages WHERE page_id % 100 <= 20")(
    lambda s, d: live.live_files(canonical.read(s, d, "pages").select("page_id", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("page_id") % 100 * 360).alias("modified")), F.timestamp_seconds(F.lit(1_700_000_000))).select("page_id")
)

# --- Names and blocks ----------------------------------------------------------------------------------------------------

_NAMES = ["claude-opus-4-5-20251101", "claude-3-5-sonnet-20241022", "claude-3-haiku-20240307", "gemini-2.5-pro-preview", "gemini-2.0-flash", "claude-opus-4-20250514", "gpt-x", "claude-3-5-sonnet-latest"]
over_tables("fn08_model_parts", """SELECT p_partkey, 'claude-' || p_size || '-' || v AS name, CAST(p_size AS VARCHAR) AS version, v AS variant, '2024-' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS released
FROM (SELECT *, CASE WHEN p_retailprice < 1000 THEN 'opus' WHEN p_brand < 'Brand#3' THEN 'sonnet' ELSE 'haiku' END AS v FROM part)""")(
    lambda s, d: canonical.read(s, d, "part").select("p_partkey", scalars.model_name(F.concat_ws("-", F.lit("claude"), "p_size", F.when(F.col("p_retailprice") < 1000, "opus").when(F.col("p_brand") < "Brand#3", "sonnet").otherwise("haiku"), F.concat(F.lit("2024"), F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0")))).alias("m"))
    .select("p_partkey", "m.name", "m.version", "m.variant", "m.released")
)
over_tables("fn08_model_name", """WITH m(k, name, creator, version, variant, released) AS (VALUES (0, 'claude-opus-4-5', 'anthropic', '4.5', 'opus', '2025-11-01'), (1, 'claude-3-5-sonnet', 'anthropic', '3.5', 'sonnet', '2024-10-22'),
  (2, 'claude-3-haiku', 'anthropic', '3', 'haiku', '2024-03-07'), (3, 'gemini-2.5-pro', 'google', '2.5', 'pro', NULL), (4, 'gemini-2.0-flash', 'google', '2.0', 'flash', NULL), (5, 'claude-opus-4-20250514', NULL, NULL, NULL, NULL),
  (6, 'gpt-x', NULL, NULL, NULL, NULL), (7, 'claude-3-5-sonnet-latest', NULL, NULL, NULL, NULL)) SELECT page_id, name, creator, version, variant, released FROM pages JOIN m ON k = page_id % 8""")(
    lambda s, d: canonical.read(s, d, "pages").select("page_id", scalars.model_name(F.get(F.array(*map(F.lit, _NAMES)), (F.col("page_id") % 8).cast("int"))).alias("m")).select("page_id", "m.name", "m.creator", "m.version", "m.variant", "m.released")
)
def _image() -> Column:
    return F.concat(F.lit('{"type":"image","source":{"type":"base64","media_type":"image/png","data":"'), F.repeat(F.lit("A"), (F.col("page_id") % 50).cast("int")), F.lit('"}}'))

over_tables("fn12_without_binary", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id % 50 END AS size, CASE WHEN page_id % 2 = 0 THEN 'binary_content' END AS reason, page_id % 2 = 0 AS candidate FROM pages")(
    lambda s, d: canonical.read(s, d, "pages").withColumn("b", F.when(F.col("page_id") % 2 == 0, _image()).otherwise(F.lit('{"type":"text","text":"x"}'))).select(
        "page_id", F.get_json_object(scalars.without_binary(F.col("b")), "$.source.original_size").cast("long").alias("size"), F.get_json_object(scalars.without_binary(F.col("b")), "$.source.filtered_reason").alias("reason"), scalars.may_hold_binary(F.col("b")).alias("candidate")
    )
)
