"""Session logs as tables: four formats, read whole file by whole file, parsed with column expressions.

Every reader returns the same two tables. sessions: path, harness, external_id, workspace_path, started_at, ended_at. records, in the
order `seq` of the file: path, session (0 unless a file holds several), kind (prompt, response, result), external_id, timestamp, model, input_tokens,
output_tokens, attributes (map), blocks (array of block_type and JSON content), uses (array of id, name, input: tools called), results (array of id, result,
status, timestamp). flatten() makes the store's tables of them: the exchange a record belongs to is a running count of prompts.

A file is one row: it is bounded by what a session writes, and files spread over the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.functions.scalars import short_number, stable_id, strip, without_binary
from threadmill.operators.exchanges import fold
from threadmill.schema import Store, conform

BLOCKS = "array<struct<block_type:string,content:string>>"
USES = "array<struct<id:string,name:string,input:string>>"
RESULTS = "array<struct<id:string,result:string,status:string,timestamp:string>>"

# --- Fixed values: raw tool names of each harness, and what they are called here ---------------------------------------
CLAUDE_CODE_TOOLS = {
    "Read": "file.read", "Write": "file.write", "Edit": "file.edit", "Glob": "file.glob", "Bash": "shell.execute", "Grep": "search.grep", "WebSearch": "search.web", "WebFetch": "web.fetch",
    "Task": "task.spawn", "TaskOutput": "task.output", "KillShell": "task.kill", "AskUserQuestion": "ui.ask", "TodoWrite": "ui.todo", "NotebookEdit": "notebook.edit", "Skill": "skill.invoke",
}
CODEX_TOOLS = {"shell_command": "shell.execute", "exec_command": "shell.execute", "apply_patch": "file.edit", "update_plan": "ui.todo", "view_image": "file.read", "write_stdin": "shell.stdin"}
GEMINI_TOOLS = {"read_file": "file.read", "write_file": "file.write", "edit_file": "file.edit", "run_shell_command": "shell.execute", "search_files": "search.grep", "list_files": "file.glob"}
#: harness: (source, log format, tool names, by what a session is told from another)
HARNESSES = {
    "claude_code": ("anthropic", "jsonl", CLAUDE_CODE_TOOLS, "file"),
    "codex_cli": ("openai", "jsonl", CODEX_TOOLS, "file"),
    "gemini_cli": ("google", "json", GEMINI_TOOLS, "session"),
    "aider": ("aider", "markdown", {}, "file"),
}


@dataclass
class Logs:
    sessions: DataFrame
    records: DataFrame
    #: Files that can't be read: path, error.
    errors: DataFrame


def files(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """SRC-08: path, text, file_hash (SHA-256) and modified of the files below path whose names fit."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return rows.select("path", F.decode("content", "utf-8").alias("text"), F.sha2("content", 256).alias("file_hash"), F.col("modificationTime").alias("modified"))


def json_lines(files: DataFrame) -> DataFrame:
    """Lines of files: path, seq, line, v (variant, null where a line is no JSON); blank lines are left out. Instead of files, lines as sources.lines reads them: of large files, seq being the first byte."""
    if "line" in files.columns:
        return files.select("path", "seq", "line", F.try_parse_json("line").alias("v"))
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("seq", "line")).where(F.length(F.trim("line")) > 0)
    return lines.withColumn("v", F.try_parse_json("line"))


def strict(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-05: the lines of files all of whose lines are JSON, and the other files with an error."""
    bad = lines.where("v IS NULL").groupBy("path").agg(F.concat(F.lit("line "), (F.min("seq") + 1).cast("string"), F.lit(" is no JSON")).alias("error"))
    return lines.join(bad.select("path"), "path", "left_anti"), bad


def tolerant(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-06: the lines that are JSON, and the others: path, line number, its first 200 characters."""
    return lines.where("v IS NOT NULL"), lines.where("v IS NULL").select("path", (F.col("seq") + 1).alias("line_no"), F.substring("line", 1, 200).alias("raw"))


def _get(path: str, kind: str = "string", v: str = "v") -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def _json(c: Column) -> Column:
    return F.to_json(c)


def content_elements(path: str) -> Column:
    """SRC-16: a JSON array's elements as variants; a string or an object as the only one; nothing for null. path: in the column v."""
    c = _get(path, "variant")
    kind = F.schema_of_variant(c)
    return F.when(kind.startswith("ARRAY"), _get(path, "array<variant>")).when(c.isNull() | (kind == "VOID"), F.array().cast("array<variant>")).otherwise(F.array(c))


def _text_block(text: Column, kind: str = "text") -> Column:
    return F.struct(F.lit(kind).alias("block_type"), F.to_json(F.struct(text.alias("text"))).alias("content"))


def _block(b: Column) -> Column:
    """SRC-07: a string is a text block; an object is one of its type, without binary data."""
    kind = F.coalesce(F.try_variant_get(b, "$.type", "string"), F.lit("unknown"))
    return F.when(F.schema_of_variant(b) == "STRING", _text_block(F.try_variant_get(b, "$", "string"))).otherwise(F.struct(kind.alias("block_type"), without_binary(F.to_json(b)).alias("content")))


def _record(**given: Column) -> list[Column]:
    none = {"session": "int", "kind": "string", "external_id": "string", "timestamp": "string", "model": "string", "input_tokens": "bigint", "output_tokens": "bigint", "attributes": "map<string,string>", "blocks": BLOCKS, "uses": USES, "results": RESULTS}
    missing = {"session": F.lit(0), "attributes": F.map_from_arrays(F.array(), F.array()), "blocks": F.array(), "uses": F.array(), "results": F.array()}
    return [F.col("path"), F.col("seq"), *(given.get(k, missing.get(k, F.lit(None))).cast(t).alias(k) for k, t in none.items())]


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def claude_code(files_: DataFrame) -> Logs:
    """SRC-01: JSON lines of typed messages. A user message with tool results is no prompt; sub-agents have sessions of their own."""
    lines, errors = strict(json_lines(files_))
    rows = lines.withColumn("type", _get("$.type")).where(F.col("type").isin("user", "assistant"))
    first = lambda p: F.min_by(_get(p), F.when(_get(p).isNotNull(), F.col("seq")))
    found = rows.groupBy("path").agg(first("$.sessionId").alias("session"), first("$.agentId").alias("agent"), first("$.cwd").alias("workspace_path"), F.min(_get("$.timestamp")).alias("started_at"), F.max(_get("$.timestamp")).alias("ended_at"))
    name = F.concat_ws("::", F.lit("claude_code"), F.coalesce("session", _stem(F.col("path"))), F.when(F.col("agent").isNotNull(), F.concat(F.lit("agent::"), F.col("agent"))))
    elements = content_elements("$.message.content")
    of_type = lambda t: F.filter(elements, lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == t, F.lit(False)))
    role = F.coalesce(_get("$.message.role"), F.col("type"))
    results = F.transform(of_type("tool_result"), lambda b: F.struct(
        F.try_variant_get(b, "$.tool_use_id", "string").alias("id"),
        F.concat(F.lit('{"content":'), F.coalesce(F.to_json(F.try_variant_get(b, "$.content", "variant")), F.lit("null")), F.lit("}")).alias("result"),
        F.when(F.coalesce(F.try_variant_get(b, "$.is_error", "boolean"), F.lit(False)), "error").otherwise("success").alias("status"),
        _get("$.timestamp").alias("timestamp"),
    ))
    uses = F.transform(of_type("tool_use"), lambda b: F.struct(F.try_variant_get(b, "$.id", "string").alias("id"), F.coalesce(F.try_variant_get(b, "$.name", "string"), F.lit("unknown")).alias("name"), F.coalesce(F.to_json(F.try_variant_get(b, "$.input", "variant")), F.lit("{}")).alias("input")))
    kind = F.when((role == "user") & (F.size(results) > 0), "result").when(role == "user", "prompt").when(role == "assistant", "response")
    cache = ["cache_creation_input_tokens", "cache_read_input_tokens"]
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), _get(f"$.message.usage.{k}").alias("value")) for k in cache)), lambda e: e["value"].isNotNull() & (e["value"] != "0"))
    is_response = role == "assistant"
    records = rows.select(*_record(
        kind=kind, external_id=F.concat(F.lit("claude_code::"), _get("$.uuid")), timestamp=_get("$.timestamp"), model=F.when(is_response, _get("$.message.model")),
        input_tokens=_get("$.message.usage.input_tokens", "bigint"), output_tokens=_get("$.message.usage.output_tokens", "bigint"), attributes=F.map_from_entries(entries),
        blocks=F.transform(elements, _block), uses=F.when(is_response, uses).otherwise(F.array().cast(USES)), results=F.when(kind == "result", results).otherwise(F.array().cast(RESULTS)),
    ))
    some = records.where("kind = 'prompt'").select("path").distinct()
    sessions = found.join(some, "path", "left_semi").select("path", F.lit(0).alias("session"), F.lit("claude_code").alias("harness"), name.alias("external_id"), "workspace_path", "started_at", "ended_at")
    return Logs(sessions, records, errors)


def codex_cli(files_: DataFrame) -> Logs:
    """SRC-02: JSON lines of events with payloads. Calls belong to the last answer of the prompt; their arguments are JSON in a string; all finished calls are successes."""
    lines, errors = strict(json_lines(files_))
    rows = lines.select("path", "seq", "v", _get("$.type").alias("type"), _get("$.timestamp").alias("ts"), _get("$.payload.type").alias("item"), _get("$.payload.role").alias("role"))
    last = lambda p: F.max_by(_get(p), F.when(F.col("type") == "session_meta", F.col("seq")))
    model = F.min_by(_get("$.payload.model"), F.when((F.col("type") == "turn_context") & _get("$.payload.model").isNotNull(), F.col("seq")))
    found = rows.groupBy("path").agg(last("$.payload.id").alias("id"), last("$.payload.cwd").alias("workspace_path"), model.alias("model"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    items = rows.where("type = 'response_item'").join(found.select("path", "model"), "path")
    call_id, name = _get("$.payload.call_id"), F.coalesce(_get("$.payload.name"), F.lit("unknown"))
    arguments = F.coalesce(_get("$.payload.arguments"), F.lit("{}"))
    raw = lambda x: F.to_json(F.struct(x.alias("raw")))
    text_input, any_input = _get("$.payload.input"), F.to_json(_get("$.payload.input", "variant"))
    tool_input = F.when(F.col("item") == "function_call", F.when(F.try_parse_json(arguments).isNotNull(), arguments).otherwise(raw(arguments))).otherwise(F.when(F.schema_of_variant(_get("$.payload.input", "variant")).startswith("OBJECT"), any_input).otherwise(raw(F.coalesce(text_input, F.lit("")))))
    is_call = F.col("item").isin("function_call", "custom_tool_call")
    is_output = F.col("item").isin("function_call_output", "custom_tool_call_output")
    kind = F.when((F.col("item") == "message") & (F.col("role") == "user"), "prompt").when((F.col("item") == "message") & (F.col("role") == "assistant"), "response").when(is_call, "call").when(is_output, "result")
    rename = lambda b: F.when(F.try_variant_get(b, "$.type", "string").isin("input_text", "output_text"), _text_block(F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))).otherwise(_block(b))
    use = F.struct(call_id.alias("id"), name.alias("name"), tool_input.alias("input"))
    use_block = F.struct(F.lit("tool_use").alias("block_type"), F.concat(F.lit('{"id":'), F.coalesce(F.to_json(_get("$.payload.call_id", "variant")), F.lit("null")), F.lit(',"name":"'), name, F.lit('","input":'), tool_input, F.lit("}")).alias("content"))
    result = F.struct(call_id.alias("id"), F.concat(F.lit('{"output":'), F.coalesce(F.to_json(_get("$.payload.output", "variant")), F.lit('""')), F.lit("}")).alias("result"), F.lit("success").alias("status"), F.col("ts").alias("timestamp"))
    records = items.withColumn("kind", kind).where("kind IS NOT NULL").select(*_record(
        kind=F.col("kind"), timestamp=F.col("ts"), model=F.when(F.col("kind").isin("response", "call"), F.col("model")),
        blocks=F.when(is_call, F.array(use_block)).otherwise(F.transform(content_elements("$.payload.content"), rename)), uses=F.when(is_call, F.array(use)).otherwise(F.array().cast(USES)), results=F.when(is_output, F.array(result)).otherwise(F.array().cast(RESULTS)),
    ))
    sessions = found.select("path", F.lit(0).alias("session"), F.lit("codex_cli").alias("harness"), F.concat_ws("::", F.lit("codex_cli"), F.coalesce("id", _stem(F.col("path")))).alias("external_id"), "workspace_path", "started_at", "ended_at")
    return Logs(sessions, records, errors)


def gemini_cli(files_: DataFrame, known_paths: DataFrame | None = None) -> Logs:
    """SRC-03: one JSON object a file. Thoughts are blocks, calls carry their result. known_paths (path) names projects by their SHA-256 (SRC-12)."""
    rows = files_.select("path", F.try_parse_json("text").alias("v"))
    errors = rows.where("v IS NULL").select("path", F.lit("the file is no JSON").alias("error"))
    rows = rows.where(_get("$.messages", "variant").isNotNull())
    found = rows.select("path", F.coalesce(_get("$.sessionId"), _stem(F.col("path"))).alias("id"), _get("$.projectHash").alias("hash"), _get("$.startTime").alias("started_at"), _get("$.lastUpdated").alias("ended_at"))
    named = F.lit(None).cast("string")
    if known_paths is not None:
        found = found.join(known_paths.select(F.sha2("path", 256).alias("hash"), F.col("path").alias("workspace_path")), "hash", "left")
        named = F.col("workspace_path")
    sessions = found.select("path", F.lit(0).alias("session"), F.lit("gemini_cli").alias("harness"), F.concat(F.lit("gemini_cli::"), F.col("id")).alias("external_id"), named.alias("workspace_path"), "started_at", "ended_at")
    messages = rows.select("path", F.posexplode(_get("$.messages", "array<variant>")).alias("seq", "v"))
    text = F.nullif(_get("$.content"), F.lit(""))
    texts = F.when(text.isNotNull(), F.array(_text_block(text))).otherwise(F.array().cast(BLOCKS))
    thoughts = F.transform(content_elements("$.thoughts"), lambda t: F.struct(F.lit("thinking").alias("block_type"), F.to_json(F.struct(*(F.try_variant_get(t, f"$.{k}", "string").alias(k) for k in ("subject", "description", "timestamp")))).alias("content")))
    calls = content_elements("$.toolCalls")
    name = lambda c: F.coalesce(F.try_variant_get(c, "$.name", "string"), F.lit("unknown"))
    args = lambda c: F.coalesce(F.to_json(F.try_variant_get(c, "$.args", "variant")), F.lit("{}"))
    uses = F.transform(calls, lambda c: F.struct(F.try_variant_get(c, "$.id", "string").alias("id"), name(c).alias("name"), args(c).alias("input")))
    results = F.transform(calls, lambda c: F.struct(F.try_variant_get(c, "$.id", "string").alias("id"), F.to_json(F.try_variant_get(c, "$.result[0].functionResponse.response", "variant")).alias("result"), F.coalesce(F.try_variant_get(c, "$.status", "string"), F.lit("pending")).alias("status"), F.try_variant_get(c, "$.timestamp", "string").alias("timestamp")))
    use_blocks = F.transform(uses, lambda u: F.struct(F.lit("tool_use").alias("block_type"), F.to_json(F.struct(u["id"].alias("id"), u["name"].alias("name"), F.parse_json(u["input"]).alias("input"))).alias("content")))
    is_response = _get("$.type") == "gemini"
    kind = F.when(_get("$.type") == "user", "prompt").when(is_response, "response")
    records = messages.select(*_record(
        kind=kind, external_id=F.concat(F.lit("gemini_cli::"), _get("$.id")), timestamp=F.coalesce(_get("$.timestamp"), F.lit("")), model=F.when(is_response, _get("$.model")),
        input_tokens=_get("$.tokens.input", "bigint"), output_tokens=_get("$.tokens.output", "bigint"), blocks=F.when(is_response, F.concat(thoughts, texts, use_blocks)).otherwise(texts),
        uses=F.when(is_response, uses).otherwise(F.array().cast(USES)), results=F.when(is_response, results).otherwise(F.array().cast(RESULTS)),
    )).where("kind IS NOT NULL")
    return Logs(sessions, records, errors)


_STARTED = r"^# aider chat started at (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
_COST = r"Tokens:\s*([\d.,]+[kKmM]?)\s*sent,\s*([\d.,]+[kKmM]?)\s*received\.(?:\s*Cost:\s*\$([\d.,]+))?"


def aider(files_: DataFrame) -> Logs:
    """SRC-04: Markdown histories. Lines after `#### ` are the user's, after `> ` a tool's, others the assistant's; neighbouring lines of one kind are one message.

    A file holds many sessions; all are returned, numbered from 0 (first_sessions keeps one). All times are the session's start."""
    lines = files_.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    in_file = Window.partitionBy("path").orderBy("line_no")
    start = F.regexp_extract("line", _STARTED, 1)
    rows = lines.withColumn("starts", (start != "").cast("int")).withColumn("session", F.sum("starts").over(in_file) - 1).where("session >= 0")
    at = F.max(F.when(F.col("starts") == 1, F.regexp_replace(start, " ", "T"))).over(Window.partitionBy("path", "session"))
    rows = rows.withColumn("started_at", at).where("starts = 0")
    who = F.when(F.col("line").startswith("#### "), "user").when(F.col("line").startswith("> "), "tool").otherwise("assistant")
    said = F.when(who == "user", F.expr("substring(line, 6)")).when(who == "tool", F.expr("substring(line, 3)")).otherwise(F.col("line"))
    rows = rows.withColumn("who", who).withColumn("said", said)
    in_session = Window.partitionBy("path", "session").orderBy("line_no")
    rows = rows.withColumn("run", F.sum(F.coalesce((F.lag("who").over(in_session) != F.col("who")).cast("int"), F.lit(1))).over(in_session))
    texts = rows.groupBy("path", "session", "run", "who", "started_at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "said"))), lambda x: x["said"]), "\n").alias("text"))
    texts = texts.withColumn("text", strip(F.col("text"))).where("text <> ''").withColumn("seq", F.col("run"))
    part = lambda k: F.regexp_extract("text", _COST, k)
    entries = F.array(F.struct(F.lit("approx_input_tokens").alias("key"), short_number(part(1)).cast("string").alias("value")), F.struct(F.lit("approx_output_tokens").alias("key"), short_number(part(2)).cast("string").alias("value")), F.struct(F.lit("approx_cost").alias("key"), F.nullif(part(3), F.lit("")).alias("value")))
    kind = F.when(F.col("who") == "user", "prompt").when(F.col("who") == "assistant", "response").otherwise("call")
    block = F.when(F.col("who") == "tool", F.array(_text_block(F.col("text"), "tool_output"))).otherwise(F.array(_text_block(F.col("text"))))
    records = texts.select(*_record(session=F.col("session"), kind=kind, timestamp=F.col("started_at"), blocks=block, attributes=F.when(F.col("who") == "tool", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))
    found = rows.groupBy("path", "session").agg(F.first("started_at").alias("started_at"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    sessions = found.select("path", "session", F.lit("aider").alias("harness"), F.concat_ws("::", F.lit("aider"), folder, "started_at").alias("external_id"), folder.alias("workspace_path"), "started_at", F.lit(None).cast("string").alias("ended_at"))
    return Logs(sessions, records, files_.sparkSession.createDataFrame([], "path string, error string"))


READERS = {"claude_code": claude_code, "codex_cli": codex_cli, "gemini_cli": gemini_cli, "aider": aider}


def first_sessions(logs: Logs) -> Logs:
    """STR-04, T22: of each file the first session alone."""
    return Logs(logs.sessions.where("session = 0"), logs.records.where("session = 0"), logs.errors)


def time_bounds(records: DataFrame) -> DataFrame:
    """SRC-10: first and last time of each file, as texts."""
    return records.groupBy("path").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def linked_calls(records: DataFrame) -> DataFrame:
    """SRC-09: tools called, with their results; pending where there is none. A result meets the use of its id in its own session."""
    uses = records.select("path", "session", "seq", F.posexplode("uses").alias("k", "u")).select("path", "session", "seq", "k", "u.id", "u.name", "u.input")
    results = records.select("path", "session", F.explode("results").alias("r")).select("path", "session", F.col("r.id").alias("id"), "r.result", "r.status", "r.timestamp").where("id IS NOT NULL")
    first = results.groupBy("path", "session", "id").agg(F.first(F.struct("result", "status", "timestamp")).alias("r"))
    joined = uses.where("id IS NOT NULL").join(first, ["path", "session", "id"], "left")
    return joined.select("path", "session", "seq", "k", "id", "name", "input", "r.result", F.coalesce("r.status", F.lit("pending")).alias("status"), "r.timestamp")


def with_ids(sessions: DataFrame) -> DataFrame:
    """Sessions with the ids that their conversation, harness and workspace have in a store."""
    named = sessions.withColumn("harness_id", stable_id(F.lit("harnesses"), F.col("harness"))).withColumn("workspace_id", F.when(F.col("workspace_path").isNotNull(), stable_id(F.lit("workspaces"), F.col("workspace_path"))))
    return named.withColumn("id", stable_id(F.lit("conversations"), F.col("harness_id"), F.col("external_id")))


def flatten(logs: Logs, at: str) -> Store:
    """SNK-01, T20: sessions and records as the store's tables. Answers before the first prompt are left out; ids come from natural keys, a message's without an id from its place (T25)."""
    harness = logs.sessions.select(F.col("harness").alias("name")).distinct()
    conversations = with_ids(logs.sessions)
    keyed = logs.records.join(conversations.select("path", "session", F.col("id").alias("conversation_id")), ["path", "session"]).withColumn("in", F.struct("path", "session"))
    rows = fold(keyed, "conversation_id", "seq", F.col("kind") == "prompt")
    # A call without an answer before it in its exchange begins one; others join the last answer.
    w = Window.partitionBy("conversation_id", "exchange").orderBy("seq")
    opens = (F.col("kind") == "response") | ((F.col("kind") == "call") & (F.coalesce(F.sum(F.when(F.col("kind").isin("response", "call"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0))
    rows = rows.withColumn("opens", opens).withColumn("answer", F.sum(F.col("opens").cast("int")).over(w))
    rows = rows.withColumn("prompt_id", stable_id(F.lit("prompts"), F.col("conversation_id"), F.col("exchange")))
    rows = rows.withColumn("response_id", F.when(F.col("kind").isin("response", "call"), stable_id(F.lit("responses"), F.col("conversation_id"), F.col("exchange"), F.col("answer"))))
    prompts = rows.where("kind = 'prompt'").select(F.col("prompt_id").alias("id"), "conversation_id", "external_id", F.coalesce("timestamp", F.lit(at)).alias("timestamp"), "blocks")
    answers = rows.where("response_id IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.struct("seq", "blocks", F.map_entries("attributes").alias("entries"))))
    first = F.min_by(F.struct("prompt_id", "external_id", "timestamp", "model", "input_tokens", "output_tokens"), "seq")
    responses = answers.groupBy("conversation_id", F.col("response_id").alias("id")).agg(first.alias("r"), parts.alias("parts"))
    responses = responses.select("id", "conversation_id", "r.*", F.flatten(F.transform("parts", lambda p: p["blocks"])).alias("blocks"), F.flatten(F.transform("parts", lambda p: p["entries"])).alias("entries"))
    calls = linked_calls(logs.records).join(answers.select("path", "session", "seq", "response_id", "conversation_id"), ["path", "session", "seq"])
    aliases = [(raw, tool, h) for h, (_, _, names, _) in HARNESSES.items() for raw, tool in names.items()]
    spark = logs.records.sparkSession
    alias = spark.createDataFrame(aliases, "name string, tool string, harness string")
    calls = calls.join(logs.sessions.select("path", "session", "harness"), ["path", "session"]).join(alias, ["name", "harness"], "left").withColumn("tool", F.coalesce("tool", "name"))
    info = spark.createDataFrame([(h, s, f) for h, (s, f, _, _) in HARNESSES.items()], "name string, source string, log_format string")

    def blocks(table: DataFrame, key: str) -> DataFrame:
        rows = table.select(F.col("id").alias(key), F.posexplode("blocks").alias("block_index", "b")).select(key, "block_index", "b.block_type", "b.content")
        return rows.withColumn("id", stable_id(F.lit(key), F.col(key), F.col("block_index")))

    models = responses.where("model IS NOT NULL").select(F.col("model").alias("raw_name"), F.col("model").alias("name")).distinct().withColumn("id", stable_id(F.lit("models"), F.col("raw_name")))
    source_of = logs.sessions.select("harness").distinct().join(info.select(F.col("name").alias("harness"), "source"), "harness")
    provider = conversations.select(F.col("id").alias("conversation_id"), "harness").join(source_of, "harness").select("conversation_id", stable_id(F.lit("providers"), F.col("source")).alias("provider_id"))
    attributes = responses.select(F.col("id").alias("response_id"), F.explode("entries").alias("e")).groupBy("response_id", F.col("e.key").alias("key")).agg(F.last("e.value").alias("value")).withColumn("scope", F.lit("provider"))
    out = {
        "harnesses": harness.join(info, "name", "left").withColumn("id", stable_id(F.lit("harnesses"), F.col("name"))),
        "providers": source_of.select(F.col("source").alias("name")).distinct().withColumn("id", stable_id(F.lit("providers"), F.col("name"))),
        "workspaces": logs.sessions.where("workspace_path IS NOT NULL").select(F.col("workspace_path").alias("path")).distinct().withColumns({"id": stable_id(F.lit("workspaces"), F.col("path")), "discovered_at": F.lit(at)}),
        "conversations": conversations.withColumn("started_at", F.coalesce("started_at", F.lit(at))),
        "prompts": prompts,
        "prompt_content": blocks(prompts, "prompt_id"),
        "models": models,
        "responses": responses.withColumn("model_id", F.when(F.col("model").isNotNull(), stable_id(F.lit("models"), F.col("model")))).join(provider, "conversation_id", "left"),
        "response_content": blocks(responses, "response_id"),
        "response_attributes": attributes.withColumn("id", stable_id(F.lit("response_attributes"), F.col("response_id"), F.col("key"), F.col("scope"))),
        "tools": calls.select(F.col("tool").alias("name")).distinct().withColumn("id", stable_id(F.lit("tools"), F.col("name"))),
        "tool_calls": calls.select(stable_id(F.lit("tool_calls"), F.col("response_id"), F.col("id"), F.col("k")).alias("id"), "response_id", "conversation_id", stable_id(F.lit("tools"), F.col("tool")).alias("tool_id"), F.col("id").alias("external_id"), "input", F.when(~F.col("result").isin("{}", "null", ""), F.col("result")).alias("result"), "status", "timestamp"),
    }
    return {name: conform(table, name) for name, table in out.items()}


# --- Readers by name and by path (SRC-14, SRC-17, SRC-18, EXT-01) ---------------------------------------------------------

#: Where each harness keeps its logs, as patterns of paths.
PLACES = {
    "claude_code": r"/\.claude/projects/.*\.jsonl$",
    "codex_cli": r"/\.codex/sessions/.*\.jsonl$",
    "gemini_cli": r"/\.gemini/tmp/[^/]+/chats/.*\.json$",
    "aider": r"/\.aider\.chat\.history\.md$",
}


#: Where readers come from, the least first: of one name the last counts, and of places that both fit a path, too.
ORIGINS = ("built in", "package", "drop-in")
_ORIGIN: dict[str, str] = {}


def register(name: str, reader, source: str, log_format: str, tools: dict[str, str] | None = None, by: str = "file", place: str | None = None, origin: str = "drop-in") -> bool:
    """A reader of one's own: it takes files and returns Logs. One of a known name takes its place, unless that comes from a stronger origin (SET-09); whether it did. by: whether a file or a
    session is what is new."""
    if not name or "::" in name or not callable(reader) or by not in ("file", "session") or origin not in ORIGINS:
        raise ValueError("a reader needs a name without '::', a function of files, an origin, and to go by file or by session")
    if name in READERS and ORIGINS.index(origin) < ORIGINS.index(_ORIGIN.get(name, ORIGINS[0])):
        return False
    _ORIGIN[name] = origin
    HARNESSES[name] = (source, log_format, dict(tools or {}), by)
    READERS[name] = reader
    if place:
        PLACES[name] = place
    return True


def unregister(name: str) -> None:
    """Forget a reader."""
    for known in (HARNESSES, READERS, PLACES, _ORIGIN):
        known.pop(name, None)


def harness_of(path: Column) -> Column:
    """The harness whose place a path is in, of the strongest origin where several fit; null for other paths."""
    places = sorted(PLACES.items(), key=lambda x: -ORIGINS.index(_ORIGIN.get(x[0], ORIGINS[0])))
    return F.coalesce(*(F.when(path.rlike(pattern), F.lit(name)) for name, pattern in places))


def discovered(files_: DataFrame) -> DataFrame:
    """SRC-08: files with their harness, without those of none."""
    return files_.withColumn("harness", harness_of(F.col("path"))).where("harness IS NOT NULL")
