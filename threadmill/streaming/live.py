"""Live sessions: what files that were written lately say, without the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.operators.analytics import tool_counts
from threadmill.operators.exchanges import fold
from threadmill.sources.logs import Logs

LIVE_SECONDS = 7200


def live_files(files: DataFrame, as_of: Column, seconds: int = LIVE_SECONDS) -> DataFrame:
    """STR-08: files modified within so many seconds."""
    return files.where(F.unix_timestamp("modified") >= F.unix_timestamp(as_of) - seconds)


def session_list(logs: Logs, modified: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """STR-08, STR-09, SRT-09: sessions with first and last time, exchanges, last model, whether they are of a sub-agent; latest first."""
    of = logs.records.groupBy("path", "session").agg(F.count(F.when(F.col("kind") == "prompt", 1)).alias("exchanges"), F.max_by("model", F.when(F.col("model").isNotNull(), F.col("seq"))).alias("model"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))
    rows = logs.sessions.join(of, ["path", "session"], "left").withColumn("parent", F.nullif(F.regexp_extract("external_id", r"^(.*)::agent::", 1), F.lit("")))
    rows = rows.withColumns({"session_id": F.element_at(F.split("external_id", "::"), -1), "last_activity": F.coalesce("last_at", "ended_at", "started_at")})
    if modified is not None:
        rows = rows.join(modified.select("path", "modified"), "path")
    order = [F.desc("last_activity"), F.asc("path"), F.asc("session")]
    return rows.orderBy(*order) if limit is None else rows.orderBy(*order).limit(limit)


def filtered(sessions: DataFrame, main_only: bool = False, children_of: str | None = None, workspace: str | None = None, branch: str | None = None) -> DataFrame:
    """STR-13: main sessions only, those of one parent, those whose workspace or branch holds a text, whatever the case."""
    out = sessions
    if main_only:
        out = out.where("parent IS NULL")
    if children_of:
        out = out.where(F.col("parent").endswith(children_of))
    if workspace:
        out = out.where(F.lower("workspace_path").contains(workspace.lower()))
    if branch:
        out = out.where(F.lower("branch").contains(branch.lower()))
    return out


def shortest_names(rows: DataFrame, path: str) -> DataFrame:
    """FN-27: (path, name): of each path the shortest end, in whole parts, that no other path has."""
    paths = rows.select(F.col(path).alias("path")).where("path IS NOT NULL").distinct()
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    ends = paths.withColumn("parts", parts).select("path", F.explode(F.sequence(F.lit(1), F.greatest(F.size("parts"), F.lit(1)))).alias("n"), "parts").select("path", "n", F.array_join(F.slice("parts", -F.col("n"), F.col("n")), "/").alias("name"))
    once = ends.groupBy("name").agg(F.count("*").alias("c")).where("c = 1").select("name")
    best = ends.join(once, "name").groupBy("path").agg(F.min_by("name", "n").alias("name"))
    return paths.join(best, "path", "left").select("path", F.coalesce("name", "path").alias("name"))


def by_prefix(sessions: DataFrame, prefix: str) -> DataFrame:
    """STR-11: sessions whose id begins so; sub-agents only where no main session does. More than one row means the prefix is ambiguous."""
    rows = sessions.where(F.col("session_id").startswith(prefix) | F.element_at(F.split("external_id", "::"), 2).startswith(prefix))
    main = rows.agg(F.count(F.when(F.col("parent").isNull(), 1)).alias("__main"))
    return rows.crossJoin(F.broadcast(main)).where("parent IS NULL OR __main = 0").drop("__main")  # one row


def live_exchanges(logs: Logs, last: int | None = None) -> DataFrame:
    """STR-10, STR-12: of each session its exchanges: prompt and answer texts, tokens, tools used, in order; the last so many."""
    rows = fold(logs.records.withColumn("key", F.concat_ws("#", "path", "session")), "key", "seq", F.col("kind") == "prompt")
    text = lambda kind: F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", "blocks")))), lambda r: F.transform(F.filter(r["blocks"], lambda b: b["block_type"] == "text"), lambda b: F.get_json_object(b["content"], "$.text")))), "\n")
    said = rows.groupBy("key", "path", "session", "exchange").agg(F.min("timestamp").alias("timestamp"), text("prompt").alias("prompt_text"), text("response").alias("response_text"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
    uses = rows.select("key", "exchange", "seq", F.posexplode("uses").alias("k", "u")).select(F.concat_ws("#", "key", "exchange").alias("id"), F.struct("seq", "k").alias("place"), F.col("u.name").alias("tool"))
    out = said.join(tool_counts(uses, "id").withColumnRenamed("id", "__id"), F.concat_ws("#", "key", "exchange") == F.col("__id"), "left").drop("__id", "key")
    if last is None:
        return out
    w = Window.partitionBy("path", "session").orderBy(F.desc("exchange"))
    return out.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= last).drop("__k")


def tail(lines: DataFrame, n: int) -> DataFrame:
    """SRC-11: the last n lines of each file."""
    w = Window.partitionBy("path").orderBy(F.desc("seq"))
    return lines.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")
