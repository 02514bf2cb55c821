"""Exports: conversations as Markdown or JSON, one text a conversation; selections of what to export; saved query texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.operators.exchanges import numbered
from threadmill.schema import Store

#: Characters of an answer in an export of exchanges.
ANSWER_CHARS = 500
LAST = 10


def selected(store: Store, prefixes: list[str] | None = None, ids: DataFrame | None = None, last: int = LAST) -> DataFrame:
    """RET-24: ids of conversations that begin with one of the prefixes, or of the last ones among ids."""
    rows = store["conversations"] if ids is None else store["conversations"].join(ids.select("id"), "id", "left_semi")
    if prefixes:
        from threadmill.functions.scalars import any_of

        return rows.where(any_of([F.col("id").startswith(p) for p in prefixes])).select("id")
    return rows.orderBy(F.desc("started_at"), "id").limit(last).select("id")


def _documents(parts: DataFrame, joiner: str = "\n\n") -> DataFrame:
    """(conversation_id, place, part) as one text a conversation."""
    rows = F.array_sort(F.collect_list(F.struct("place", "part")))
    return parts.groupBy("conversation_id").agg(F.array_join(F.transform(rows, lambda r: r["part"]), joiner).alias("document"))


def prompts_markdown(exchanges: DataFrame) -> DataFrame:
    """SNK-05: the prompts, numbered."""
    rows = numbered(exchanges.where("prompt_text <> ''"))
    return _documents(rows.select("conversation_id", "place", F.concat(F.lit("## "), (F.col("place") + 1).cast("string"), F.lit("\n\n"), F.col("prompt_text")).alias("part")))


def exchanges_markdown(exchanges: DataFrame, calls: DataFrame | None = None, chars: int = ANSWER_CHARS) -> DataFrame:
    """SNK-05: prompts, the beginnings of answers, and tools as `name ×n`. calls: prompt_id, tool."""
    rows = numbered(exchanges)
    answer = F.when(F.length("response_text") > chars, F.concat(F.substring("response_text", 1, chars), F.lit("..."))).otherwise(F.col("response_text"))
    tools = F.lit(None).cast("string")
    if calls is not None:
        counts = calls.groupBy("prompt_id", "tool").agg(F.count("*").alias("n"))
        named = counts.groupBy("prompt_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tool", "n"))), lambda t: F.when(t["n"] > 1, F.concat(t["tool"], F.lit(" ×"), t["n"].cast("string"))).otherwise(t["tool"])), ", ").alias("tools"))
        rows, tools = rows.join(named, "prompt_id", "left"), F.col("tools")
    part = F.concat_ws("\n\n", F.concat(F.lit("## "), (F.col("place") + 1).cast("string")), F.concat(F.lit("**User:** "), F.col("prompt_text")), F.when(answer != "", F.concat(F.lit("**Assistant:** "), answer)), F.concat(F.lit("*Tools: "), tools, F.lit("*")))
    return _documents(rows.select("conversation_id", "place", part.alias("part")))


def as_json(store: Store, exchanges: DataFrame) -> DataFrame:
    """SNK-05: a JSON object a conversation."""
    rows = exchanges.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "prompt_id", "prompt_text", "response_text"))).alias("exchanges"))
    whole = store["conversations"].select(F.col("id").alias("conversation_id"), "external_id", "started_at", "ended_at").join(rows, "conversation_id")
    return whole.select("conversation_id", F.to_json(F.struct("conversation_id", "external_id", "started_at", "ended_at", "exchanges")).alias("document"))


def results_text(results: DataFrame, style: str = "list") -> DataFrame:
    """SNK-06: search results as lines, in order of `mmr_rank` or score: list, verbose, full, conversations, json."""
    if style == "json":
        return results.select(F.to_json(F.struct(*[c for c in results.columns if c != "embedding"])).alias("line"))
    head = F.concat_ws("  ", F.format_number("score", 4), F.substring("conversation_id", 1, 12), F.col("workspace") if "workspace" in results.columns else F.lit(""))
    text = {"list": F.substring(F.regexp_replace("text", r"\s+", " "), 1, 120), "verbose": F.substring("text", 1, 500), "full": F.col("text"), "conversations": F.lit("")}[style]
    return results.select(F.concat_ws("\n", head, text).alias("line"))


def context_text(context: DataFrame) -> DataFrame:
    """SNK-06: (chunk_id, text) of WIN-03's exchanges around hits, in order; those of the hit are marked with >."""
    head = F.concat(F.when(F.col("is_hit"), "> ").otherwise("  "), F.lit("["), F.col("place").cast("string"), F.lit("] "), F.coalesce("timestamp", F.lit("")))
    part = F.concat_ws("\n", head, F.nullif("prompt_text", F.lit("")), F.nullif("response_text", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("place", part.alias("part"))))
    return context.groupBy("chunk_id").agg(F.array_join(F.transform(rows, lambda r: r["part"]), "\n\n").alias("text"))


def thread_text(threaded: DataFrame) -> DataFrame:
    """SNK-06: a text per conversation of RET-11's results: those of tier 1 with all their chunks by time, those of tier 2 with the best one's beginning."""
    one = lambda text: F.regexp_replace(text, r"\s+", " ")
    all_parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda r: one(r["text"])), "\n")
    best = F.substring(one(F.max_by("text", F.struct("score", "chunk_id"))), 1, 80)
    rows = threaded.groupBy("conversation_id", "tier").agg(F.min("started_at").alias("started_at"), F.max("score").alias("score"), F.when(F.col("tier") == 1, all_parts).otherwise(best).alias("said"))
    head = F.concat_ws("  ", F.substring(F.coalesce("started_at", F.lit("")), 1, 10), F.col("conversation_id").cast("string"), F.format_number("score", 3))
    return rows.select("conversation_id", "tier", F.concat_ws("\n", head, "said").alias("text"))


def by_time_text(results: DataFrame) -> DataFrame:
    """SNK-06: (day, text): the results of each day in the order of their times."""
    line = F.concat_ws("  ", F.substring("started_at", 12, 5), F.col("conversation_id").cast("string"), F.substring(F.regexp_replace("text", r"\s+", " "), 1, 80))
    rows = F.array_sort(F.collect_list(F.struct("started_at", "chunk_id", line.alias("line"))))
    return results.groupBy(F.substring("started_at", 1, 10).alias("day")).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def references_text(refs: DataFrame) -> DataFrame:
    """SNK-06: (prompt_id, text): SET-07's files, `r`, `w` or `e` before each name, one a line."""
    line = F.concat_ws(" ", "op", "name")
    return refs.groupBy("prompt_id").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("text"))


# --- Saved query texts (EXT-04) ---------------------------------------------------------------------------------------


def _outside_literals(text: str) -> str:
    """T10: the text with its literals and comments blanked, so that what they hold is no parameter."""
    return re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", lambda m: " " * len(m[0]), text, flags=re.S)


def parameters(text: str) -> list[str]:
    """EXT-04: the parameters `:name` of a query text."""
    return sorted(set(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", _outside_literals(text))))


def statements(text: str) -> list[str]:
    """The statements of a text, cut at semicolons that are no part of a literal or comment."""
    bare, out, start = _outside_literals(text), [], 0
    for at in [i for i, c in enumerate(bare) if c == ";"] + [len(text)]:
        if bare[start:at].strip():
            out.append(text[start:at].strip())
        start = at + 1
    return out


def run_text(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """EXT-04, T8, T35, T36: the last statement's result; values are bound, never pasted; only queries are run."""
    args = args or {}
    if missing := [p for p in parameters(text) if p not in args]:
        raise KeyError(f"missing parameters: {', '.join(missing)}")
    out = None
    for statement in statements(text):
        if not re.match(r"\s*(--[^\n]*\n\s*)*(SELECT|WITH|VALUES|FROM|TABLE)\b", statement, re.I):
            raise PermissionError("only queries are run")
        out = spark.sql(statement, args={p: args[p] for p in parameters(statement)})
    if out is None:
        raise ValueError("the text holds no query")
    return out


def register(store: Store) -> None:
    """The store's tables as views for query texts."""
    for name, table in store.items():
        table.createOrReplaceTempView(name)
