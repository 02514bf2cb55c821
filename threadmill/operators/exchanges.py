"""Exchanges: prompts with what answers them, in order; windows over them; timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions.scalars import basename, file_content, json_text_or_raw, strip
from threadmill.operators.filters import file_calls, text_blocks
from threadmill.schema import Store


def ordered_text(rows: DataFrame, keys: list[str], order: list[str], text: str, joiner: str) -> DataFrame:
    """AGG-22: the texts of each key, in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["__t"]), joiner).alias(text))


def fold(turns: DataFrame, key: str, order: str, is_prompt: Column) -> DataFrame:
    """WIN-08: the number of the exchange that each record belongs to, counted by its prompts; what comes before the first prompt is left out."""
    w = Window.partitionBy(key).orderBy(order)
    return turns.withColumn("exchange", F.sum(F.when(is_prompt, 1).otherwise(0)).over(w)).where("exchange > 0")


def exchanges(store: Store, ids: DataFrame | None = None, prompt_ids: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """RET-16, JON-11: conversation_id, prompt_id, timestamp, prompt_text and response_text, stripped, '' where there is none.

    Blocks are joined by line feeds, responses by blank lines in the order of their times."""
    prompts = store["prompts"].select(F.col("id").alias("prompt_id"), "conversation_id", "timestamp")
    if ids is not None:
        prompts = prompts.join(ids.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
    if prompt_ids is not None:
        prompts = prompts.join(prompt_ids.select(F.col("id").alias("prompt_id")), "prompt_id", "left_semi")
    if exclude is not None:
        prompts = prompts.join(exclude.select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti")
    asked = ordered_text(text_blocks(store["prompt_content"]), ["prompt_id"], ["block_index"], "text", "\n").withColumnRenamed("text", "prompt_text")
    told = ordered_text(text_blocks(store["response_content"]), ["response_id"], ["block_index"], "text", "\n")
    answers = store["responses"].where(F.col("prompt_id").isNotNull()).select("prompt_id", F.col("timestamp").alias("ts"), F.col("id").alias("response_id")).join(told, "response_id")
    answers = ordered_text(answers, ["prompt_id"], ["ts", "response_id"], "text", "\n\n").withColumnRenamed("text", "response_text")
    clean = lambda c: strip(F.coalesce(F.col(c), F.lit(""))).alias(c)
    return prompts.join(asked, "prompt_id", "left").join(answers, "prompt_id", "left").select("conversation_id", "prompt_id", "timestamp", clean("prompt_text"), clean("response_text"))


def conversation_exchanges(store: Store, ids: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """RET-17: conversation_id, prompt_id, timestamp, text; both sides joined by a blank line, exchanges without any text left out."""
    rows = exchanges(store, ids, exclude=exclude)
    text = F.array_join(F.filter(F.array("prompt_text", "response_text"), lambda t: t != ""), "\n\n")
    return rows.select("conversation_id", "prompt_id", "timestamp", text.alias("text")).where("text <> ''")


def numbered(rows: DataFrame, key: str = "conversation_id", order: tuple[str, ...] = ("timestamp", "prompt_id")) -> DataFrame:
    """WIN-02: exchanges counted from 0 in each conversation."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def prompt_at(store: Store, wanted: DataFrame) -> DataFrame:
    """WIN-02: wanted (conversation_id, place) with the prompt_id there."""
    prompts = numbered(store["prompts"].select("conversation_id", F.col("id").alias("prompt_id"), "timestamp"))
    return wanted.join(prompts, ["conversation_id", "place"])


def last_exchanges(rows: DataFrame, n: int, key: str = "conversation_id", order: tuple[str, ...] = ("timestamp", "prompt_id")) -> DataFrame:
    """WIN-04, SRC-11: the last n of each conversation."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__back", F.row_number().over(w)).where(F.col("__back") <= n).drop("__back")


def context(hits: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """WIN-03, RET-13: for each hit (chunk_id, conversation_id, source_ids) the exchanges from n before its first prompt to n after its last.

    The bounds meet the exchanges in an equi-join on the conversation, of which a row is kept only inside them."""
    place = numbered(rows)
    sources = hits.select("chunk_id", "conversation_id", F.explode("source_ids").alias("prompt_id"))
    bounds = sources.join(place.select("conversation_id", "prompt_id", "place"), ["conversation_id", "prompt_id"]).groupBy("chunk_id", "conversation_id").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    return place.join(bounds, "conversation_id").where(F.col("place").between(F.col("a") - n, F.col("b") + n)).withColumn("is_hit", F.col("place").between(F.col("a"), F.col("b"))).drop("a", "b")


def collapsed_calls(calls: DataFrame, key: str, order: list[str]) -> DataFrame:
    """AGG-33, WIN-07: runs of calls of one tool and status: key, run (from 0), tool, status, n."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = calls.select(key, *order, F.coalesce("tool", F.lit("unknown")).alias("tool"), F.coalesce("status", F.lit("unknown")).alias("status"))
    new = F.coalesce((F.lag("tool").over(w) != F.col("tool")) | (F.lag("status").over(w) != F.col("status")), F.lit(True))
    runs = rows.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w) - 1)
    return runs.groupBy(key, "run", "tool", "status").agg(F.count("*").alias("n"))


def timeline(store: Store, ids: DataFrame) -> DataFrame:
    """RET-22: a row per prompt and response, a prompt without one alone: texts (blocks joined by spaces, raw where they are no JSON), tokens, model, collapsed tool calls."""
    prompts = store["prompts"].join(ids.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi").select("conversation_id", F.col("id").alias("prompt_id"), F.col("timestamp").alias("prompt_ts"))
    said = lambda table, key: ordered_text(store[table].where("block_type = 'text'").withColumn("text", json_text_or_raw(F.col("content"))).where("text IS NOT NULL"), [key], ["block_index"], "text", " ")
    calls = store["tool_calls"].join(store["tools"].select(F.col("id").alias("tool_id"), F.col("name").alias("tool")), "tool_id", "left").select("response_id", "timestamp", "id", "tool", "status")
    runs = collapsed_calls(calls, "response_id", ["timestamp", "id"]).groupBy("response_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "tool", "status", "n"))), lambda x: F.struct(x["tool"].alias("tool"), x["status"].alias("status"), x["n"].alias("n"))).alias("tool_calls"))
    models = store["models"].select(F.col("id").alias("model_id"), F.col("name").alias("model"))
    answers = store["responses"].select(F.col("id").alias("response_id"), "prompt_id", "model_id", F.col("timestamp").alias("ts"), "input_tokens", "output_tokens")
    answers = answers.join(models, "model_id", "left").join(said("response_content", "response_id").withColumnRenamed("text", "response_text"), "response_id", "left").join(runs, "response_id", "left")
    rows = prompts.join(said("prompt_content", "prompt_id").withColumnRenamed("text", "prompt_text"), "prompt_id", "left").join(answers, "prompt_id", "left")
    return rows.select("conversation_id", "prompt_id", "response_id", F.coalesce("ts", "prompt_ts").alias("timestamp"), "prompt_text", "response_text", "model", "input_tokens", "output_tokens", "tool_calls").orderBy("conversation_id", "prompt_ts", "prompt_id", "ts", "response_id")


def results_with_content(calls: DataFrame, store: Store) -> DataFrame:
    """JON-10: tool calls with their result, inline or from the blobs."""
    blobs = store["content_blobs"].select(F.col("hash").alias("result_hash"), F.col("content").alias("blob"))
    return calls.join(blobs, "result_hash", "left").withColumn("result", F.coalesce("result", "blob")).drop("blob")


def file_references(store: Store, prompt_ids: DataFrame) -> DataFrame:
    """RET-14: files that the responses to these prompts read (r), wrote (w) or edited (e): prompt_id, path, name, op, content."""
    asked = store["responses"].join(prompt_ids.select(F.col("id").alias("prompt_id")), "prompt_id", "left_semi").select(F.col("id").alias("response_id"), "prompt_id")
    rows = results_with_content(file_calls(store).join(asked, "response_id"), store)
    path = F.coalesce(F.get_json_object("input", "$.file_path"), F.get_json_object("input", "$.path"))
    op = F.when(F.col("tool") == "file.read", "r").when(F.col("tool") == "file.write", "w").otherwise("e")
    content = F.coalesce(F.get_json_object("input", "$.content"), file_content(F.col("result")))
    return rows.select("prompt_id", "timestamp", F.col("id").alias("call_id"), path.alias("path"), basename(path).alias("name"), op.alias("op"), content.alias("content")).where("path IS NOT NULL")


def distinct_references(refs: DataFrame, by: str = "name") -> DataFrame:
    """SET-07: of each prompt, file (by name or path) and op the first reference."""
    first = F.min_by(F.struct("path", "name", "content"), F.struct("timestamp", "call_id")).alias("f")
    return refs.groupBy("prompt_id", F.col(by).alias("__by"), "op").agg(first).select("prompt_id", "op", "f.path", "f.name", "f.content")
