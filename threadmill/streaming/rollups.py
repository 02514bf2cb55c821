"""Partial aggregates of a store in buckets, kept up to date: AGG-02 to AGG-05 without reading the store.

A conversation is in one bucket, so counts and sums by bucket add up, those of conversations too; no distinct count has to be merged. Each bucket has its rows of the two tables below; a batch
replaces those of the buckets that it touches, in the same version as these (buckets.py), so roll-ups and store never differ. Costs are not stored: tokens are summed by model and provider, and
rates are those of the time of asking, as in the full query. What a query reads follows the number of distinct (day, workspace, harness, model, provider), not that of responses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions.scalars import day
from threadmill.operators.analytics import _renamed, dollars, with_cost
from threadmill.schema import Store

USAGE = "day string, workspace_id string, harness_id string, model_id string, provider_id string, responses bigint, input_tokens bigint, output_tokens bigint, both_tokens bigint"
#: prompt_rows and response_rows: as the join of both sides counts them.
DAYS = "day string, harness_id string, conversations bigint, prompts bigint, responses bigint, tool_calls bigint, prompt_rows bigint, response_rows bigint"


def usage(store: Store, bucket: Callable[[str], Column], slices: int = 1) -> DataFrame:
    """USAGE and bucket: of responses. Those of no conversation have no day, workspace and harness. A bucket's rows are in up to `slices` tasks, by conversation, so a key has up to as many rows,
    which readers add up. One shuffle brings responses to their conversation, groups and places them."""
    of = store["conversations"].where("id IS NOT NULL").select(F.col("id").alias("conversation_id"), F.struct(day(F.col("started_at")).alias("day"), "workspace_id", "harness_id").alias("of"))
    rows = of.unionByName(store["responses"].select("conversation_id", "model_id", "provider_id", "input_tokens", "output_tokens"), allowMissingColumns=True)
    # Responses of no conversation needn't meet.
    alone = [F.when(F.col("conversation_id").isNull(), F.col(c)) for c in ("model_id", "provider_id")]
    rows = rows.select("*", bucket("conversation_id"), F.pmod(F.xxhash64("conversation_id", *alone, F.lit(1)), F.lit(slices)).alias("slice")).repartition("bucket", "slice")
    rows = rows.withColumn("found", F.collect_list("of").over(Window.partitionBy("bucket", "slice", "conversation_id"))).where("of IS NULL")
    rows = rows.select("bucket", "slice", "model_id", "provider_id", "input_tokens", "output_tokens", F.inline_outer("found"))
    keys = ["day", "workspace_id", "harness_id", "model_id", "provider_id", "bucket"]
    return rows.groupBy(*keys, "slice").agg(F.count("*").alias("responses"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("both_tokens")).drop("slice")


def days(store: Store, bucket: Callable[[str], Column], slices: int = 1) -> DataFrame:
    """DAYS and bucket: of conversations. Its rows are days by harnesses, so a bucket's are in one task."""
    count = lambda t: store[t].groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias(t))
    rows, sides = store["conversations"].select("id", day(F.col("started_at")).alias("day"), "harness_id", bucket("id")), ["prompts", "responses", "tool_calls"]
    for t in sides:
        rows = rows.join(count(t), "id", "left")
    many = lambda a, b: F.sum(F.col(a) * F.greatest(F.col(b), F.lit(1)))
    rows = rows.fillna(0, sides)
    return rows.groupBy("day", "harness_id", "bucket").agg(F.count("*").alias("conversations"), *(F.sum(t).alias(t) for t in sides), many("prompts", "responses").alias("prompt_rows"), many("responses", "prompts").alias("response_rows")).repartition("bucket")


#: Table, its schema, and what makes it.
ROLLUPS = {"rollup_usage": (USAGE, usage), "rollup_days": (DAYS, days)}


def cost(usage_: DataFrame, store: Store) -> DataFrame:
    """AGG-02 of rollup_usage; store: the small tables. Where these aren't small, usage is shuffled once for models and prices, once for workspaces, and once as sums."""
    rates = store["pricing"].where("provider_id IS NOT NULL").select("model_id", "provider_id", F.struct("input_per_mtok", "output_per_mtok").alias("rate")).repartition("model_id")
    rates = rates.groupBy("model_id", "provider_id").agg(F.collect_list("rate").alias("rate")).groupBy("model_id").agg(F.map_from_entries(F.collect_list(F.struct("provider_id", "rate"))).alias("rates"))
    rows = usage_.select("workspace_id", "model_id", "provider_id", "input_tokens", "output_tokens").join(rates, "model_id", "left").join(_renamed(store["models"], "model_id", model="name"), "model_id", "left")
    rows = with_cost(rows.select("workspace_id", "model", "input_tokens", "output_tokens", F.inline_outer(F.col("rates")[F.col("provider_id")]))).drop("input_per_mtok", "output_per_mtok")
    rows = rows.join(_renamed(store["workspaces"], "workspace_id", workspace="path"), "workspace_id")
    return rows.groupBy("workspace", "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), dollars(F.col("cost")).alias("approx_cost_usd"))


def daily_activity(days_: DataFrame, exact: bool = False) -> DataFrame:
    """AGG-03 of rollup_days."""
    return days_.groupBy("day").agg(F.sum("conversations").alias("conversations"), F.sum("prompts" if exact else "prompt_rows").alias("prompts"), F.sum("responses" if exact else "response_rows").alias("responses"))


def harness_stats(days_: DataFrame, store: Store) -> DataFrame:
    """AGG-04 of rollup_days."""
    totals = days_.groupBy("harness_id").agg(*(F.sum(c).alias(c) for c in ("conversations", "prompts", "responses", "tool_calls")))
    return _renamed(store["harnesses"], "harness_id", harness="name").join(totals, "harness_id", "left").fillna(0).drop("harness_id")


def model_usage(usage_: DataFrame, store: Store) -> DataFrame:
    """AGG-05 of rollup_usage."""
    rows = usage_.join(_renamed(store["models"], "model_id", model="name"), "model_id")
    million = lambda c: F.round(F.sum(c) / 1_000_000, 2)
    return rows.groupBy("model").agg(F.sum("responses").alias("responses"), million("input_tokens").alias("input_mtok"), million("output_tokens").alias("output_mtok"), million("both_tokens").alias("total_mtok"))
