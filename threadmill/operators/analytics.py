"""Usage, cost and activity roll-ups over a store.

Joins whose sides would multiply are aggregated first, so every plan is linear in its input. Dimension tables
join without hints: Spark broadcasts them as long as their measured size allows it, and shuffles them beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions.scalars import day, suffix, week_of_year
from threadmill.operators.filters import in_workspace, of_model
from threadmill.plans.tables import settled
from threadmill.schema import Store



#: Conversations of a listing up to which their ids are broadcast.
LISTED = 10_000


def share(of: Column) -> Column:
    """WIN-01: percent of the total over all rows, to one place."""
    return F.round(of * F.lit(100.0) / F.sum(of).over(Window.partitionBy()), 1)


def _renamed(table: DataFrame, key: str, **columns: str) -> DataFrame:
    """A dimension: its id as `key`, and the named columns."""
    return table.select(F.col("id").alias(key), *(F.col(c).alias(new) for new, c in columns.items()))


def priced(responses: DataFrame, store: Store) -> DataFrame:
    """JON-01: responses with `cost`, exact, in millionths of a millionth of a dollar: a missing rate or count is 0, and a null provider has no rate. Rates count to six places."""
    rates = store["pricing"].select("model_id", "provider_id", "input_per_mtok", "output_per_mtok")
    return with_cost(responses.join(rates, ["model_id", "provider_id"], "left"))


def with_cost(rows: DataFrame) -> DataFrame:
    """Rows that have their rates, with `cost` as priced() has it."""
    part = lambda n, rate: F.coalesce(n, F.lit(0)).cast("decimal(18,0)") * F.round(F.coalesce(rate, F.lit(0.0)) * 1_000_000).cast("decimal(18,0)")
    return rows.withColumn("cost", part("input_tokens", "input_per_mtok") + part("output_tokens", "output_per_mtok"))


def dollars(cost: Column, places: int = 4) -> Column:
    """A sum of exact costs in dollars; halves round up."""
    unit = 10 ** (12 - places)
    total = F.coalesce(F.sum(cost), F.lit(0)).cast("decimal(38,0)") + F.lit(unit // 2)
    return F.call_function("div", total, F.lit(unit).cast("decimal(38,0)")).cast("double") / 10**places


def cost(store: Store) -> DataFrame:
    """AGG-02, JON-02: approximate cost by workspace and model."""
    rows = priced(store["responses"], store).join(_renamed(store["conversations"], "conversation_id", workspace_id="workspace_id"), "conversation_id")
    rows = rows.join(_renamed(store["workspaces"], "workspace_id", workspace="path"), "workspace_id").join(_renamed(store["models"], "model_id", model="name"), "model_id", "left")
    return rows.groupBy("workspace", "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), dollars(F.col("cost")).alias("approx_cost_usd"))


def _per_conversation(store: Store) -> DataFrame:
    """id, day, and how many prompts and responses each conversation has."""
    count = lambda t: store[t].groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias(t))
    rows = store["conversations"].select("id", day(F.col("started_at")).alias("day"), "harness_id")
    return rows.join(count("prompts"), "id", "left").join(count("responses"), "id", "left").fillna(0, ["prompts", "responses"])


def daily_activity(store: Store) -> DataFrame:
    """AGG-03, JON-03: by day; prompts and responses as the join of both sides would count them, each once for every one of the other."""
    rows = _per_conversation(store)
    many = lambda a, b: F.sum(F.col(a) * F.greatest(F.col(b), F.lit(1)))
    return rows.groupBy("day").agg(F.count("*").alias("conversations"), many("prompts", "responses").alias("prompts"), many("responses", "prompts").alias("responses"))


def daily_activity_exact(store: Store) -> DataFrame:
    """AGG-03 with each prompt and response counted once."""
    return _per_conversation(store).groupBy("day").agg(F.count("*").alias("conversations"), F.sum("prompts").alias("prompts"), F.sum("responses").alias("responses"))


def harness_stats(store: Store) -> DataFrame:
    """AGG-04, JON-04: conversations, prompts, responses, tool calls of each harness; each side is counted before it is joined."""
    count = lambda t: store[t].groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias(t))
    rows = store["conversations"].select("id", "harness_id")
    sides = ["prompts", "responses", "tool_calls"]
    for t in sides:
        rows = rows.join(count(t), "id", "left")
    totals = rows.groupBy("harness_id").agg(F.count("*").alias("conversations"), *(F.sum(t).alias(t) for t in sides))
    return _renamed(store["harnesses"], "harness_id", harness="name").join(totals, "harness_id", "left").fillna(0).drop("harness_id")


def model_usage(store: Store) -> DataFrame:
    """AGG-05: responses and millions of tokens by model; the total leaves out responses without an input count."""
    rows = store["responses"].join(_renamed(store["models"], "model_id", model="name"), "model_id")
    million = lambda c: F.round(F.sum(c) / 1_000_000, 2)
    return rows.groupBy("model").agg(F.count("*").alias("responses"), million("input_tokens").alias("input_mtok"), million("output_tokens").alias("output_mtok"), million(F.col("input_tokens") + F.col("output_tokens")).alias("total_mtok"))


def overview(store: Store) -> DataFrame:
    """AGG-06: six counts in one row."""
    out = None
    for name in ("conversations", "prompts", "responses", "tool_calls", "workspaces", "models"):
        one = store[name].agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # rows of one
    return out


def table_counts(store: Store, names: list[str] | None = None) -> DataFrame:
    """AGG-15, AGG-35: (table, rows)."""
    names = names or ["conversations", "prompts", "responses", "tool_calls", "harnesses", "workspaces", "tools", "models", "ingested_files"]
    out = None
    for name in names:
        one = store[name].agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        out = one if out is None else out.union(one)
    return out


def tool_usage(store: Store) -> DataFrame:
    """AGG-07: calls, errors and error rate by tool."""
    rows = store["tool_calls"].join(_renamed(store["tools"], "tool_id", tool="name", category="category"), "tool_id")
    errors = F.sum(F.when(F.col("status") == "error", 1).otherwise(0))
    return rows.groupBy("tool", "category").agg(F.count("*").alias("uses"), errors.alias("errors"), F.round(errors * F.lit(100.0) / F.count("*"), 1).alias("error_pct"))


def _tagged_calls(store: Store) -> DataFrame:
    """JON-05: tool calls with the names of their tags."""
    names = _renamed(store["tags"], "tag_id", tag="name")
    tags = store["tool_call_tags"].select(F.col("tool_call_id").alias("id"), "tag_id").join(names, "tag_id")
    return store["tool_calls"].join(tags, "id")


def tool_tags(store: Store, prefix: str = "shell:") -> DataFrame:
    """AGG-18: uses of the tool tags that begin with prefix."""
    return _tagged_calls(store).where(F.col("tag").ilike(f"{prefix}%")).groupBy("tag").agg(F.count("*").alias("n"))


def shell_tags(store: Store) -> DataFrame:
    """AGG-08: shell tags and their share."""
    return tool_tags(store).withColumn("pct", share(F.col("n")))


def tool_tag_shares(store: Store, prefix: str = "shell:") -> DataFrame:
    """AGG-20: as AGG-08, for any prefix; halves round away from zero."""
    return tool_tags(store, prefix).withColumn("pct", share(F.col("n")))


def _bucketed(rows: DataFrame, name: str, buckets: list[tuple[Column, str]], with_share: bool = True) -> DataFrame:
    chain = None
    for test, value in buckets:
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    out = rows.groupBy(chain.otherwise("other").alias(name)).agg(F.count("*").alias("n"))
    return out.withColumn("pct", share(F.col("n"))) if with_share else out


def _has(part: str) -> Column:
    """LIKE %part%: whatever the case of ASCII letters."""
    return F.contains(F.lower("input"), F.lit(part))


def _git() -> Column:
    return _has("git ") | _has("git\\n")  # a line feed inside JSON is a backslash and an n


#: Actions in the order in which they are tried. Fixed values.
GIT_ACTIONS = ["add", "log", "status", "diff", "commit", "show", "checkout", "push", "branch", "pull", "merge", "worktree", "stash"]
GIT_READS = ["status", "log", "diff", "show", "branch"]
GIT_WRITES = ["add", "commit", "push", "pull", "merge", "rebase", "reset"]


def vcs_tools(store: Store) -> DataFrame:
    """AGG-09: which program the version control commands call."""
    return _bucketed(_tagged_calls(store).where("tag = 'shell:vcs'"), "tool", [(_git(), "git"), (_has("yadm "), "yadm"), (_has("gh "), "gh")])


def git_actions(store: Store) -> DataFrame:
    """AGG-10: what git is asked to do; the first that fits."""
    return _bucketed(_tagged_calls(store).where(_git() & (F.col("tag") == "shell:vcs")), "action", [(_has(f"git {a}"), a) for a in GIT_ACTIONS])


def git_modes(store: Store) -> DataFrame:
    """AGG-11: reading and writing git commands."""
    some = lambda words: F.lower("input").rlike("git (" + "|".join(words) + ")")
    return _bucketed(_tagged_calls(store).where(_git() & (F.col("tag") == "shell:vcs")), "mode", [(some(GIT_READS), "read"), (some(GIT_WRITES), "write")])


def test_tools(store: Store) -> DataFrame:
    """AGG-12: the test runners."""
    return _bucketed(_tagged_calls(store).where("tag = 'shell:test'"), "tool", [(_has("pytest"), "pytest")], with_share=False)


def dominant_model(store: Store) -> DataFrame:
    """AGG-13, WIN-05: the model with most responses of each conversation; none is a model too, ties go to the first name."""
    rows = store["responses"].join(_renamed(store["models"], "model_id", model="name"), "model_id", "left").groupBy("conversation_id", "model").agg(F.count("*").alias("n"))
    best = rows.groupBy("conversation_id").agg(F.min_by("model", F.struct(-F.col("n"), F.col("model"))).alias("model"))
    return best.select(F.col("conversation_id").alias("id"), "model")


def token_totals(store: Store) -> DataFrame:
    """AGG-14: tokens of each conversation."""
    return store["responses"].groupBy(F.col("conversation_id").alias("id")).agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))


def top_workspaces(store: Store, n: int = 10) -> DataFrame:
    """AGG-16, JON-09: the largest groups are taken before the join, so the conversations without a workspace may hold a place and go."""
    top = store["conversations"].groupBy("workspace_id").agg(F.count("*").alias("conversations")).orderBy(F.desc("conversations"), F.col("workspace_id").asc_nulls_first()).limit(n)
    return top.join(_renamed(store["workspaces"], "workspace_id", path="path"), "workspace_id").select("path", "conversations")


def top_tools(store: Store, n: int = 10) -> DataFrame:
    """AGG-16: likewise of tools."""
    top = store["tool_calls"].groupBy("tool_id").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), F.col("tool_id").asc_nulls_first()).limit(n)
    return top.join(_renamed(store["tools"], "tool_id", tool="name"), "tool_id").select("tool", "uses")


def tag_usage(store: Store) -> DataFrame:
    """AGG-17: of each tag the workspaces, conversations, tool calls and prompts that have it."""
    out = store["tags"].select("id", "name", "description")
    for entity in ("workspace", "conversation", "tool_call", "prompt"):
        out = out.join(store[f"{entity}_tags"].groupBy(F.col("tag_id").alias("id")).agg(F.count("*").alias(f"{entity}s")), "id", "left")
    return out.fillna(0, [f"{e}s" for e in ("workspace", "conversation", "tool_call", "prompt")]).drop("id")


def tool_tags_by_workspace(store: Store, prefix: str = "shell:", n: int = 20) -> DataFrame:
    """AGG-19: of the workspaces with most tagged calls their tags, most used first, as an array, and the total."""
    rows = _tagged_calls(store).where(F.col("tag").ilike(f"{prefix}%")).join(_renamed(store["conversations"], "conversation_id", workspace_id="workspace_id"), "conversation_id")
    rows = rows.join(_renamed(store["workspaces"], "workspace_id", workspace="path"), "workspace_id").groupBy("workspace", "tag").agg(F.count("*").alias("n"))
    tags = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "tag"))), lambda x: F.struct(x["tag"].alias("tag"), (-x["m"]).alias("n")))
    return rows.groupBy("workspace").agg(F.sum("n").alias("total"), tags.alias("tags")).orderBy(F.desc("total"), "workspace").limit(n)


def tags_of(store: Store, entity: str = "conversation") -> DataFrame:
    """AGG-23: the names of each entity's tags, sorted."""
    rows = store[f"{entity}_tags"].join(_renamed(store["tags"], "tag_id", tag="name"), "tag_id")
    return rows.groupBy(F.col(f"{entity}_id").alias("id")).agg(F.sort_array(F.collect_list("tag")).alias("tags"))


def listing_totals(listing: DataFrame) -> DataFrame:
    """AGG-24: sums over a listing."""
    return listing.agg(F.count("*").alias("conversations"), F.sum("prompts").alias("prompts"), F.sum("responses").alias("responses"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"))


def ingest_stats(store: Store) -> DataFrame:
    """AGG-25: what each harness brought in: conversations, prompts, responses, tool calls, files, errors."""
    files = store["ingested_files"].groupBy("harness_id").agg(F.count("*").alias("files"), F.count("error").alias("errors"))
    names = _renamed(store["harnesses"], "harness_id", harness="name")
    return harness_stats(store).join(names.join(files, "harness_id", "left").drop("harness_id"), "harness").fillna(0)


def blob_savings(texts: DataFrame, column: str = "result") -> DataFrame:
    """AGG-26: results, their characters, distinct ones exactly and by sketch."""
    given = texts.where(F.col(column).isNotNull()).select(F.col(column).alias("x"), F.sha2(column, 256).alias("h"))
    counts = given.groupBy("h").agg(F.count("*").alias("n"), F.first(F.length("x")).alias("chars"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("results"), F.coalesce(F.sum(F.col("n") * F.col("chars")), F.lit(0)).alias("chars"), F.count("*").alias("distinct_results"), F.coalesce(F.sum("chars"), F.lit(0)).alias("distinct_chars"))


def approx_distinct(texts: DataFrame, column: str = "result") -> DataFrame:
    """AGG-26: the sketched estimate, for tables too large for an exact look."""
    return texts.agg(F.approx_count_distinct(column, 0.02).alias("distinct_results"))


def workspace_identity(store: Store) -> DataFrame:
    """AGG-27: workspaces with and without a remote, and remotes that several share."""
    own = store["workspaces"].groupBy("git_remote").agg(F.count("*").alias("n"))
    given = F.col("git_remote").isNotNull()
    return own.agg(F.sum("n").alias("workspaces"), F.coalesce(F.sum(F.when(given, F.col("n"))), F.lit(0)).alias("with_remote"), F.count(F.when(given & (F.col("n") > 1), 1)).alias("shared_remotes"))


def duplicate_workspaces(store: Store) -> DataFrame:
    """AGG-27: remotes of several workspaces."""
    return store["workspaces"].where(F.col("git_remote").isNotNull()).groupBy("git_remote").agg(F.count("*").alias("n")).where("n > 1")


def weekly_cost(store: Store, since: str | None = None, workspace: str | None = None) -> DataFrame:
    """AGG-28: by week (from Monday) and workspace, its path by the last 30 characters."""
    conversations = store["conversations"].where(F.col("started_at") >= since) if since else store["conversations"]
    places = store["workspaces"].where(F.col("path").ilike(f"%{workspace}%")) if workspace else store["workspaces"]
    rows = priced(store["responses"], store).join(conversations.select(F.col("id").alias("conversation_id"), "workspace_id", "started_at"), "conversation_id").join(_renamed(places, "workspace_id", path="path"), "workspace_id")
    of = rows.groupBy(week_of_year(F.col("started_at")).alias("week"), "path", "conversation_id").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.sum("cost").alias("c"))
    out = of.groupBy("week", "path").agg(F.count("*").alias("conversations"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), dollars(F.col("c"), 2).alias("approx_cost_usd"))
    return out.select("week", F.when(F.col("path") == "", "(root)").otherwise(suffix(F.col("path"), 30)).alias("workspace"), "conversations", "input_tokens", "output_tokens", "approx_cost_usd")


QUANTILES = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def length_distribution(rows: DataFrame, n: str, limits: list[int]) -> DataFrame:
    """AGG-29: least, most, mean, and the values at place int(count * q) in order, which is no interpolation; how many pass each limit.

    Equal values are counted first, so what is put in order are distinct lengths."""
    counts = rows.groupBy(F.col(n).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy("v"))
    placed = counts.withColumn("upto", upto).withColumn("total", F.sum("c").over(Window.partitionBy()))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("total") * q), F.col("total") - 1), F.col("v")))
    return placed.agg(F.min("v").alias("min"), F.max("v").alias("max"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 4).alias("mean"), *(at(q).alias(k) for k, q in QUANTILES.items()), *(F.coalesce(F.sum(F.when(F.col("v") > x, F.col("c"))), F.lit(0)).alias(f"over_{x}") for x in limits))


def histogram(rows: DataFrame, n: str, bounds: list[int]) -> DataFrame:
    """AGG-30: counts in the buckets between bounds (the last is open), empty ones too."""
    spark = rows.sparkSession
    names = [(i, f"{a}-{b}") for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))] + [(len(bounds) - 1, f"{bounds[-1]}+")]
    buckets = spark.createDataFrame(names, "place int, bucket string")
    place = F.lit(-1)
    for b in bounds:
        place = place + (F.col(n) >= b).cast("int")
    found = rows.groupBy(place.alias("place")).agg(F.count("*").alias("n"))
    return buckets.join(found, "place", "left").fillna(0, ["n"])


def score_summary(ranked: DataFrame) -> DataFrame:
    """AGG-31: by query group: means of scores and of the first 1, 5, 10, population variance, and spread. ranked: group, query, rank, score."""
    top = lambda k: F.avg(F.when(F.col("rank") <= k, F.col("score")))
    per = ranked.groupBy("group", "query").agg(F.avg("score").alias("avg"), F.var_pop("score").alias("variance"), top(1).alias("top1"), top(5).alias("top5"), top(10).alias("top10"), (F.max("score") - F.min("score")).alias("spread"))
    return per.groupBy("group").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("avg", "variance", "top1", "top5", "top10", "spread")))


def diversity(ranked: DataFrame) -> DataFrame:
    """AGG-32: by query: the share of the first ten that are of the first one's conversation, and distinct workspaces. ranked: query, rank, conversation_id, workspace."""
    ten = ranked.where("rank <= 10")
    first = ten.groupBy("query").agg(F.min_by("conversation_id", "rank").alias("first"))
    rows = ten.join(first, "query")
    return rows.groupBy("query").agg(F.round(F.avg((F.col("conversation_id") == F.col("first")).cast("double")), 4).alias("redundancy"), F.count_distinct("workspace").alias("workspaces"))


def tool_counts(calls: DataFrame, key: str, name: str = "tool", order: str = "place") -> DataFrame:
    """AGG-34: of each exchange its tools, most used first, then in the order of their first use."""
    counts = calls.groupBy(key, name).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    made = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", name))), lambda x: F.struct(x[name].alias("tool"), (-x["m"]).alias("n")))
    return counts.groupBy(key).agg(made.alias("tools"))


def listing(store: Store, ids: DataFrame | None = None, model: str | None = None, newest_first: bool = True, limit: int = 10) -> DataFrame:
    """RET-23, AGG-01, SRT-01, SRT-02: conversations with counts, tokens, cost, main model and tags; limit 0 means all.

    A model filter leaves only the responses of that model in responses, tokens and cost; main model and prompts are of all."""
    rows = store["conversations"] if ids is None else store["conversations"].join(ids.select("id"), "id", "left_semi")
    responses = store["responses"]
    if model:
        responses = responses.join(store["models"].where(of_model(model)).select(F.col("id").alias("model_id")), "model_id", "left_semi")
        rows = rows.join(responses.select(F.col("conversation_id").alias("id")), "id", "left_semi")
    sort = [F.desc("started_at") if newest_first else F.asc("started_at"), F.asc("id")]
    if 0 < limit:
        rows = settled(rows.orderBy(*sort).limit(limit), "listing")  # chosen once, for all that is looked up below
        # What is counted, summed and named is that of the chosen conversations: `limit` ids at most, which go to every task up to LISTED.
        chosen = rows.select(F.col("id").alias("conversation_id"))
        chosen = F.broadcast(chosen) if limit <= LISTED else chosen
        of = lambda table: table.join(chosen, "conversation_id", "left_semi")
        store, responses = store | {t: of(store[t]) for t in ("responses", "prompts", "conversation_tags")}, of(responses)
    sums = priced(responses, store).groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias("responses"), F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"), dollars(F.col("cost")).alias("cost"))
    prompts = store["prompts"].groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias("prompts"))
    out = rows.select("id", "workspace_id", "started_at").join(_renamed(store["workspaces"], "workspace_id", workspace="path"), "workspace_id", "left")
    out = out.join(prompts, "id", "left").join(sums, "id", "left").join(dominant_model(store), "id", "left").join(tags_of(store), "id", "left")
    out = out.fillna(0, ["prompts", "responses", "tokens"]).fillna(0.0, ["cost"]).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return out.select("id", "workspace", "model", "started_at", "prompts", "responses", "tokens", "cost", "tags").orderBy(*sort)


def workspaces_matching(store: Store, text: str) -> DataFrame:
    """FLT-01 over the workspaces."""
    return store["workspaces"].where(in_workspace(text))
