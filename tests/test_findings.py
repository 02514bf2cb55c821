"""What reviews of the queries found, in small."""

from __future__ import annotations

import ast
import inspect
import os
from pathlib import Path

import duckdb
import pytest

from pyspark.sql import functions as F

from threadmill import catalog, catalog_logs, schema
from threadmill.functions import scalars
from threadmill.operators import analytics, maintenance
from threadmill.sources import lines as log_lines
from threadmill.streaming import buckets, rollups

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("module", [catalog, catalog_logs])
def test_no_name_of_a_catalogue_is_bound_twice(module):
    """A query is a function that looks its constants up when it runs: a name bound again further down would give it another's."""
    seen: set[str] = set()
    for node in ast.parse(inspect.getsource(module)).body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        for name in (t.id for t in targets if isinstance(t, ast.Name)):
            assert name not in seen, name
            seen.add(name)


def _same(query: str, spark, folder) -> None:
    """The query gives the rows of its SQL on the tables of a folder."""
    frame, db = catalog.queries()[query](spark, str(folder)), duckdb.connect()
    for table in folder.glob("*.parquet"):
        db.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}{'/*.parquet' if table.is_dir() else ''}'")
    columns = sorted(frame.columns)
    key = lambda row: tuple(map(repr, row))
    assert sorted(map(tuple, frame.select(*columns).collect()), key=key) == sorted(db.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({catalog.oracle_sql()[query]})").fetchall(), key=key)


@pytest.fixture
def tables(tmp_path):
    """The smallest tables, in a folder of their own where a test may put others in their place."""
    for place in Path(SF).glob("*.parquet"):
        (tmp_path / place.name).symlink_to(place)
    return tmp_path


def _put(folder, name: str, sql: str) -> None:
    (folder / f"{name}.parquet").unlink()
    duckdb.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")


@pytest.mark.skipif(not Path(SF).is_dir(), reason="the tables aren't here")
@pytest.mark.parametrize("query", ["str01_to_ingest", "snk07_ledger"])
def test_pages_that_share_a_url(spark, tables, query):
    """Each is a file of its own, with its own hash, or none; some share the text, too."""
    _put(tables, "pages", f"SELECT page_id, 'u' || page_id % 7 AS url, CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'h' || page_id % 3 END AS html FROM '{SF}/pages.parquet'")
    _same(query, spark, tables)


def test_short_splits_share_tasks(spark, tmp_path):
    """Tasks don't grow with the number of splits: files and splits without end would each have been one."""
    rows = [(f"{k}.log", n, f"{n} é" * (k % 3)) for k in range(300) for n in range(4)]
    log_lines.write(spark.createDataFrame(rows, "name string, n int, line string"), f"file://{tmp_path}", "n")
    files = {p.name: p.read_text() for p in tmp_path.rglob("*.log")}
    assert files == {f"{k}.log": "".join(f"{n} é" * (k % 3) + "\n" for n in range(4)) for k in range(300)} and not list(tmp_path.rglob("_*"))
    read = log_lines.read(spark, f"file://{tmp_path}", "*.log", split_bytes=7)
    assert read.rdd.getNumPartitions() <= 2 * log_lines.TASKS
    assert sorted((r["path"].split("/")[-1], r["line"]) for r in read.collect()) == sorted((name, x) for name, _, x in rows if x)
    ends = log_lines.read(spark, f"file://{tmp_path}", "*.log", last=1)
    assert 1 < ends.rdd.getNumPartitions() <= 2 * log_lines.TASKS and ends.count() == 200


def test_a_large_bucket_is_rolled_up_by_several_tasks(spark, tmp_path):
    """One task a bucket had to sort all of its rows on disk."""
    path, size = f"file://{tmp_path}/store", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = spark.range(20_000).select(F.col("id").cast("string"), F.col("id").cast("string").alias("conversation_id"), F.col("id").cast("string").alias("model_id"), F.lit("2024").alias("started_at"), F.lit(1).cast("long").alias("input_tokens"))
    store = schema.empty_store(spark) | {t: schema.conform(rows, t) for t in ("conversations", "responses")}
    buckets.write({t: store[t] for t in ("conversations", "responses", "prompts", "tool_calls")}, path, 1)
    settings = {size: "32k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}  # as if the table were large
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        buckets.keep_rollups(spark, path)
    finally:
        for name in settings:
            spark.conf.set(name, before[name])
    assert len(list(tmp_path.glob("store/data/rollup_usage/*/bucket=0/*.parquet"))) > 1
    assert buckets.rollup(spark, path, "rollup_usage").agg(F.count("*"), F.sum("input_tokens")).first()[:] == (20_000, 20_000)


def _shuffled(spark, work) -> int:
    """Rows that work() shuffles."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    rows = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (found.apply(k) for found in [stages()] for k in range(found.size()))}
    before = rows()
    work()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for stage, n in rows().items() if stage not in before)


def test_a_store_with_rollups_shuffles_little(spark, tmp_path):
    """Disk: writing and splitting few buckets shuffled all rows, roll-ups all responses twice and, to find the buckets of children that there were none of, once for each table of these."""
    path, n = f"file://{tmp_path}/store", 2000
    rows = spark.range(n).select(F.col("id").cast("string"), (F.col("id") % 500).cast("string").alias("conversation_id"), F.col("id").cast("string").alias("model_id"), F.lit(1).cast("long").alias("input_tokens"))
    held = rows.where("CAST(id AS INT) < 500").withColumn("started_at", F.lit("2024"))
    store = {t: schema.conform(x, t) for t, x in (("conversations", held), ("responses", rows), ("prompts", rows.limit(0)), ("tool_calls", rows.limit(0)))}
    settings = ("spark.sql.maxConcurrentOutputFileWriters", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = [spark.conf.get(name) for name in settings]
    assert _shuffled(spark, lambda: buckets.write({t: store[t] for t in ("conversations", "responses")}, path, 4)) == 0
    # Responses and conversations once for usage; conversations, and a count for each in each task, for days.
    assert _shuffled(spark, lambda: buckets.keep_rollups(spark, path)) <= n + 500 + 4 * 500 + 200
    assert _shuffled(spark, lambda: buckets.split(spark, path, 4)) <= n + 500 + 8 * 500 + 200
    assert [spark.conf.get(name) for name in settings] == before
    assert buckets.latest(spark, path).n == 8 and buckets.read(spark, path)["responses"].select("id").distinct().count() == n
    assert buckets.rollup(spark, path, "rollup_usage").agg(F.sum("responses"), F.countDistinct("model_id")).first()[:] == (n, n)


@pytest.mark.parametrize("slices", [1, 3])
def test_rolled_up_cost_of_odd_rows(spark, slices):
    """Prices, workspaces and conversations that are there twice, or whose ids are null, and responses without any: as the joins have it."""
    make = lambda rows, columns, table: schema.conform(spark.createDataFrame(rows, columns), table)
    store = schema.empty_store(spark) | {
        "conversations": make([("c1", "w1", "2024-01-01"), ("c1", "w2", "2024-01-02"), ("c2", "w1", None), (None, "w1", "2024-01-01"), ("c3", None, "2024")], "id string, workspace_id string, started_at string", "conversations"),
        "workspaces": make([("w1", "/a"), ("w2", "/a"), ("w3", "/b"), ("w2", None)], "id string, path string", "workspaces"),
        "models": make([("m1", "x"), ("m2", "x"), ("m3", None)], "id string, name string", "models"),
        "pricing": make([("m1", "p1", 1.5, 2.0), ("m1", "p1", 0.25, None), ("m1", None, 9.0, 9.0), ("m2", "p2", 3.0, 0.1), (None, "p1", 7.0, 7.0)], "model_id string, provider_id string, input_per_mtok double, output_per_mtok double", "pricing"),
    }
    given = [(c, m, p, k * 1000, None if k % 3 == 0 else k * 77) for k, (c, m, p) in enumerate((c, m, p) for c in ("c1", "c2", "c3", "gone", None) for m in ("m1", "m2", "m3", "none", None) for p in ("p1", "p2", None))]
    store["responses"] = make(given, "conversation_id string, model_id string, provider_id string, input_tokens long, output_tokens long", "responses")
    of = rollups.usage(store, lambda key: F.pmod(F.xxhash64(key), F.lit(2)).alias("bucket"), slices)
    key = lambda t: sorted(map(str, t.collect()))
    assert key(rollups.cost(of, store)) == key(analytics.cost(store))
    # Responses of a conversation that is there twice count twice; those whose conversation is null or gone are kept, without a day.
    assert of.agg(F.sum("responses")).first()[0] == len(given) + 15 and of.where("day IS NULL AND workspace_id IS NULL AND harness_id IS NULL").agg(F.sum("responses")).first()[0] == 30


def test_usage_of_a_rollup_is_shuffled_once_for_models_and_prices(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if no table were small
    try:
        shuffles = lambda t: t._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        store = schema.empty_store(spark)
        of = rollups.usage(store, lambda key: F.pmod(F.xxhash64(key), F.lit(2)).alias("bucket"), 3)
        assert shuffles(of) == 1  # before: 3
        assert shuffles(rollups.cost(spark.createDataFrame([], rollups.USAGE), store)) == 6  # before: 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shell_calls_are_judged_once(spark):
    """Each call was read and its command parsed for every use of its category: six times, and for every word that a category has."""
    store = schema.empty_store(spark)
    store["tools"] = schema.conform(spark.createDataFrame([("t", "shell.execute"), ("u", "file.read")], "id string, name string"), "tools")
    given = [("a", "c1", "t", "git status"), ("b", "c1", "t", "pytest -q"), ("c", "c2", "t", "foo bar"), ("d", "c3", "u", "git status"), ("e", "c4", "t", "tm ask x"), ("f", "c5", "t", "cat x | head")]
    calls = spark.createDataFrame(given, "id string, conversation_id string, tool_id string, command string").withColumn("input", F.to_json(F.struct("command")))
    store["tool_calls"] = schema.conform(calls, "tool_calls")
    # A tag of a category's name alone isn't the category's.
    store["tags"] = schema.conform(spark.createDataFrame([("x", "vcs"), ("y", "shell:test")], "id string, name string"), "tags")
    out = maintenance.auto_shell_tags(store, "2024", "tm")
    assert "get_json_object" not in out["tool_call_tags"]._jdf.queryExecution().optimizedPlan().toString()
    names = {r["id"]: r["name"] for r in out["tags"].collect()}
    assert sorted(names.values()) == ["shell:file", "shell:test", "shell:vcs", "tm:derivative", "vcs"] and names["y"] == "shell:test"
    assert sorted((r["tool_call_id"], names[r["tag_id"]]) for r in out["tool_call_tags"].collect()) == [("a", "shell:vcs"), ("b", "shell:test"), ("f", "shell:file")]
    assert [(r["conversation_id"], names[r["tag_id"]]) for r in out["conversation_tags"].collect()] == [("c4", "tm:derivative")]
    parsed = calls.select(scalars.shell_category(scalars.command_of(F.col("input"))))._jdf.queryExecution().optimizedPlan().toString()
    assert parsed.count("get_json_object") < 8  # a command has two keys; it was parsed for each word of a category
