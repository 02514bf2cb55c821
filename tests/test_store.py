"""Sources, ingest, tags, maintenance, health checks, exports: over small logs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from threadmill.operators import analytics, exchanges, export, filters, fulltext, health, maintenance
from threadmill.plans import pointers
from threadmill.schema import SCHEMAS, empty_store, has_table, read_store, write_store
from threadmill.sources import logs
from threadmill.streaming import buckets, ingest, live, rollups

AT = "2024-02-01T00:00:00Z"


def lines(*records) -> str:
    return "\n".join(json.dumps(r) for r in records) + "\n"


def claude(second: str = "hello", session: str = "s1", end: str = "2024-01-01T00:00:03Z") -> str:
    user = lambda uuid, ts, content: {"type": "user", "sessionId": session, "cwd": "/test/project", "uuid": uuid, "timestamp": ts, "message": {"role": "user", "content": content}}
    said = lambda uuid, ts, content, i, o: {"type": "assistant", "sessionId": session, "uuid": uuid, "timestamp": ts, "message": {"role": "assistant", "model": "claude-3-opus-20240229", "content": content, "usage": {"input_tokens": i, "output_tokens": o}}}
    return lines(
        {"type": "summary"},
        said("u0", "2024-01-01T00:00:00Z", [{"type": "text", "text": "before any prompt"}], 1, 1),
        user("u1", "2024-01-01T00:00:00Z", second),
        said("u2", "2024-01-01T00:00:01Z", [{"type": "text", "text": "let me look"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "git status"}}, {"type": "tool_use", "id": "t2", "name": "Own", "input": {}}], 100, 50),
        user("u3", "2024-01-01T00:00:02Z", [{"type": "tool_result", "tool_use_id": "t1", "content": "clean", "is_error": False}]),
        said("u4", end, [{"type": "text", "text": "done"}], 150, 20),
    )


def filled(path):
    (path / "in").mkdir()
    (path / "in/a.jsonl").write_text(claude())
    return path


@pytest.fixture
def folder(tmp_path):
    return filled(tmp_path)


@pytest.fixture(scope="module")
def ingested_once(spark, tmp_path_factory):
    """The folder and its store after one ingest."""
    path = filled(tmp_path_factory.mktemp("once"))
    return path, saved(spark, ingested(spark, path), path, "s1")


def ingested(spark, folder, store=None, at=AT):
    found = logs.files(spark, str(folder / "in"), "*.jsonl")
    return ingest.ingest(store or empty_store(spark), found, "claude_code", at)


def saved(spark, store, folder, name):
    write_store(store, str(folder / name))
    return read_store(spark, str(folder / name))


def test_claude_code(spark, folder, ingested_once):
    store = ingested_once[1]
    assert [r["external_id"] for r in store["conversations"].collect()] == ["claude_code::s1"]
    assert store["prompts"].count() == 1
    assert sorted((r["input_tokens"], r["output_tokens"]) for r in store["responses"].collect()) == [(100, 50), (150, 20)]
    calls = store["tool_calls"].join(store["tools"].select(F.col("id").alias("tool_id"), "name"), "tool_id").collect()
    assert {(r["name"], r["status"]) for r in calls} == {("shell.execute", "success"), ("Own", "pending")}
    assert [r["name"] for r in store["tags"].collect() if r["name"].startswith("shell:")] == ["shell:vcs"]
    got = exchanges.exchanges(store).collect()[0]
    assert (got["prompt_text"], got["response_text"]) == ("hello", "let me look\n\ndone")
    assert [r["workspace"] for r in analytics.listing(store).collect()] == ["/test/project"]
    detail = exchanges.timeline(store, store["conversations"].select("id")).collect()
    assert len(detail) == 2 and [t["tool"] for t in detail[0]["tool_calls"]] == ["Own", "shell.execute"]


def test_ingest_again(spark, ingested_once):
    folder, store = ingested_once
    again = saved(spark, ingested(spark, folder, store), folder, "s2")
    assert [again[t].count() for t in ("conversations", "prompts", "responses", "tool_calls")] == [1, 1, 2, 2]
    (folder / "in/a.jsonl").write_text(claude("changed"))
    changed = saved(spark, ingested(spark, folder, again), folder, "s3")
    assert [r["prompt_text"] for r in exchanges.exchanges(changed).collect()] == ["changed"]
    (folder / "in/b.jsonl").write_text("no json\n")
    failed = saved(spark, ingested(spark, folder, changed), folder, "s4")
    ledger = {r["path"].rsplit("/", 1)[1]: r["error"] for r in failed["ingested_files"].collect()}
    assert ledger["a.jsonl"] is None and "no JSON" in ledger["b.jsonl"]
    found = logs.files(spark, str(folder / "in"), "*.jsonl")
    assert maintenance.to_ingest(found, failed["ingested_files"]).count() == 0
    assert [r["subject"] for r in health.ingest_errors(failed).collect()] == ["claude_code"]


def test_codex_and_gemini_and_aider(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(lines(
        {"type": "session_meta", "timestamp": "2024-01-01T00:00:00Z", "payload": {"id": "z", "cwd": "/q"}},
        {"type": "turn_context", "timestamp": "2024-01-01T00:00:00Z", "payload": {"model": "m"}},
        {"type": "response_item", "timestamp": "2024-01-01T00:00:01Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "list"}]}},
        {"type": "response_item", "timestamp": "2024-01-01T00:00:02Z", "payload": {"type": "function_call", "name": "shell_command", "arguments": '{"command":"ls"}', "call_id": "k"}},
        {"type": "response_item", "timestamp": "2024-01-01T00:00:03Z", "payload": {"type": "function_call_output", "call_id": "k", "output": "a"}},
        {"type": "response_item", "timestamp": "2024-01-01T00:00:04Z", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "there"}]}},
    ))
    store = logs.flatten(logs.codex_cli(logs.files(spark, str(tmp_path), "*.jsonl")), AT)
    assert [(r["input"], r["status"]) for r in store["tool_calls"].collect()] == [('{"command":"ls"}', "success")]
    assert store["responses"].count() == 2 and store["conversations"].first()["external_id"] == "codex_cli::z"

    (tmp_path / "g.json").write_text(json.dumps({"sessionId": "g", "startTime": "2024-01-01T00:00:00Z", "lastUpdated": "2024-01-02T00:00:00Z", "messages": [
        {"type": "user", "id": "1", "timestamp": "2024-01-01T00:00:00Z", "content": "q"},
        {"type": "gemini", "id": "2", "timestamp": "2024-01-01T00:00:01Z", "content": "a", "model": "gemini-2.5-pro", "tokens": {"input": 50, "output": 30}, "thoughts": [{"subject": "s"}],
         "toolCalls": [{"id": "c", "name": "list_files", "args": {"d": 1}, "status": "success", "result": [{"functionResponse": {"response": {"x": 1}}}]}]},
    ]}))
    store = logs.flatten(logs.gemini_cli(logs.files(spark, str(tmp_path), "*.json")), AT)
    assert [r["block_type"] for r in store["response_content"].orderBy("block_index").collect()] == ["thinking", "text", "tool_use"]
    assert [(r["input_tokens"], r["output_tokens"]) for r in store["responses"].collect()] == [(50, 30)]

    (tmp_path / "h.md").write_text("# aider chat started at 2024-01-01 10:00:00\n\n#### hi\n#### there\n\nanswer\n> Tokens: 4.5k sent, 1.2k received. Cost: $0.02\n# aider chat started at 2024-01-02 10:00:00\n#### two\n")
    found = logs.aider(logs.files(spark, str(tmp_path), "*.md"))
    assert found.sessions.count() == 2
    store = logs.flatten(logs.first_sessions(found), AT)
    assert {(r["key"], r["value"]) for r in store["response_attributes"].collect()} == {("approx_input_tokens", "4500"), ("approx_output_tokens", "1200"), ("approx_cost", "0.02")}
    assert [r["content"] for r in store["prompt_content"].collect()] == ['{"text":"hi\\nthere"}']


def test_tolerant_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\nbroken\n\n{"a":2}\n')
    good, bad = logs.tolerant(logs.json_lines(logs.files(spark, str(tmp_path), "*.jsonl")))
    assert good.count() == 2 and [(r["line_no"], r["raw"]) for r in bad.collect()] == [(2, "broken")]


def test_tags(spark, folder, ingested_once):
    store = ingested_once[1]
    ids = store["conversations"].select("id")
    store = saved(spark, maintenance.apply_tag(store, "conversation", ids, "good", AT), folder, "s2")
    store = maintenance.apply_tag(store, "conversation", ids, "good", AT)
    assert store["conversation_tags"].count() == 1 and filters.tagged(store, ["good"]).count() == 1
    assert filters.without_tags(store["conversations"], store, ["go:"]).count() == 1 and filters.with_all_tags(store["conversations"], store, ["good", "none"]).count() == 0
    with pytest.raises(KeyError):
        maintenance.rename_tag(store, "none", "x")
    with pytest.raises(ValueError):
        maintenance.rename_tag(store, "good", "shell:vcs")
    renamed = maintenance.rename_tag(store, "good", "better")
    assert filters.tagged(renamed, ["better"]).count() == 1
    gone, n = maintenance.delete_tag(renamed, "better")
    assert n == 1 and gone["conversation_tags"].count() == 0 and maintenance.delete_tag(gone, "better")[1] == -1
    assert maintenance.remove_tag(store, "conversation", ids, "good")["conversation_tags"].count() == 0


def test_deleting_a_conversation(spark, folder, ingested_once):
    store = ingested_once[1]
    left = maintenance.delete_rows(store, "conversations", store["conversations"].select("id"))
    assert all(left[t].count() == 0 for t in ("conversations", "prompts", "responses", "tool_calls", "prompt_content", "response_content", "tool_call_tags"))


def test_blobs(spark, folder, ingested_once):
    store = ingested_once[1]
    moved = saved(spark, maintenance.to_blobs(store, AT), folder, "s2")
    assert [(r["content"], r["ref_count"]) for r in moved["content_blobs"].collect()] == [('{"content":"clean"}', 1)]
    assert maintenance.blob_errors(moved).count() == 0
    assert [r["result"] for r in exchanges.results_with_content(moved["tool_calls"], moved).where("status = 'success'").collect()] == ['{"content":"clean"}']


def test_sessions_and_pending_tags(spark, folder):
    store = empty_store(spark)
    seen = spark.createDataFrame([("s1", "claude_code", "/p", "2024-01-01", "2024-01-02"), ("old", "claude_code", "/p", "2023-01-01", "2023-01-02")], store["active_sessions"].schema)
    store["active_sessions"] = maintenance.register_sessions(store["active_sessions"], seen)
    assert filters.newest_session(store["active_sessions"], "/p").first()["harness_session_id"] == "s1"
    new = spark.createDataFrame([("1", "s1", "later", "conversation", None, "a"), ("2", "s1", "later", "conversation", None, "b"), ("3", "s1", "here", "exchange", 0, "a"), ("4", "old", "x", "conversation", None, "a")], SCHEMAS["pending_tags"])
    store["pending_tags"] = maintenance.queue_tags(store["pending_tags"], new)
    assert store["pending_tags"].count() == 3
    store = maintenance.expire_sessions(store, "2024-01-01")
    assert store["pending_tags"].count() == 2 and health.pending_tags(store, "2024-01-01").count() == 0
    store = saved(spark, store, folder, "s0")
    done = saved(spark, ingested(spark, folder, store), folder, "s1")
    assert filters.tagged(done, ["later"]).count() == 1 and done["prompt_tags"].count() == 1 and done["pending_tags"].count() == 0


def test_merging_workspaces(spark):
    store = empty_store(spark)
    store["workspaces"] = spark.createDataFrame([("a", "/a", "r"), ("b", "/b", "r"), ("c", "/c", None)], "id string, path string, git_remote string")
    store["conversations"] = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b")], "id string, workspace_id string").select(*(F.col(c) if c in ("id", "workspace_id") else F.lit(None).cast("string").alias(c) for c in SCHEMAS["conversations"].names))
    merged = maintenance.merge_workspaces(store)
    assert {r["id"] for r in merged["workspaces"].collect()} == {"b", "c"} and {r["workspace_id"] for r in merged["conversations"].collect()} == {"b"}


def test_health(spark, folder, ingested_once):
    store = ingested_once[1]
    index = fulltext.build(fulltext.content(store))
    assert health.fts_stale(store, index).count() == 0
    assert health.fts_stale(store, fulltext.Index(index.postings, index.texts.limit(0))).count() > 0
    assert health.schema_current(store).count() == 0
    assert health.embeddings_stale(store).count() == 1 and health.orphaned_chunks(store).count() == 0
    assert health.pricing_gaps(store).count() == 1
    assert health.queries_valid(spark, {"good": "SELECT 1", "bad": "SELEC"}).first()["subject"] == "bad"
    assert health.config_valid(spark, "a = ").count() == 1 and health.config_valid(spark, "a = 1").count() == 0

    def broken():
        raise RuntimeError("no")

    assert {r["check"] for r in health.run(spark, {"broken": broken, "stale": lambda: health.embeddings_stale(store)}).collect()} == {"broken", "embeddings-stale"}


def test_live(spark, folder):
    found = logs.files(spark, str(folder / "in"), "*.jsonl")
    assert live.live_files(found, F.current_timestamp()).count() == 1 and live.live_files(found, F.to_timestamp(F.lit("2099-01-01"))).count() == 0
    parsed = logs.claude_code(found)
    row = live.session_list(parsed, found).first()
    assert (row["session_id"], row["exchanges"], row["model"]) == ("s1", 1, "claude-3-opus-20240229")
    assert live.by_prefix(live.session_list(parsed), "s").count() == 1
    said = live.live_exchanges(parsed, 1).first()
    assert (said["prompt_text"], said["input_tokens"]) == ("hello", 250) and {t["tool"] for t in said["tools"]} == {"Bash", "Own"}
    names = spark.createDataFrame([("/a/x/p",), ("/b/x/p",), ("/c/q",)], "w string")
    assert {(r["path"], r["name"]) for r in live.shortest_names(names, "w").collect()} == {("/a/x/p", "a/x/p"), ("/b/x/p", "b/x/p"), ("/c/q", "q")}


def test_stream(spark, folder):
    state = {"n": 0, "store": empty_store(spark)}

    def save(store):
        state["n"] += 1
        state["store"] = saved(spark, store, folder, f"stream{state['n']}")

    run = lambda: ingest.ingest_stream(ingest.file_stream(spark, str(folder / "in")), "claude_code", lambda: state["store"], save, str(folder / "cp"), lambda: AT).awaitTermination()
    run()
    (folder / "in/b.jsonl").write_text(claude(session="s2"))
    run()
    assert state["store"]["conversations"].count() == 2 and state["store"]["ingested_files"].count() == 2


def test_exports_and_query_texts(spark, folder, ingested_once):
    store = ingested_once[1]
    rows = exchanges.exchanges(store)
    calls = store["tool_calls"].join(store["responses"].select(F.col("id").alias("response_id"), "prompt_id"), "response_id").join(store["tools"].select(F.col("id").alias("tool_id"), F.col("name").alias("tool")), "tool_id")
    text = export.exchanges_markdown(rows, calls).first()["document"]
    assert "**User:** hello" in text and "*Tools: Own, shell.execute*" in text
    assert export.prompts_markdown(rows).first()["document"] == "## 1\n\nhello"
    assert json.loads(export.as_json(store, rows).first()["document"])["exchanges"][0]["prompt_text"] == "hello"
    assert export.selected(store, last=1).count() == 1
    export.register(store)
    sql = "-- a comment with :nothing\nSELECT 1; SELECT count(*) AS n, 'shell:vcs' AS t FROM prompts WHERE timestamp >= :since"
    assert export.parameters(sql) == ["since"]
    assert export.run_text(spark, sql, {"since": "2024", "more": 1}).first()["n"] == 1
    with pytest.raises(KeyError):
        export.run_text(spark, sql)
    with pytest.raises(PermissionError):
        export.run_text(spark, "DROP TABLE prompts")


def test_fan_out_is_the_product(spark):
    """The rewrite from counts equals the literal joins."""
    store = empty_store(spark)
    store["conversations"] = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-01"), ("c", "2024-01-02")], "id string, started_at string").withColumn("harness_id", F.lit("h"))
    store["prompts"] = spark.createDataFrame([("a",), ("a",), ("b",)], "conversation_id string")
    store["responses"] = spark.createDataFrame([("a",), ("a",), ("a",)], "conversation_id string")
    got = {r["day"]: (r["conversations"], r["prompts"], r["responses"]) for r in analytics.daily_activity(store).collect()}
    assert got == {"2024-01-01": (2, 7, 6), "2024-01-02": (1, 0, 0)}
    assert {r["day"]: (r["prompts"], r["responses"]) for r in analytics.daily_activity_exact(store).collect()}["2024-01-01"] == (3, 3)


def test_readers_by_path_and_name(spark):
    paths = ["/h/.claude/projects/a/b.jsonl", "/h/.codex/sessions/1/x.jsonl", "/h/.gemini/tmp/ff/chats/s.json", "/w/.aider.chat.history.md", "/w/other.jsonl"]
    found = logs.discovered(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert {r["path"]: r["harness"] for r in found.collect()} == dict(zip(paths, ["claude_code", "codex_cli", "gemini_cli", "aider"], strict=False))
    logs.register("own", logs.claude_code, "me", "jsonl", {"X": "file.read"}, "session", r"other\.jsonl$")
    try:
        assert logs.HARNESSES["own"][3] == "session" and logs.discovered(spark.createDataFrame([(paths[-1],)], "path string")).first()["harness"] == "own"
        with pytest.raises(ValueError):
            logs.register("a::b", None, "s", "f")
    finally:
        logs.unregister("own")
        assert "own" not in logs.READERS
    assert has_table(SCHEMAS, "pricing") and not has_table(SCHEMAS, "none")


def test_latest_in_stream(spark, tmp_path):
    given = [[("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 09:00:00"), ("a", "2024-01-01 08:00:00")], [("a", "2024-01-01 09:30:00"), ("b", "2024-01-01 09:00:01"), ("c", None)], [("a", "2024-01-02 00:00:00")]]
    for k, rows in enumerate(given):
        spark.createDataFrame(rows, "session_id string, e string").selectExpr("session_id", "CAST(e AS TIMESTAMP) AS ended_at").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/k={k}"))
    stream = spark.readStream.schema("session_id string, ended_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    query = ingest.latest_in_stream(stream).writeStream.outputMode("update").foreachBatch(lambda f, _: seen.append(sorted((r["session_id"], str(r["ended_at"])) for r in f.collect()))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [x for x in seen if x] == [[("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 09:00:00")], [("b", "2024-01-01 09:00:01")], [("a", "2024-01-02 00:00:00")]]


def test_a_check_that_fails_while_it_runs_is_a_finding(spark):
    late = lambda: spark.range(1).selectExpr("'x' AS check", "CAST(id AS STRING) AS subject", "raise_error('late') AS detail")
    fine = lambda: spark.range(1).selectExpr("'fine' AS check", "'s' AS subject", "'d' AS detail")
    assert sorted((r["check"], r["subject"]) for r in health.run(spark, {"late": late, "fine": fine}).collect()) == [("fine", "s"), ("late", "error")]


def test_a_batch_touches_its_own_buckets(spark, tmp_path):
    at, path = tmp_path / "store", str(tmp_path / "store")
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/{k}.jsonl").write_text(claude(session=f"session-{k}"))
    found = lambda name: logs.files(spark, str(tmp_path / "in"), name)
    buckets.write(empty_store(spark), path, 64)
    whole = buckets.ingest_into(spark, path, found("*.jsonl"), "claude_code", AT)
    count = lambda: {t: buckets.read(spark, path)[t].count() for t in ("conversations", "prompts", "responses", "tool_calls", "response_content", "ingested_files", "tool_call_tags")}
    first, before, reader = count(), buckets.latest(spark, path), buckets.read(spark, path)
    assert len(whole) > 1 and first["conversations"] == 3 and first["ingested_files"] == 3
    stamps = lambda: {p: p.stat().st_mtime_ns for p in at.rglob("*.parquet")}
    files = stamps()
    (tmp_path / "in/1.jsonl").write_text(claude("hello again", session="session-1"))
    one = buckets.ingest_into(spark, path, found("*.jsonl"), "claude_code", "2024-03-01T00:00:00Z")
    after = buckets.latest(spark, path)
    assert len(one) == 1 and count() == first
    # All files that there were are still the same; the new version names others for one bucket alone.
    assert files.items() <= stamps().items()
    for name in buckets.IN_BUCKETS - {"ingested_files"}:
        assert {k for k in {**before.folders[name], **after.folders[name]} if before.folders[name].get(k) != after.folders[name].get(k)} <= {str(one[0])}
    said = lambda store: [r["content"] for r in store["prompt_content"].collect()]
    assert sum("hello again" in s for s in said(buckets.read(spark, path))) == 1 and len(said(buckets.read(spark, path))) == first["prompts"]
    # Who read before still sees what there was.
    assert not any("hello again" in s for s in said(reader)) and not any("hello again" in s for s in said(buckets.read(spark, path, version=before)))
    assert buckets.ingest_into(spark, path, found("*.jsonl"), "claude_code", AT) == []
    gone = buckets.vacuum(spark, path, keep=1)
    assert gone and count() == first and len(said(buckets.read(spark, path))) == first["prompts"]
    with pytest.raises(Exception, match="versions"):
        buckets.at_version(spark, path, before.number)


def test_rollups_follow_the_batches(spark, tmp_path):
    path = str(tmp_path / "store")
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / f"in/{k}.jsonl").write_text(claude(session=f"session-{k}"))
    run = lambda: buckets.ingest_into(spark, path, logs.files(spark, str(tmp_path / "in"), "*.jsonl"), "claude_code", AT)
    buckets.write(empty_store(spark), path, 16)
    with pytest.raises(ValueError, match="keep_rollups"):
        buckets.rollup(spark, path, "rollup_days")
    run()
    buckets.keep_rollups(spark, path)

    def same():
        store, of = buckets.read(spark, path), lambda name: buckets.rollup(spark, path, name)
        key = lambda t: sorted(str(tuple(r[c] for c in sorted(t.columns))) for r in t.collect())
        for got, want in (
            (rollups.cost(of("rollup_usage"), store), analytics.cost(store)), (rollups.daily_activity(of("rollup_days")), analytics.daily_activity(store)),
            (rollups.daily_activity(of("rollup_days"), True), analytics.daily_activity_exact(store)), (rollups.harness_stats(of("rollup_days"), store), analytics.harness_stats(store)),
            (rollups.model_usage(of("rollup_usage"), store), analytics.model_usage(store)),
        ):
            assert key(got) == key(want) and key(got)

    same()
    before = buckets.latest(spark, path)
    (tmp_path / "in/2.jsonl").write_text(claude("other", session="session-2"))
    (one,) = run()
    after = buckets.latest(spark, path)
    for name in rollups.ROLLUPS:
        assert {k for k in {**before.folders[name], **after.folders[name]} if before.folders[name].get(k) != after.folders[name].get(k)} == {str(one)}
    same()
    buckets.split(spark, path, 16)
    buckets.vacuum(spark, path, keep=1)
    same()


def _sorted(store, names=("conversations", "prompts", "responses", "tool_calls", "prompt_content", "response_content", "ingested_files", "tool_call_tags", "response_attributes", "content_blobs")):
    return {t: sorted(map(str, store[t].collect())) for t in names}


def test_buckets_split(spark, tmp_path):
    path = str(tmp_path / "store")
    (tmp_path / "in").mkdir()
    for k in range(12):
        (tmp_path / f"in/{k}.jsonl").write_text(claude(session=f"session-{k}"))
    buckets.write(empty_store(spark), path, 2)
    buckets.ingest_into(spark, path, logs.files(spark, str(tmp_path / "in"), "*.jsonl"), "claude_code", AT)
    blobs = spark.createDataFrame([(f"h{k}", f"content {k}", 1, AT) for k in range(40)], SCHEMAS["content_blobs"])
    version = buckets.latest(spark, path)
    buckets._commit(spark, path, buckets._written({"content_blobs": blobs}, path, version, ["content_blobs"], None, None))
    rows = _sorted(buckets.read(spark, path))
    assert buckets.crowded(spark, path, 4) >= 2
    first = buckets.split(spark, path)
    assert (first.level, first.split, first.n) == (2, 1, 3) and _sorted(buckets.read(spark, path)) == rows
    second = buckets.split(spark, path, 5)
    assert (second.level, second.split) == (4, 0) and _sorted(buckets.read(spark, path)) == rows
    assert set(second.folders["conversations"]) <= {"0", "1", "2", "3"} and len(second.folders["conversations"]) > 2
    # Each row is in its bucket: a changed file finds its own.
    (tmp_path / "in/7.jsonl").write_text(claude("changed", session="session-7"))
    assert len(buckets.ingest_into(spark, path, logs.files(spark, str(tmp_path / "in"), "*.jsonl"), "claude_code", AT)) == 1
    assert {t: len(x) for t, x in _sorted(buckets.read(spark, path)).items()} == {t: len(x) for t, x in rows.items()}


def test_batches_of_a_stream_become_versions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(claude(session="a"))
    buckets.write(empty_store(spark), path, 8)
    run = lambda: buckets.ingest_stream_into(ingest.file_stream(spark, str(tmp_path / "in")), "claude_code", path, str(tmp_path / "cp"), lambda: AT, "logs").awaitTermination()
    run()
    known = lambda: sorted(r["external_id"] for r in buckets.read(spark, path)["conversations"].collect())
    assert known() == ["claude_code::a"] and buckets.latest(spark, path).streams == {"logs": 0}
    # A batch that comes again is nothing.
    version = buckets.latest(spark, path).number
    assert buckets.ingest_into(spark, path, logs.files(spark, str(tmp_path / "in"), "*.jsonl"), "claude_code", AT, stream="logs", batch=0) == []
    assert buckets.latest(spark, path).number == version
    # A batch that fails between two tables leaves the store as it was; it comes again, whole.
    (tmp_path / "in/b.jsonl").write_text(claude(session="b"))
    made = buckets._with_bucket

    def failing(store, name, version):
        if name == "prompts":
            raise RuntimeError("lost")
        return made(store, name, version)

    monkeypatch.setattr(buckets, "_with_bucket", failing)
    with pytest.raises(Exception, match="lost"):
        run()
    assert known() == ["claude_code::a"] and buckets.latest(spark, path).number == version
    monkeypatch.setattr(buckets, "_with_bucket", made)
    run()
    assert known() == ["claude_code::a", "claude_code::b"] and buckets.latest(spark, path).streams == {"logs": 1}
    # Two writers from one version: the second is told.
    with pytest.raises(buckets.Conflict):
        buckets._commit(spark, path, buckets.at_version(spark, path, version))
    with pytest.raises(FileExistsError):
        buckets.write(empty_store(spark), path)


def test_stores_of_other_schemas(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store = {"conversations": spark.createDataFrame([("c1", "x::1", "h", "w", None, "2024", None)], SCHEMAS["conversations"])}
    buckets.write(store, path, 4)
    # An older file without a column, and a store without most tables.
    version = buckets.latest(spark, path)
    ((k, folder),) = version.folders["conversations"].items()
    old = spark.read.parquet(f"{path}/data/conversations/{folder}/bucket={k}").drop("branch", "ended_at")
    old.write.parquet(f"{path}/data/conversations/old/bucket={k}")
    buckets._commit(spark, path, buckets.replace(version, folders={"conversations": {k: "old"}}))
    row = buckets.read(spark, path)["conversations"].first()
    assert (row["id"], row["branch"], row["ended_at"]) == ("c1", None, None) and buckets.read(spark, path)["prompts"].count() == 0
    monkeypatch.setattr(buckets, "VERSION", 2)
    buckets._commit(spark, path, buckets.latest(spark, path))
    monkeypatch.setattr(buckets, "VERSION", 1)
    with pytest.raises(ValueError, match="version 2"):
        buckets.latest(spark, path)


def test_scratch_tables_go(spark):
    from threadmill.plans import tables

    kept = tables.settled(spark.range(3), "kept")
    with tables.scratch(spark):
        gone = tables.settled(spark.range(4), "gone")
        assert gone.count() == 4
    assert kept.count() == 3 and not pointers.names(spark, gone._settled_at)
    tables.discard(kept, gone)  # gone is gone already
    assert not pointers.names(spark, kept._settled_at)
