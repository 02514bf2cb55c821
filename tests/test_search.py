"""Vectors, diversity, recency, full text, chunks."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadmill.operators import chunks, exchanges, fulltext, vectors
from threadmill.schema import empty_store

E1, E2, E3 = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]


def ranked(spark, rows, **options):
    frame = spark.createDataFrame([(f"k{i}", c, v, s) for i, (c, v, s) in enumerate(rows)], "chunk_id string, conversation_id string, embedding array<float>, score double").withColumn("query", F.lit("q"))
    return [(r["conversation_id"], r["mmr_penalty"]) for r in vectors.mmr(frame, **options).orderBy("mmr_rank").collect()]


def test_mmr_holds_back_the_same_conversation(spark):
    got = ranked(spark, [("c1", E1, 0.95), ("c1", E2, 0.90), ("c2", E3, 0.50)], lambda_=0.5)
    assert [c for c, _ in got] == ["c1", "c2", "c1"] and got[2][1] == 1.0


def test_mmr_one_of_each_first(spark):
    got = ranked(spark, [("c1", E1, 0.9), ("c1", E1, 0.89), ("c2", E2, 0.5), ("c2", E2, 0.49), ("c3", E3, 0.3)], lambda_=0.5, limit=3)
    assert {c for c, _ in got} == {"c1", "c2", "c3"}


def test_mmr_relevance_only_and_near_duplicates(spark):
    rows = [("c1", E1, 0.9), ("c2", [0.99, 0.1, 0.0], 0.85), ("c3", E3, 0.60)]
    assert [c for c, _ in ranked(spark, rows, lambda_=1.0)] == ["c1", "c2", "c3"]
    assert [c for c, _ in ranked(spark, rows, lambda_=0.5)] == ["c1", "c3", "c2"]


def test_mmr_ties_go_to_the_larger_id(spark):
    assert ranked(spark, [("c1", E1, 0.5), ("c2", E1, 0.5)], limit=1)[0][0] == "c2"


def test_top_k(spark):
    frame = spark.createDataFrame([("a", "c1", E1), ("b", "c2", [0.9, 0.1, 0.0]), ("c", "c3", E2)], "chunk_id string, conversation_id string, embedding array<float>")
    assert [r["chunk_id"] for r in vectors.top_k(frame, E1, 2).collect()] == ["a", "b"]
    only = spark.createDataFrame([("c2",)], "id string")
    assert [r["chunk_id"] for r in vectors.top_k(frame, E1, 5, only).collect()] == ["b"]


def test_recency(spark):
    at = F.to_timestamp(F.lit("2024-03-01T00:00:00Z"))
    frame = spark.createDataFrame([("2024-03-01T00:00:00Z",), ("2024-01-31T00:00:00",), ("2020-01-01T00:00:00Z",), ("?",), ("2030-01-01T00:00:00Z",)], "t string").coalesce(1)
    got = [r[0] for r in frame.select(vectors.recency_weight(F.col("t"), at)).collect()]
    assert round(got[0], 6) == 1.15 and round(got[1], 3) == 1.075 and 1 <= got[2] < 1.0001 and got[3] == 1 and round(got[4], 6) == 1.15


def test_threads_and_scores(spark):
    frame = spark.createDataFrame([("k1", "a", "t1", 0.9), ("k2", "a", "t2", 0.5), ("k3", "b", "t3", 0.2)], "chunk_id string, conversation_id string, text string, score double")
    assert {(r["chunk_id"], r["tier"]) for r in vectors.threads(frame).collect()} == {("k1", 1), ("k2", 1), ("k3", 2)}
    assert vectors.conversation_scores(frame, 1).collect()[0].asDict() == {"conversation_id": "a", "max_score": 0.9, "mean_score": 0.7, "chunks": 2, "excerpt": "t1"}


def texts(spark, rows):
    return fulltext.build(spark.createDataFrame([(t, f"t{i}", "prompt", c) for i, (c, t) in enumerate(rows)], "text string, content_id string, side string, conversation_id string"))


def test_recall_needs_enough_conversations(spark):
    index = texts(spark, [(f"c{k}", "alpha beta" if k < 3 else "alpha") for k in range(12)])
    assert {r["mode"] for r in fulltext.recall(index, "alpha").collect()} == {"and"}
    got = fulltext.recall(index, "alpha beta").collect()
    assert {r["mode"] for r in got} == {"or"} and len(got) == 12
    assert fulltext.recall(index, "!!").collect() == []


def test_search_folds_case_and_marks(spark):
    index = texts(spark, [("a", "Café au lait"), ("b", "the cafes")])
    assert [r["conversation_id"] for r in fulltext.search(index, "CAFE").collect()] == ["a"]


def test_match_queries(spark):
    rows = [("a", "red fox jumps"), ("b", "fox red"), ("c", "Foxes and wolves"), ("d", "a red wolf"), ("e", "the Red Fox, again the red fox")]
    index = texts(spark, rows)
    ids = lambda q: "".join(sorted(r["conversation_id"] for r in fulltext.search(index, q).collect()))
    asked = {"red fox": "abe", '"red fox"': "ae", "fox*": "abce", "fox NOT jumps": "be", "wolf OR wolves": "cd", "(wolf OR fox) AND red": "abde", "red AND fox OR wolves": "abce", '"red fo"*': "ae", '"red fox" NOT again': "a", "RED not": "", "fóx": "abe"}
    assert {q: ids(q) for q in asked} == asked
    for bad in ("red AND", "(red", "red)", "OR", '"red', "red-fox", "", "NOT red", "()"):
        with pytest.raises(ValueError, match="malformed"):
            fulltext.match(bad)
    best = fulltext.search(index, '"red fox"').collect()
    assert best[0]["snippet"].count(">>>") == 4 and best[0]["conversation_id"] == "e"


def test_inserting_equals_building(spark, tmp_path):
    rows = [(f"text {k} of some words {k % 3}", f"t{k}", "prompt", f"c{k % 4}") for k in range(20)]
    frame = spark.createDataFrame(rows, "text string, content_id string, side string, conversation_id string")
    path = str(tmp_path / "index")
    fulltext.write(fulltext.build(frame.where("conversation_id = 'c1'"), "one"), path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    fulltext.insert(frame.union(frame), path)
    fulltext.insert(frame, path)
    stored, whole = fulltext.read(spark, path), fulltext.build(frame)
    key = lambda t: sorted(map(str, t.select("term", "content_id", "tf", "positions").collect()))
    assert key(stored.postings) == key(whole.postings) and stored.texts.count() == 20
    assert {p: p.stat().st_mtime_ns for p in before} == before
    assert [tuple(r) for r in fulltext.search(stored, "words 2").collect()] == [tuple(r) for r in fulltext.search(whole, "words 2").collect()]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "text string, content_id string, side string, conversation_id string")


def test_upkeep_equals_rebuilding(spark, tmp_path):
    path, rng = str(tmp_path / "index"), np.random.default_rng(2)
    made = lambda k, v: (" ".join(rng.choice([*"abcdefgh", "common"], rng.integers(1, 9))) + f" common {v}", f"t{k:03}", "prompt", f"c{k % 5}")
    now = {}
    for step in range(7):
        rows = [made(k, step) for k in range(step * 6, step * 6 + 6)]
        now |= {r[1]: r for r in rows}
        fulltext.insert(_frame(spark, rows), path)
        assert fulltext.insert(_frame(spark, rows[:2]), path) is None
        fulltext.merge(spark, path)
        assert len(fulltext.read(spark, path).segments) < 2 * fulltext.WIDTH
    gone = sorted(now)[::5]
    reader = fulltext.read(spark, path)
    assert fulltext.delete(spark.createDataFrame([(i,) for i in [*gone, "nothing"]], "content_id string"), path) == len(gone)
    assert fulltext.delete(spark.createDataFrame([(i,) for i in gone], "content_id string"), path) == 0
    now = {k: r for k, r in now.items() if k not in gone}
    changed = [made(int(i[1:]), "changed") for i in sorted(now)[::4]]
    now |= {r[1]: r for r in changed}
    fulltext.replace(_frame(spark, changed), path)
    whole = fulltext.build(_frame(spark, list(now.values())))
    rank = lambda rows: [(r["content_id"], round(r["rank"], 9)) for r in rows.orderBy("rank", "content_id").collect()]
    queries = [["common", "a"], ["changed"], ["b", "c", "d"]]

    def same(index):
        for q in queries:
            for every in (False, True):
                want = rank(fulltext.scored(whole, q, every))
                assert rank(fulltext.scored(index, q, every)) == want
                assert rank(fulltext.best(index, q, 5, every)) == want[:5]
        assert rank(fulltext.scored(index, fulltext.match('"common changed" OR a*'))) == rank(fulltext.scored(whole, fulltext.match('"common changed" OR a*')))
        assert fulltext.stale(index, _frame(spark, list(now.values()))).count() == 0
        assert sorted(r["content_id"] for r in index.live().collect()) == sorted(now)

    stored = fulltext.read(spark, path)
    assert stored.marks.count() > 0 and stored.totals == (len(now), sum(len(r[0].split()) for r in now.values()))
    same(stored)
    assert reader.live().count() == 42  # it began before
    # A segment that no version names counts for nothing.
    fulltext._add_segment(_frame(spark, [made(999, 0)]), path, "failed")
    same(fulltext.read(spark, path))
    while fulltext.due(version := fulltext._version(spark, path)) is None:
        fulltext.delete(spark.createDataFrame([(i := sorted(now)[0],)], "content_id string"), path)
        del now[i]
    whole = fulltext.build(_frame(spark, list(now.values())))
    assert fulltext.merge(spark, path) > 0 and fulltext._version(spark, path)["number"] > version["number"]
    fulltext.vacuum(spark, path)
    same(fulltext.read(spark, path))


def test_best_reads_few_blocks(spark, tmp_path, monkeypatch):
    """Short texts score higher: long ones' blocks can't reach the best."""
    monkeypatch.setattr(fulltext, "BLOCK_TEXTS", 8)
    path = str(tmp_path / "index")
    rows = [("word " + "filler " * (k % 40) + "other " * (k % 3), f"t{k:03}", "prompt", f"c{k}") for k in range(400)]
    fulltext.insert(_frame(spark, rows), path)
    index, seen = fulltext.read(spark, path), []
    got = fulltext.best(index, ["word", "other"], 5, read_blocks=seen).collect()
    want = fulltext.scored(fulltext.build(_frame(spark, rows)), ["word", "other"]).orderBy("rank", "content_id").limit(5).collect()
    assert [(r["content_id"], round(r["rank"], 9)) for r in got] == [(r["content_id"], round(r["rank"], 9)) for r in want]
    read = sum(r["n"] for f in seen for r in f.collect())
    assert read < 0.5 * index.postings.where("term IN ('word', 'other')").count()


def test_nearest_is_the_top_of_all(spark):
    rng = np.random.default_rng(5)
    m = rng.integers(-3, 4, (60, 5)).astype(float)
    m[7] = 0
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "chunk_id long, embedding array<float>").repartition(3)
    asked = frame.where("chunk_id % 7 = 0").select(F.col("chunk_id").alias("query"), "embedding")
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    ties = {}
    for block, most in ((3, 1 << 20), (512, 1 << 20), (512, 0)):
        rows = vectors.nearest(frame, asked, 4, block, most)
        assert "NestedLoop" not in rows._jdf.queryExecution().toString() and "Cartesian" not in rows._jdf.queryExecution().toString()
        rows = rows.collect()
        got = {(r["query"], r["place"]): r["score"] for r in rows}
        ties.setdefault("ids", [(r["query"], r["place"], r["chunk_id"]) for r in sorted(rows)])
        assert [(r["query"], r["place"], r["chunk_id"]) for r in sorted(rows)] == ties["ids"]
        assert len(got) == 9 * 4
        for q in range(0, 60, 7):
            assert [got[q, p] for p in range(1, 5)] == pytest.approx(sorted((unit @ unit[q]).tolist(), reverse=True)[:4])


def test_nearest_holds_no_matrix_of_a_whole_batch():
    """What a task takes was 8 bytes for each pair of a block of queries and the rows that Spark gives it at once, several times over."""
    rng = np.random.default_rng(7)
    n, d, k = 10_000, 8, 3
    points, units = rng.normal(size=(n, d)).astype(np.float32), vectors._units(rng.normal(size=(256, d)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.array(points.ravel()))], ["chunk_id", "embedding"])
    best = vectors._best(SimpleNamespace(value=(pa.array(np.arange(256)), units)), k, 256, pa.int64())
    tracemalloc.start()
    found = pa.Table.from_batches(list(best(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 256 * n
    score = units @ vectors._units(points.astype(float)).T
    assert found.column("chunk_id").to_numpy().reshape(256, k).tolist() == np.argsort(-score, axis=1)[:, :k].tolist()


def test_snippet(spark):
    frame = spark.createDataFrame([("one two three four five six",)], "x string")
    assert frame.select(fulltext.snippet(F.col("x"), ["three", "four"], 3)).first()[0] == "...>>>three<<< >>>four<<< five..."


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab .\n", max_size=60), max_size=12))
def test_windows_keep_order_and_bounds(parts):
    given_ = [(str(k), p.strip()) for k, p in enumerate(parts) if p.strip()]
    got = list(chunks.windows(given_, target=8, most=12, overlap=2))
    ids = [i for _, x in got for i in x]
    assert list(dict.fromkeys(ids)) == [i for i, _ in given_]
    assert all(chunks.count_words(t) <= 12 for t, _ in got)


def test_split_text():
    assert chunks.split_text("  ") == [] and chunks.split_text(" short ") == ["short"]
    text = " ".join(f"w{k}" for k in range(100)) + "."
    got = chunks.split_text(text, target=20, most=30, overlap=5)
    assert all(chunks.count_words(t) <= 30 for t in got) and got[0].split()[-5:] == got[1].split()[:5]


def test_index_life_cycle(spark):
    rows = spark.createDataFrame([("c1", "p1", "1", "alpha"), ("c1", "p2", "2", "beta"), ("c2", "p3", "1", "gamma")], "conversation_id string, prompt_id string, timestamp string, text string")
    made = chunks.embedded(chunks.chunk_exchanges(rows), lambda: lambda ts: [vectors.hashed_vector(t) for t in ts], "now")
    assert {(r["conversation_id"], r["text"], tuple(r["source_ids"])) for r in made.collect()} == {("c1", "alpha\n\nbeta", ("p1", "p2")), ("c2", "gamma", ("p3",))}
    assert [r["conversation_id"] for r in chunks.unindexed(rows, made.where("conversation_id = 'c1'")).collect()] == ["c2"]


def test_hybrid(spark):
    store = empty_store(spark)
    rows = [(f"k{i}", f"c{i}", t, vectors.hashed_vector(t), [f"p{i}"]) for i, t in enumerate(["error handling in rust", "error handling in python", "cooking rice"])]
    store["chunks"] = spark.createDataFrame(rows, "id string, conversation_id string, text string, embedding array<float>, source_ids array<string>")
    store["conversations"] = spark.createDataFrame([(f"c{i}", "w", f"2024-01-0{i + 1}T00:00:00Z") for i in range(3)], "id string, workspace_id string, started_at string")
    store["workspaces"] = spark.createDataFrame([("w", "/w")], "id string, path string")
    store["prompts"] = spark.createDataFrame([(f"p{i}", f"2024-01-0{i + 1}T01:00:00Z") for i in range(3)], "id string, timestamp string")
    at = F.to_timestamp(F.lit("2024-02-01"))
    got = vectors.hybrid(store, "error handling in python", vectors.hashed_vector, at, limit=2).collect()
    assert got[0]["conversation_id"] == "c1" and got[0]["workspace"] == "/w" and got[0]["mmr_rank"] == 1
    live = spark.createDataFrame([("c1",)], "id string")
    assert vectors.hybrid(store, "error handling in python", vectors.hashed_vector, at, live=live, limit=1).first()["conversation_id"] == "c0"
    first = vectors.first_mention(vectors.similar(store["chunks"].withColumnRenamed("id", "chunk_id"), vectors.hashed_vector("error handling in python")), store, 0.3)
    assert first.first()["chunk_id"] == "k0"
    explained = vectors.explained(vectors.hybrid(store, "error", vectors.hashed_vector, at, limit=1)).first()["breakdown"]
    assert '"mmr_rank":1' in explained


def test_runs(spark):
    calls = spark.createDataFrame([("r", k, t, s) for k, (t, s) in enumerate([("a", "ok"), ("a", "ok"), ("b", "ok"), ("a", "ok"), ("a", "error"), (None, None)])], "id string, k int, tool string, status string")
    got = exchanges.collapsed_calls(calls, "id", ["k"]).orderBy("run").collect()
    assert [(r["tool"], r["status"], r["n"]) for r in got] == [("a", "ok", 2), ("b", "ok", 1), ("a", "ok", 1), ("a", "error", 1), ("unknown", "unknown", 1)]


def test_a_conversation_of_any_length_is_cut_in_order(spark):
    """Rows of one conversation come in many batches; what is held is the open window."""
    rows = [("long", f"p{k:05}", f"{k:05}", "one two three four") for k in range(5000)] + [("short", "q", "1", "alpha beta"), ("none", "q", "1", "")]
    frame = spark.createDataFrame(rows, "conversation_id string, prompt_id string, timestamp string, text string").repartition(7)
    got = chunks.chunk_exchanges(frame, target=10, most=12).orderBy("conversation_id", "chunk_no").collect()
    long = [r for r in got if r["conversation_id"] == "long"]
    assert [r["chunk_no"] for r in long] == list(range(2500)) and [i for r in long for i in r["source_ids"]] == [f"p{k:05}" for k in range(5000)]
    assert {(r["conversation_id"], r["text"]) for r in got if r["conversation_id"] != "long"} == {("short", "alpha beta"), ("none", "")}
