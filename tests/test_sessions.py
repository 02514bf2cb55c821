"""The registry of live sessions as a stream: what the batch functions say."""

from __future__ import annotations

import pytest

from threadmill.operators import maintenance
from threadmill.schema import SCHEMAS, empty_store
from threadmill.streaming import sessions

DAY = "2024-01-{:02} {:02}:00:00"


def seen(s, day, hour, workspace, started=None):
    return (s, "seen", DAY.format(day, hour), "own", workspace, started or f"2024-01-{day:02}T{hour:02}:00:00Z", None, None, None, None, None)


def tag(s, day, hour, i, name, exchange=None):
    return (s, "tag", DAY.format(day, hour), None, None, None, i, name, "conversation" if exchange is None else "prompt", exchange, None)


def other(s, kind, day, hour, conversation=None):
    return (s, kind, DAY.format(day, hour), None, None, None, None, None, None, None, conversation)


BATCHES = [
    [seen("a", 1, 10, "/one"), seen("a", 1, 9, "/zero"), tag("a", 1, 10, "t1", "x"), tag("a", 1, 10, "t1", "x"), tag("b", 1, 10, "t2", "x", 3), seen("gone", 1, 10, "/g"), tag("gone", 1, 10, "t9", "lost")],
    [seen("a", 1, 10, "/one"), seen("b", 1, 11, "/b"), tag("a", 1, 11, "t3", "x"), tag("a", 1, 11, "t4", "x", 0), seen("c", 1, 11, "/c"), other("c", "end", 1, 12)],  # repeated; another id of a tag that is queued; an end
    [other("a", "ingested", 1, 13, "conv-a"), tag("a", 1, 13, "t5", "again"), seen("b", 2, 10, "/b2")],
    [seen("a", 1, 1, "/too late"), seen("b", 4, 9, "/b4"), seen("d", 4, 9, "/d")],  # a's first event is behind the watermark by now
    [seen("d", 4, 10, "/d")],  # the watermark is past a's and gone's 48 hours
    [seen("d", 4, 10, "/d")],
]


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sessions")
    for k, rows in enumerate(BATCHES):
        frame = spark.createDataFrame(rows, sessions.EVENTS.replace("timestamp", "string"))
        frame.withColumn("at", frame["at"].cast("timestamp")).coalesce(1).write.mode("append").parquet(str(at / f"in/k={k}"))
    stream = spark.readStream.schema(sessions.EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(at / "in"))
    sessions.start(stream, str(at / "out"), str(at / "check")).awaitTermination()
    return at


def test_registry(spark, streamed):
    left, queued = sessions.current(spark, str(streamed / "out"))
    # By the batch functions.
    store = empty_store(spark)
    store["active_sessions"] = spark.createDataFrame([], SCHEMAS["active_sessions"])
    for rows in BATCHES:
        sightings = [(r[0], r[3], r[4], r[5], r[2].replace(" ", "T") + "Z") for r in rows if r[1] == "seen" and "late" not in r[4]]
        if sightings:
            store["active_sessions"] = maintenance.register_sessions(store["active_sessions"], spark.createDataFrame(sightings, SCHEMAS["active_sessions"]))
        tags = [(r[6], r[0], r[7], r[8], r[9], r[2].replace(" ", "T") + "Z") for r in rows if r[1] == "tag"]
        ingested = [r[0] for r in rows if r[1] == "ingested"]
        if ingested:
            store["pending_tags"] = store["pending_tags"].where(~store["pending_tags"]["harness_session_id"].isin(ingested) | store["pending_tags"]["created_at"].isNull())
        if tags:
            store["pending_tags"] = maintenance.queue_tags(store["pending_tags"], spark.createDataFrame(tags, SCHEMAS["pending_tags"]))
        ended = [(r[0],) for r in rows if r[1] == "end"]
        if ended:
            store["active_sessions"] = maintenance.unregister(store["active_sessions"], spark.createDataFrame(ended, "id string"))
    store = maintenance.expire_sessions(store, "2024-01-02T08:00:00Z")  # the watermark, 2 hours behind, less 48
    key = lambda t: sorted(map(str, t.collect()))
    assert key(left) == key(store["active_sessions"].select(*left.columns))
    # t5 came in the batch of a's ingest, so it was applied there; the batch functions queue it afterwards. Both drop it with the session.
    assert key(queued) == key(store["pending_tags"].select(*queued.columns))


def test_changes(spark, streamed):
    rows = [r.asDict() for r in spark.read.parquet(str(streamed / "out")).collect()]
    of = lambda change, *names: sorted(tuple(r[c] for c in names) for r in rows if r["change"] == change)
    assert of("applied", "id", "conversation_id") == [("t1", "conv-a"), ("t4", "conv-a"), ("t5", "conv-a")]
    assert of("expired", "harness_session_id") == [("a",), ("gone",)] and of("dropped", "id") == [("t9",)]
    assert of("ended", "harness_session_id") == [("c",)]
    assert len(of("queued", "id")) == 5  # t1 once, t3 is t1
    assert not any("late" in (r["workspace_path"] or "") for r in rows)
    first = [r for r in rows if r["harness_session_id"] == "a" and r["change"] == "session"]
    assert {(r["workspace_path"], r["started_at"], r["last_seen_at"]) for r in first} == {("/one", "2024-01-01T09:00:00Z", "2024-01-01T10:00:00Z")}
