"""Incremental ingest: batches of new files, found by comparing with the ledger or by a stream over a folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadmill.functions.scalars import stable_id
from threadmill.operators.maintenance import auto_shell_tags, consume_tags, delete_rows, latest_sessions, newer_sessions, record_files, to_ingest
from threadmill.plans.tables import settled
from threadmill.schema import KEYS, SCHEMAS, Store, conform
from threadmill.sources.logs import HARNESSES, READERS, Logs, first_sessions, flatten

FILES = "path string, text string, file_hash string, modified timestamp"


def _merged(store: Store, new: Store) -> Store:
    """Both stores' rows; a vocabulary's row that is known stays as it is."""
    out = dict(store)
    for name, rows in new.items():
        keys = ["id"] if name not in KEYS or name in ("conversations", "prompts", "responses", "prompt_content", "response_content") else KEYS[name]
        added = rows.dropDuplicates(keys).join(store[name].select(*keys), keys, "left_anti")
        out[name] = store[name].unionByName(added.select(*SCHEMAS[name].names))
    return out


def ingest(store: Store, files: DataFrame, harness: str, at: str, program: str = "threadmill") -> Store:
    """STR-01 to STR-04, SNK-07: files (path, text, file_hash) of one harness that are new or changed, into the store.

    A changed file's conversation is replaced. Where sessions count instead of files, the one that ended last wins, and only if it ended
    after what the store has. A file that can't be read goes into the ledger with its error, and isn't tried again until it changes."""
    due = settled(to_ingest(files, store["ingested_files"]))
    logs = first_sessions(READERS[harness](due))
    logs = Logs(settled(logs.sessions), settled(logs.records), settled(logs.errors))
    sessions, by_session = logs.sessions, HARNESSES[harness][3] == "session"
    if by_session:
        keyed = sessions.withColumn("harness_id", F.col("harness"))
        known = store["conversations"].join(store["harnesses"].select(F.col("id").alias("harness_id"), F.col("name").alias("h")), "harness_id").withColumn("harness_id", F.col("h"))
        sessions = settled(newer_sessions(latest_sessions(keyed), known).select(*logs.sessions.columns))
    new = flatten(Logs(sessions, logs.records.join(sessions.select("path", "session"), ["path", "session"], "left_semi"), logs.errors), at)
    new = {name: settled(table) for name, table in new.items()}
    replaced = settled(new["conversations"].select("id").unionByName(due.where("old_conversation_id IS NOT NULL").select(F.col("old_conversation_id").alias("id"))).distinct())
    kept = delete_rows(store, "conversations", replaced)
    kept = {name: settled(table) if table is not store[name] else table for name, table in kept.items()}
    merged = _merged(kept, new)
    merged = {name: settled(table) if table is not kept[name] else table for name, table in merged.items()}
    made = new["conversations"].select("external_id", F.col("id").alias("conversation_id")).join(sessions.select("path", "external_id"), "external_id").select("path", "conversation_id")
    ledger = due.select("path", "file_hash").join(made, "path", "left").join(logs.errors, "path", "left").withColumn("harness_id", stable_id(F.lit("harnesses"), F.lit(harness)))
    merged = merged | {"ingested_files": settled(record_files(merged, ledger, at))}
    tagged = auto_shell_tags(merged, at, program)
    tagged = {name: settled(table) if table is not merged[name] else table for name, table in tagged.items()}
    ids = new["conversations"].select(F.element_at(F.split("external_id", "::"), -1).alias("session_id"), F.col("id").alias("conversation_id"))
    return consume_tags(tagged, ids, at)


def file_stream(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Files as they come into a folder: path, text, file_hash, modified."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.decode("content", "utf-8").alias("text"), F.sha2("content", 256).alias("file_hash"), F.col("modificationTime").alias("modified"))


def ingest_stream(files: DataFrame, harness: str, load: Callable[[], Store], save: Callable[[Store], None], checkpoint: str, now: Callable[[], str]) -> StreamingQuery:
    """Each batch of files goes through ingest(); the ledger makes a batch that comes twice harmless. load() and save() read and write snapshots."""

    def batch(rows: DataFrame, _: int) -> None:
        save(ingest(load(), rows, harness, now()))

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_in_stream(sessions: DataFrame) -> DataFrame:
    """STR-02 as a stream: of sessions (session_id, ended_at timestamp, ...) each one's latest so far, whenever a batch brings an end later than all before. What is kept is a time a session."""
    columns = [f.name for f in sessions.schema]

    def newer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else None
        row = None
        for frame in frames:
            frame = frame[frame["ended_at"].notna()]
            if len(frame):
                last = frame.loc[[frame["ended_at"].idxmax()]]
                end = int(last["ended_at"].iloc[0].value)
                if best is None or end > best:
                    best, row = end, last
        if row is not None:
            state.update((best,))
            yield row[columns]

    return sessions.groupBy("session_id").applyInPandasWithState(newer, sessions.schema, "ended_at bigint", "update", GroupStateTimeout.NoTimeout)


def active_stream(seen: DataFrame, gap: str = "2 hours") -> DataFrame:
    """STR-05, STR-07 as a stream: sightings (harness_session_id, seen_at timestamp) as sessions that end after a gap without one."""
    return seen.withWatermark("seen_at", gap).groupBy("harness_session_id", F.session_window("seen_at", gap)).agg(F.count("*").alias("sightings"), F.max("seen_at").alias("last_seen_at"))


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return conform(spark.createDataFrame([], SCHEMAS[name]), name)
