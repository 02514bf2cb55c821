"""Live sessions and their queued tags as one stateful stream (STR-05, STR-06, STR-07).

Events of a session - sightings, tags, its end, the ingest of its conversation - come in any order and more than once. What is kept per session is one row, the queued tags by
name, kind and exchange, and one event-time timer: TTL after the last sighting (or tag) both go. Events that are older than the watermark are dropped by Spark. Every change comes out as a row,
written once per batch; the state is in Spark's state store, partitioned by session, so nothing but the sessions of a batch is touched, and survives lost executors
through the checkpoint.

The batch functions over tables say the same: operators.maintenance.register_sessions, unregister, queue_tags, consume_tags and expire_sessions. One difference: tags of a session that isn't
registered go TTL after the last of them, not at the next clean-up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threadmill.operators.maintenance import TTL_HOURS

#: kind: seen, tag, end or ingested. started_at: of seen; id, tag_name, entity_type, exchange_index: of tag; conversation_id: of ingested.
EVENTS = "harness_session_id string, kind string, at timestamp, adapter_name string, workspace_path string, started_at string, id string, tag_name string, entity_type string, exchange_index int, conversation_id string"
#: change: session (as it is now), ended, expired, queued, applied, dropped (a tag whose session expired).
CHANGES = "harness_session_id string, change string, n int, adapter_name string, workspace_path string, started_at string, last_seen_at string, id string, tag_name string, entity_type string, exchange_index int, conversation_id string, at string"
_COLUMNS = [c.split(" ")[0] for c in CHANGES.split(", ")]
_TTL_MS = TTL_HOURS * 3_600_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stands for no exchange in a tag's key.
_NONE = -1


def _iso(ms: int) -> str:
    return pd.Timestamp(ms, unit="ms").strftime("%Y-%m-%dT%H:%M:%SZ")


class Registry(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "adapter_name string, workspace_path string, started_at string, last_ms bigint")
        self.tags = handle.getMapState("tags", "tag_name string, entity_type string, exchange_index int", "id string, ms bigint")
        self.timer = handle.getValueState("timer", "ms bigint")

    def _wait(self, until: int) -> None:
        """The session's only timer, put off."""
        if self.timer.exists():
            (now,) = self.timer.get()
            if now >= until:
                return
            self.handle.deleteTimer(now)
        self.handle.registerTimer(until)
        self.timer.update((until,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (session,), out = key, []
        events = pd.concat(list(rows), ignore_index=True)
        events["ms"] = events["at"].astype("datetime64[ms]").astype("int64")
        seen = events[events["kind"] == "seen"]
        if len(seen):
            last = seen.loc[seen["ms"].idxmax()]
            starts = [s for s in seen["started_at"] if isinstance(s, str)]
            adapter, workspace, last_ms = last["adapter_name"], last["workspace_path"], int(last["ms"])
            if self.session.exists():
                was = self.session.get()
                starts += [was[2]] if was[2] is not None else []
                if was[3] >= last_ms:
                    adapter, workspace, last_ms = was[0], was[1], was[3]
            row = tuple(x if isinstance(x, str) else None for x in (adapter, workspace, min(starts, default=None)))
            self.session.update((*row, last_ms))
            self._wait(last_ms + _TTL_MS)
            out.append({"change": "session", "adapter_name": row[0], "workspace_path": row[1], "started_at": row[2], "last_seen_at": _iso(last_ms)})
        for e in events[events["kind"] == "tag"].sort_values(["ms", "id"]).itertuples(index=False):
            of = (e.tag_name, e.entity_type, _NONE if pd.isna(e.exchange_index) else int(e.exchange_index))
            if not self.tags.containsKey(of):
                self.tags.updateValue(of, (e.id, int(e.ms)))
                self._wait(int(e.ms) + _TTL_MS)
                out.append(self._tag("queued", of, e.id, int(e.ms)))
        for e in events[events["kind"] == "ingested"].itertuples(index=False):
            for of, (i, ms) in sorted(self.tags.iterator()):
                out.append(self._tag("applied", of, i, ms) | {"conversation_id": e.conversation_id})
            self.tags.clear()
        ends = events[events["kind"] == "end"]
        if len(ends) and self.session.exists() and self.session.get()[3] <= int(ends["ms"].max()):
            self.session.clear()
            out.append({"change": "ended"})
        if not self.session.exists() and not self.tags.exists():
            self._forget()
        yield self._rows(session, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (session,), out = key, []
        if self.session.exists():
            out.append({"change": "expired"})
        out += [self._tag("dropped", of, i, ms) for of, (i, ms) in sorted(self.tags.iterator())]
        self.session.clear()
        self.tags.clear()
        self.timer.clear()
        yield self._rows(session, out)

    def close(self) -> None:
        pass

    def _forget(self) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()

    @staticmethod
    def _tag(change: str, of: tuple, i: str, ms: int) -> dict:
        return {"change": change, "id": i, "tag_name": of[0], "entity_type": of[1], "exchange_index": None if of[2] == _NONE else of[2], "at": _iso(ms)}

    @staticmethod
    def _rows(session: str, out: list[dict]) -> pd.DataFrame:
        frame = pd.DataFrame([{"harness_session_id": session, "n": n} | row for n, row in enumerate(out)], columns=_COLUMNS)
        return frame.astype({"n": "int32", "exchange_index": "Int32"}).astype({c: object for c in _COLUMNS if c not in ("n", "exchange_index")})


def changes(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """STR-05 to STR-07: the changes (CHANGES) that a stream of EVENTS makes. late: how far behind the newest event one may be."""
    return events.withWatermark("at", late).groupBy("harness_session_id").transformWithStateInPandas(Registry(), CHANGES, "Update", "EventTime")


def start(events: DataFrame, path: str, checkpoint: str, late: str = "2 hours") -> StreamingQuery:
    """The changes as tables under path, one folder a batch; a batch that comes again replaces its own."""
    spark, name = events.sparkSession, "spark.sql.streaming.stateStore.providerClass"

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)  # a query takes it over when it starts
    try:
        return changes(events, late).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def current(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The sessions and queued tags that are left, of the changes under path: tables as active_sessions and pending_tags."""
    rows = spark.read.schema(CHANGES + ", batch bigint").parquet(path)

    def last(of: list[str], kinds: list[str]) -> DataFrame:
        newest = Window.partitionBy(*of).orderBy(F.desc("batch"), F.desc("n"))
        return rows.where(F.col("change").isin(kinds)).withColumn("__n", F.row_number().over(newest)).where(F.col("__n") == 1).where(F.col("change") == kinds[0])

    sessions = last(["harness_session_id"], ["session", "ended", "expired"]).select("harness_session_id", "adapter_name", "workspace_path", "started_at", "last_seen_at")
    tags = last(["harness_session_id", "tag_name", "entity_type", "exchange_index"], ["queued", "applied", "dropped"])
    return sessions, tags.select("id", "harness_session_id", "tag_name", "entity_type", "exchange_index", F.col("at").alias("created_at"))
