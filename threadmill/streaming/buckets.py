"""A store on disk in buckets of conversations and in versions: a batch of files reads and rewrites the buckets of its own conversations, and no others.

Tables that belong to conversations are partitioned by a hash of the conversation's id, the ledger by a hash of the path, blobs by their own hash; vocabularies and the like, which are small, are
single tables. Nothing is ever written over. A batch writes the buckets that it touches into folders of their own; then one small file, versions/<number>, says for each table
and bucket in which folder it is. That file comes last and is there whole or not at all, so a reader sees the version before or the one after, whatever fails in between, and a reader
that has begun goes on with its version. Two writers that start from one version can't both commit: the second gets Conflict, and begins again. vacuum() deletes what no
version that is kept names.

Each version also has the number of the last batch of every stream, so a batch that comes twice is nothing the second time (STR-01), and the schema's version: columns that older
files lack are null, tables they lack are empty, and a store of a newer schema is an error (SNK-09).

Buckets grow by splitting, a few at a time: of `level` buckets the first `split` ones have been split in two by the next bit of the hash; when all have, the level doubles. So a store
that has grown a hundredfold is read and written bucket by bucket as before.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadmill.operators.maintenance import to_ingest
from threadmill.plans.pointers import Taken, names, read_text, write_once
from threadmill.plans.tables import delete, settled
from threadmill.schema import CHILDREN, SCHEMAS, VERSION, Store
from threadmill.sources.logs import READERS, first_sessions, with_ids
from threadmill.streaming.ingest import ingest
from threadmill.streaming.rollups import ROLLUPS

BUCKETS = 256
#: Responses and calls in a bucket, on average, from which on crowded() asks for splits.
MOST_ROWS = 2_000_000
#: Up to so many buckets are written without a shuffle: each task that reads writes a file of each bucket.
FEW = 8
#: Responses of a roll-up's slice, at least.
SLICE_ROWS = 10_000
LEDGER, BLOBS, PARENTS = "ingested_files", "content_blobs", ("prompts", "responses", "tool_calls")
#: Tables of conversations by their column that names one, and tables of what belongs to one by their parent and the column that names it.
OF_CONVERSATION = {"conversations": "id"} | dict(CHILDREN["conversations"])
OF_CHILD = {table: (parent, column) for parent in PARENTS for table, column in CHILDREN[parent]}
#: The column by whose hash a row of the tables that don't belong to conversations finds its bucket.
BY_KEY = {LEDGER: "path", BLOBS: "hash"}
IN_BUCKETS = {*BY_KEY, *OF_CONVERSATION, *OF_CHILD}


class Conflict(RuntimeError):
    """Another writer has committed a version since this one began."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    level: int = BUCKETS
    split: int = 0
    schema: int = VERSION
    #: Of each table the folder of each bucket; single tables have the bucket "".
    folders: dict[str, dict[str, str]] = field(default_factory=dict)
    #: Of each stream its last batch.
    streams: dict[str, int] = field(default_factory=dict)

    @property
    def n(self) -> int:
        return self.level + self.split


def bucket(key: str, version: Version) -> Column:
    hashed = F.xxhash64(key)
    first = F.pmod(hashed, F.lit(version.level))
    return F.when(first < version.split, F.pmod(hashed, F.lit(2 * version.level))).otherwise(first).cast("int").alias("bucket")


def _name(number: int) -> str:
    return f"{number:012d}"


def latest(spark: SparkSession, path: str) -> Version:
    """The last version of the store under path."""
    there = [n for n in names(spark, f"{path}/versions") if n.isdigit()]
    if not there:
        raise FileNotFoundError(f"no store under {path}")
    return at_version(spark, path, int(there[-1]))


def at_version(spark: SparkSession, path: str, number: int) -> Version:
    found = Version(**json.loads(read_text(spark, f"{path}/versions/{_name(number)}")))
    if found.schema > VERSION:
        raise ValueError(f"the store has version {found.schema} of the schema, this library knows {VERSION}")
    return found


def _commit(spark: SparkSession, path: str, version: Version) -> Version:
    made = replace(version, number=version.number + 1, schema=VERSION)
    try:
        write_once(spark, f"{path}/versions", _name(made.number), json.dumps(made.__dict__, separators=(",", ":")))
    except Taken:
        raise Conflict(f"{path} has a version {made.number} already") from None
    return made


@contextlib.contextmanager
def _lean(spark: SparkSession) -> Iterator[None]:
    """What is written inside takes no more disk than it must: a task opens a file for each of its buckets instead of sorting rows by them, and what a write shuffled goes when it is done."""
    settings = {"spark.sql.maxConcurrentOutputFileWriters": str(2 * FEW), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _put(rows: DataFrame, place: str, *by: str) -> None:
    """New files under place. Ids are digits and hex for the most part, which zstd makes smaller, but not Spark's own choice: 386 MB of responses, not 690, at thirty times sf0.1."""
    with _lean(rows.sparkSession):
        rows.write.option("compression", "zstd").partitionBy(*by).parquet(place)


def _with_bucket(store: Store, name: str, version: Version) -> DataFrame:
    """A table with its buckets."""
    if name in BY_KEY:
        return store[name].withColumn("bucket", bucket(BY_KEY[name], version))
    if name in OF_CONVERSATION:
        return store[name].withColumn("bucket", bucket(OF_CONVERSATION[name], version))
    parent, column = OF_CHILD[name]
    parents = store[parent].select(F.col("id").alias(column), F.col("conversation_id").alias("__c"))
    return store[name].join(parents, column).withColumn("bucket", bucket("__c", version)).drop("__c")


def _written(store: Store, path: str, version: Version, tables: list[str], touched: list[int] | None, ledger: list[int] | None, blobs: list[int] | None = None) -> Version:
    """The tables in new folders, and a version that names them instead of what these buckets (all, if None) had; not committed."""
    folders = {t: dict(of) for t, of in version.folders.items()}
    for name in tables:
        folder, columns = uuid.uuid4().hex[:16], SCHEMAS[name].names
        place = f"{path}/data/{name}/{folder}"
        if name not in IN_BUCKETS:
            _put(store[name].select(*columns), place)
            folders[name] = {"": folder}
            continue
        rows = _with_bucket(store, name, version).select(*columns, "bucket")
        old = {LEDGER: ledger, BLOBS: blobs}.get(name, touched)
        if name in OF_CHILD or (version.n if old is None else len(old)) > FEW:
            rows = rows.repartitionByRange("bucket", F.xxhash64(BY_KEY.get(name, "id")))
        _put(rows, place, "bucket")
        made = {n.removeprefix("bucket="): folder for n in names(rows.sparkSession, place) if n.startswith("bucket=")}
        gone = set(folders.get(name, {})) if old is None else {str(k) for k in old}
        folders[name] = {k: f for k, f in folders.get(name, {}).items() if k not in gone} | made
    return replace(version, folders=folders)


def _rolled(store: Store, path: str, version: Version, touched: list[int] | None) -> Version:
    """A version with the roll-ups of these buckets made anew, all if None. store: at least these buckets."""
    folders = dict(version.folders)
    # A large bucket is several files, of as many tasks: one task would sort all of it on disk. The rows are counted from the files' footers.
    tasks, n = int(next(iter(store.values())).sparkSession.conf.get("spark.sql.shuffle.partitions")), version.n if touched is None else max(1, len(touched))
    slices = max(1, min(tasks // n, store["responses"].count() // n // SLICE_ROWS))
    for name, (_, make) in ROLLUPS.items():
        folder = uuid.uuid4().hex[:16]
        place = f"{path}/data/{name}/{folder}"
        rows = make(store, lambda key: bucket(key, version), slices)
        _put(rows, place, "bucket")
        made = {n.removeprefix("bucket="): folder for n in names(rows.sparkSession, place) if n.startswith("bucket=")}
        kept = {} if touched is None else {k: f for k, f in folders.get(name, {}).items() if int(k) not in touched}
        folders[name] = kept | made
    return replace(version, folders=folders)


def keep_rollups(spark: SparkSession, path: str) -> Version:
    """From now on the store has roll-ups (rollups.py), and every batch keeps those of its buckets up to date."""
    version = latest(spark, path)
    return _commit(spark, path, _rolled(read(spark, path, version=version), path, version, None))


def rollup(spark: SparkSession, path: str, name: str, version: Version | None = None) -> DataFrame:
    """A roll-up of all buckets."""
    version, schema = version or latest(spark, path), ROLLUPS[name][0]
    if name not in version.folders:
        raise ValueError("the store has no roll-ups; see keep_rollups()")
    paths = [f"{path}/data/{name}/{folder}/bucket={k}" for k, folder in sorted(version.folders[name].items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write(store: Store, path: str, n: int = BUCKETS) -> Version:
    """A new store under path, with all these tables."""
    spark = next(iter(store.values())).sparkSession
    if names(spark, f"{path}/versions"):
        raise FileExistsError(f"there is a store under {path}")
    return _commit(spark, path, _written(store, path, Version(level=n), sorted(store), None, None))


def _table(spark: SparkSession, path: str, version: Version, name: str, some: list[int] | None) -> DataFrame:
    schema, of = SCHEMAS[name], version.folders.get(name, {})
    if name not in IN_BUCKETS:
        return spark.read.schema(schema).parquet(f"{path}/data/{name}/{of['']}") if of else spark.createDataFrame([], schema)
    wanted = of if some is None else {str(k): of[str(k)] for k in some if str(k) in of}
    paths = [f"{path}/data/{name}/{folder}/bucket={k}" for k, folder in sorted(wanted.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, buckets: list[int] | None = None, ledger: list[int] | None = None, version: Version | None = None, blobs: list[int] | None = None) -> Store:
    """SRC-13: the store under path, or these buckets of it, of its ledger and of its blobs, as of a version, the last one if not said. Batches that are committed later don't show in it."""
    version = version or latest(spark, path)
    return {name: _table(spark, path, version, name, {LEDGER: ledger, BLOBS: blobs}.get(name, buckets)) for name in SCHEMAS}


def _numbers(rows: DataFrame, key: str, version: Version) -> list[int]:
    """The buckets of the rows: no more than the store has."""
    return sorted(r["bucket"] for r in rows.where(F.col(key).isNotNull()).select(bucket(key, version)).distinct().collect())


def ingest_into(spark: SparkSession, path: str, files: DataFrame, harness: str, at: str, program: str = "threadmill", stream: str | None = None, batch: int | None = None) -> list[int]:
    """STR-01: ingest() into a store in buckets, as one version; the buckets of conversations that were read and written. Its cost follows the batch and these buckets.

    With a stream's name and the number of its batch, the batch is left out if the store has it already."""
    version = latest(spark, path)
    if stream is not None and batch is not None and version.streams.get(stream, -1) >= batch:
        return []
    files = settled(files)
    of_files = _numbers(files, "path", version)
    due = settled(to_ingest(files, read(spark, path, [], of_files, version)[LEDGER]))
    sessions = first_sessions(READERS[harness](due)).sessions
    touched = with_ids(sessions).select("id").union(due.select(F.col("old_conversation_id").alias("id")))
    buckets = _numbers(touched, "id", version)
    before = read(spark, path, buckets, of_files, version)
    after = ingest(before, files, harness, at, program)
    changed = [name for name in sorted(after) if after[name] is not before[name]]
    after = {name: settled(table) if name in changed else table for name, table in after.items()}
    made = _written(after, path, version, changed, buckets, of_files)
    if set(ROLLUPS) <= set(made.folders):
        made = _rolled(after, path, made, buckets)
    _commit(spark, path, replace(made, streams=version.streams | ({stream: batch} if stream is not None and batch is not None else {})))
    return buckets


def ingest_stream_into(files: DataFrame, harness: str, path: str, checkpoint: str, now: Callable[[], str], stream: str) -> StreamingQuery:
    """STR-01: every batch of a stream of files (ingest.file_stream) becomes a version of the store under path; one that comes again after a failure is nothing if it was committed."""

    def batch(rows: DataFrame, number: int) -> None:
        ingest_into(rows.sparkSession, path, rows, harness, now(), stream=stream, batch=number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- Upkeep ------------------------------------------------------------------------------------------------------------


def crowded(spark: SparkSession, path: str, most: int = MOST_ROWS) -> int:
    """How many buckets to split so that the average bucket has no more responses and calls than this; counted from the files' footers."""
    version = latest(spark, path)
    rows = sum(_table(spark, path, version, name, None).count() for name in ("responses", "tool_calls"))
    return max(0, -(-rows // most) - version.n)


def split(spark: SparkSession, path: str, some: int = 1) -> Version:
    """Split the next buckets in two, as one version. They are read and written, no others; single tables aren't touched."""
    version = latest(spark, path)
    some = min(some, version.level - version.split)
    old = list(range(version.split, version.split + some))
    after = replace(version, split=version.split + some)
    store = read(spark, path, old, old, version, old)
    # A table that these buckets have nothing of isn't written: to find its parents' buckets, these were shuffled.
    made = _written(store, path, after, sorted(t for t in IN_BUCKETS if {*map(str, old)} & {*version.folders.get(t, {})}), old, old, old)
    if set(ROLLUPS) <= set(made.folders):
        made = _rolled(store, path, made, old)
    if made.split == made.level:
        made = replace(made, level=2 * made.level, split=0)
    return _commit(spark, path, made)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all versions but the last `keep`, and the folders that none of these names; those of a batch that is being written, too, so no writer may be at work. What was deleted."""
    numbers = [int(n) for n in names(spark, f"{path}/versions") if n.isdigit()]
    kept = [at_version(spark, path, n) for n in numbers[-max(1, keep) :]]
    gone = [f"{path}/versions/{_name(n)}" for n in numbers[: -max(1, keep)]]
    for name in [*SCHEMAS, *ROLLUPS]:
        used: dict[str, set[str]] = {}
        for version in kept:
            for k, folder in version.folders.get(name, {}).items():
                used.setdefault(folder, set()).add(k)
        for folder in names(spark, f"{path}/data/{name}"):
            place = f"{path}/data/{name}/{folder}"
            if folder not in used:
                gone.append(place)
            elif name in IN_BUCKETS or name in ROLLUPS:
                gone += [f"{place}/{n}" for n in names(spark, place) if n.startswith("bucket=") and n.removeprefix("bucket=") not in used[folder]]
    for place in gone:
        delete(spark, place)
    return gone
