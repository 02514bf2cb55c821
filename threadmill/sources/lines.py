"""Lines of log files by their places, as a data source: a large file in many tasks, or only the end of each file (SRC-11, STR-08, STR-12).

    spark.dataSource.register(LogLines)
    spark.read.format("log_lines").option("path", "/logs").option("pattern", "*.jsonl").load()
    spark.read.format("log_lines").option("path", "/logs").option("last", 20).load()

A file is cut every split_bytes; a task reads the lines that begin in its split, so a line that crosses a border is read once, by the task in whose split it begins. seq is the
byte at which a line begins: lines are in its order, though not numbered. With `last`, a task seeks from a file's end backwards, by blocks of twice the size each, and stops
at the last n lines with text, so what is read follows n and not the file. Small files are put together in a task. Files are found and read through pyarrow.fs, wherever that reaches.

Lines end with a line feed; blank ones are left out. Bytes that are no UTF-8 become U+FFFD. A file that a writer is appending to is read up to the size it had when the query was planned; with
an unfinished last line, that part of it is a line. An empty file has none. A line of any length is one row, and is held by one task.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a split; small files share a task up to so many.
SPLIT_BYTES = 64 << 20
#: Tasks from which on short splits are put together.
TASKS = 128
#: Folders that write() spreads its files over.
FOLDERS = 256
#: The first block of a file's end.
BLOCK_BYTES = 1 << 14
#: Rows that go to Spark at once, and their bytes.
_ROWS, _BYTES = 4096, 8 << 20
#: What is read of a split at once.
_BLOCK = 1 << 20
SCHEMA = "path string, seq bigint, line string, split bigint"


@dataclass
class Piece(InputPartition):
    """(path, first byte, end, size of the file) of each."""

    ranges: list[tuple[str, int, int, int]]


def _found(path: str, pattern: str) -> list[tuple[str, int]]:
    """Files below a path whose names fit, and their sizes, in order."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    infos = [store.get_file_info(root)]
    if infos[0].type == fs.FileType.Directory:
        infos = store.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda i: i.base_name.startswith((".", "_"))
    return sorted((scheme + i.path, i.size) for i in infos if i.type == fs.FileType.File and not hidden(i) and fnmatch.fnmatch(i.base_name, pattern))


def _open(path: str):
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def last_lines(file, size: int, n: int, block: int = BLOCK_BYTES) -> tuple[list[tuple[int, bytes]], int]:
    """The last n lines with text of an open file, (first byte, line) each, and how many bytes were read."""
    parts: list[bytes] = []
    at, texts = size, 0
    while at > 0 and texts <= n:  # one line more than asked for, as the first may be cut
        step = min(block, at)
        at, block = at - step, 2 * block
        parts.append(file.read_at(step, at))
        texts = sum(1 for x in b"".join(reversed(parts)).split(b"\n") if x.strip()) if parts[-1].count(b"\n") else texts
    data, place, out = b"".join(reversed(parts)), at, []
    for k, line in enumerate(data.split(b"\n")):
        if line.strip() and (k > 0 or at == 0):
            out.append((place, line))
        place += len(line) + 1
    return out[-n:] if n else [], size - at


def lines_between(file, first: int, end: int, size: int, block: int = _BLOCK) -> Iterator[tuple[int, bytes]]:
    """The lines with text that begin from first to end - 1."""
    at = first
    if first:  # the line that begins before is another's, unless it ended just here
        at = first - 1
        while at < size:
            data = file.read_at(min(block, size - at), at)
            if (k := data.find(b"\n")) >= 0:
                at += k + 1
                break
            at += len(data)
        else:
            return
    begin, held = at, []
    while at < size and begin < end:
        data = file.read_at(min(block, size - at), at)
        at += len(data)
        *whole, rest = data.split(b"\n")
        for line in whole:
            line = b"".join([*held, line])
            held = []
            if begin >= end:
                return
            if line.strip():
                yield begin, line
            begin += len(line) + 1
        held.append(rest)
    if begin < end and (line := b"".join(held)).strip():
        yield begin, line


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.split, self.last = int(options.get("split_bytes", SPLIT_BYTES)), int(options["last"]) if options.get("last") else None

    def partitions(self) -> list[Piece]:
        pieces: list[Piece] = []
        found = _found(self.path, self.pattern)
        # Short splits share a task, so that there are about TASKS of them however short they are.
        total, least = (BLOCK_BYTES * len(found), BLOCK_BYTES) if self.last is not None else (sum(size for _, size in found), self.split)
        most = max(least, min(SPLIT_BYTES, total // TASKS))
        room = 0
        for path, size in found:
            step = size if self.last is not None else self.split
            for first in range(0, size, max(1, step)):
                cost = BLOCK_BYTES if self.last is not None else min(step, size - first)
                if room < cost:
                    pieces.append(Piece([]))
                    room = most
                room -= cost
                pieces[-1].ranges.append((path, first, min(size, first + step), size))
        return pieces or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("seq", pa.int64()), ("line", pa.string()), ("split", pa.int64())])
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for path, ranges in groupby(partition.ranges, key=lambda r: r[0]):
            file = _open(path)
            for _, first, end, size in ranges:
                for seq, line in last_lines(file, size, self.last)[0] if self.last is not None else lines_between(file, first, end, size, min(_BLOCK, max(1024, end - first))):
                    rows.append((path, seq, line.decode("utf-8", "replace"), first))
                    held += len(line)
                    if len(rows) >= _ROWS or held >= _BYTES:
                        yield batch()
                        rows, held = [], 0
            file.close()
        if rows:
            yield batch()


class LogLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str, pattern: str = "*", last: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, seq (the line's first byte), line and split (the split's first byte) of the files below path; of each the last lines alone, if a number is given."""
    spark.dataSource.register(LogLines)
    options = {"path": path, "pattern": pattern, "split_bytes": str(split_bytes)} | ({"last": str(last)} if last is not None else {})
    return spark.read.format("log_lines").options(**options).load()


def write(rows: DataFrame, path: str, order: str) -> None:
    """A file per name of rows (name, line, and the column of the lines' order) below path: its lines, each with a line feed. Tasks write the files of their own names; a file is there whole or not
    at all, and a repeated task writes it again. There may be millions: they go through pyarrow.fs, and are spread over FOLDERS folders."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        made: set[int] = set()
        place = out = now = None

        def close() -> None:
            out.close()
            store.move(f"{root}/{place[0]}/_{place[1]}", f"{root}/{place[0]}/{now}")

        for batch in batches:
            names, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for (name, folder), some in groupby(zip(names, batch.column(2).to_pylist(), lines, strict=True), key=lambda r: r[:2]):
                if name != now:
                    if out is not None:
                        close()
                    if folder not in made:
                        store.create_dir(f"{root}/{folder}", recursive=True)
                        made.add(folder)
                    now, place = name, (folder, uuid.uuid4().hex)
                    out = store.open_output_stream(f"{root}/{folder}/_{place[1]}", compression=None)
                out.write("".join(f"{line}\n" for _, _, line in some).encode())
        if out is not None:
            close()
        yield from ()

    folder = F.pmod(F.xxhash64("name"), F.lit(FOLDERS)).cast("int").alias("folder")
    ordered = rows.select("name", "line", folder, order).repartition("name").sortWithinPartitions("name", order)
    ordered.select("name", "line", "folder").mapInArrow(save, "name string").write.format("noop").mode("overwrite").save()


def fold_splits(lines: DataFrame, is_prompt: Column) -> DataFrame:
    """WIN-08 over lines in splits: each line's exchange (0 before the first prompt), without a window over a whole file: a split's prompts are counted, what comes before a split is
    a sum over the splits' counts, and lines are numbered inside their split."""
    marked = lines.withColumn("__p", F.when(is_prompt, 1).otherwise(0).cast("long"))
    counts = marked.groupBy("path", "split").agg(F.sum("__p").alias("__n"))
    before = counts.select("path", "split", F.coalesce(F.sum("__n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = marked.withColumn("__in", F.sum("__p").over(Window.partitionBy("path", "split").orderBy("seq")))
    return inside.join(before, ["path", "split"]).withColumn("exchange", F.col("__before") + F.col("__in")).drop("__p", "__in", "__before")
