"""Cutting lineage: intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_lock = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new local folder in local mode, and an error on a cluster, whose executors wouldn't see that."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="threadmill-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        path = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; release() deletes what is written there."""
    path = f"{shared_dir(spark)}/threadmill/{name}-{uuid.uuid4().hex}"
    with _lock:
        if not _written:
            atexit.register(release, spark)
        _written.append(path)
    return path


def settled(table: DataFrame, name: str = "table") -> DataFrame:
    """The table, written now to the shared folder and read again: later steps don't repeat its work, and survive the loss of executors."""
    spark = table.sparkSession
    path = new_path(spark, name)
    table.write.parquet(path)
    out = spark.read.schema(table.schema).parquet(path)
    out._settled_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, wherever Hadoop's file systems reach."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more: what is left to do reads tables made from them."""
    for table in tables:
        with _lock:
            known = table._settled_at in _written
            if known:
                _written.remove(table._settled_at)
        if known:  # else it was released already
            delete(table.sparkSession, table._settled_at)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside goes at the end: for a driver that lives long, around each query and the use of its result. Not for queries that run side by side in threads."""
    with _lock:
        before = set(_written)
    try:
        yield
    finally:
        with _lock:
            made = [p for p in _written if p not in before]
            _written[:] = [p for p in _written if p in before]
        for path in made:
            delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete what this driver has written; called at its end, too."""
    with _lock:
        paths = _written[:]
        _written.clear()
    with contextlib.suppress(Exception):  # the session may have ended
        for path in paths:
            delete(spark, path)
