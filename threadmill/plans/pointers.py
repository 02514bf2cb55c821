"""Small files by Hadoop's file systems: what names a version of something larger is written whole, last, and never over another."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """The name is taken: someone else was faster."""


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none where there is no folder."""
    store, place = _at(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    store, place = _at(spark, path)
    stream = store.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A file that is there whole or not at all. Taken if it is there already."""
    store, place = _at(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = store.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri() if place.toUri().getScheme() else store.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(store.makeQualified(place), store.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")), none)
    except Py4JJavaError as e:
        store.delete(place, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise Taken(f"{folder}/{name}") from None
        raise
