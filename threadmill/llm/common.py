"""What the operators of this subpackage share: tables in the shared folder, and texts as flat byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.plans.tables import discard, new_path, release, shared_dir  # noqa: F401
from threadmill.plans.tables import settled as materialize  # noqa: F401

#: Bytes of text that numpy works on at once.
CHUNK_BYTES = 2 << 20

#: The ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: Rows that go to a Python worker at once. Texts are long, and what a worker holds counts against the executor's memory.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table. Where the session has Spark's default for the rows of an Arrow batch, it gets BATCH_ROWS."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plain(name: str) -> str:
    """A column name as an identifier, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


#: Bits of a filter: 8 MB, whatever the number of its keys.
FILTER_BITS = 26


def key_filter(keys: DataFrame, hashed: Column) -> DataFrame:
    """A filter of the keys, by their hashes (long): a row (bucket, bits) per 2^15 bits, of which each key sets one. FILTER_BITS bound its size; it is meant to be broadcast."""
    place = F.pmod(hashed, F.lit(1 << FILTER_BITS))
    placed = keys.select(F.shiftright(place, 15).alias("bucket"), place.bitwiseAND(F.lit(0x7FFF)).alias("place"))
    return placed.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def with_maybe(table: DataFrame, hashed: Column, bits: DataFrame, out: str = "__tm_maybe") -> DataFrame:
    """table and a boolean: false where the hash is certainly that of none of the (stored) filter's keys. With more keys there are more true rows, up to all."""
    kept = [F.col(plain(c)) for c in table.columns]
    place = F.pmod(hashed, F.lit(1 << FILTER_BITS))
    bits = F.broadcast(bits.select(F.col("bucket").alias("__tm_bucket"), F.col("bits").alias("__tm_bits")))
    joined = table.withColumn("__tm_place", place).join(bits, F.shiftright("__tm_place", 15) == F.col("__tm_bucket"), "left")
    in_bucket = F.col("__tm_place").bitwiseAND(F.lit(0x7FFF)).cast("int")
    byte = F.conv(F.hex(F.substring("__tm_bits", F.shiftright(in_bucket, 3) + 1, 1)), 16, 10).cast("int")
    bit = F.expr("shiftright(__tm_byte, CAST(__tm_place & 7 AS INT)) & 1 = 1")
    return joined.withColumn("__tm_byte", byte).select(*kept, F.coalesce(bit, F.lit(False)).alias(out))


def filter_bytes(bits: DataFrame) -> np.ndarray:
    """The filter as one array of 2^(FILTER_BITS - 3) bytes, for tasks in Python."""
    out = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for bucket, part in bits.collect():
        out[bucket << 12 : (bucket + 1) << 12] = np.frombuffer(part, dtype=np.uint8)
    return out


def in_filter(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """False where an (unsigned) hash is certainly that of no key."""
    place = (hashed & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def without(table: DataFrame, gone: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows of table whose keys are not those of a row of gone (its columns, in the same order). Only rows that a filter of gone can't clear are shuffled."""
    of = gone.select(*(F.col(plain(c)).alias(f"__tm_gone{k}") for k, c in enumerate(gone.columns))).distinct()
    of = materialize(of, "gone")
    bits = materialize(key_filter(of, F.xxhash64(*of.columns)), "gone-filter")
    columns = [F.col(plain(c)) for c in table.columns]
    marked = with_maybe(table, F.xxhash64(*keys), bits)
    same = F.lit(True)
    for k, key in enumerate(keys):
        same &= key.eqNullSafe(F.col(f"__tm_gone{k}"))
    clear = marked.where("NOT __tm_maybe").select(*columns)
    return clear.union(marked.where("__tm_maybe").join(of, same, "left_anti").select(*columns))


def byte_chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) for runs of rows of about `most` bytes; a null counts as empty, a longer text stands alone."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        end = min(end, len(texts))
        yield start, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def word_bounds(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the runs of word bytes, none across rows, and the number of words before each row's end."""
    edge = np.zeros(len(is_word) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(is_word) + 1, dtype=bool)
    before[0], before[1:] = False, is_word
    here = np.append(is_word, False)
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(starts, offsets[1:], side="left")


def spans_per_row(counts_before: np.ndarray) -> np.ndarray:
    """Number of items of each row, from the running totals at the rows' ends."""
    return np.diff(counts_before, prepend=0)


def row_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values over rows that end at `ends`."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return np.diff(total[ends], prepend=0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly (SplitMix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def in_repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key is found twice or more."""
    return pd.Series(keys).duplicated(keep=False).to_numpy()


def after_first(keys: np.ndarray) -> np.ndarray:
    """True where a key was found before."""
    return pd.Series(keys).duplicated().to_numpy()


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """True for the positions below n that lie in a window of `length` from one of the starts."""
    steps = np.bincount(starts, minlength=n + 1).astype(np.int32)
    steps -= np.bincount(np.minimum(starts + length, n), minlength=n + 1).astype(np.int32)
    return np.cumsum(steps[:n]) > 0
