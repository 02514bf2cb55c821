"""Line dedup: runs of lines that an earlier place already has are deleted.

The corpus is a sequence of lines per document; lines without a word are no part of it. Suffix ranks come from
distributed prefix doubling: at level 0 a place's rank is that of its line among the lines found twice or
more; at level k + 1 it is the rank of the pair (rank at level k, rank 2^k lines on) among the pairs found
twice or more. Ranks follow the order of the lines' ids, so at each level they sort the suffixes by their
first 2^k lines, and the places of one rank are an interval of the suffix array whose longest common prefix
is 2^k lines at least. A place whose rank would be unique starts no repeated run and leaves.

A run counts as repeated from `min_words` words on. From each line on, and up to each line, the shortest
stretch with that many words is named by two overlapping ranks (length, rank at its start, rank 2^k lines
before its end): its interval. Where an interval holds an earlier place, by (doc_id, line), the stretch is a
later copy; together these stretches are exactly the lines of maximal repeated runs of min_words words that
an earlier place has. A stretch has min_words lines at most, so the levels are bounded: log2(min_words) + 1.

Every step is a shuffle of numbers; texts move once, to meet the stretches to delete. No rank's places are
gathered: counts and smallest places are pre-aggregated, large joins are left to adaptive skew splitting.

Lines are compared whole, by a 128-bit hash. Null or empty text: no lines, nothing deleted, text kept as it is. A null doc_id
comes after all others, together with the largest possible id. A very long text is taken whole. Rows equal in doc_id and text are one document, so neither is a later copy of the other,
and both get the same result. Blank lines stay unless the lines on both sides of them, in one stretch, go.
Other columns pass through; columns that start with __tm_ are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.common import discard, materialize, plain, read

MIN_WORDS = 50
_LAST = 2**63 - 1


def _stretches(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest stretch of min_words words from each line on, and up to each line; 0 where there is none."""
    total = np.concatenate(([0], np.cumsum(words)))
    place = np.arange(len(words))
    end = np.searchsorted(total, total[:-1] + min_words, side="left")
    begin = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    return np.where(end <= len(words), end - place, 0), np.where(begin >= 0, place + 1 - begin, 0)


def _numbered(text: bytes) -> list[tuple[int, bytes, int]]:
    """(line number, line, words) of the lines with a word."""
    lines = ((k, line, len(line.split())) for k, line in enumerate(text.split(b"\n")))
    return [x for x in lines if x[2]]


def _lines(min_words: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, prints, rows = batch.column(0), batch.column(1), [[] for _ in range(7)]

            def flush() -> pa.RecordBatch:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                arrays = [pa.array(np.concatenate(r) if r else np.zeros(0, np.int64), k) for r, k in zip(rows, kinds, strict=True)]
                for r in rows:
                    r.clear()
                return pa.RecordBatch.from_arrays(arrays, ["doc", "tie", "p", "h1", "h2", "ahead", "back"])

            held = 0
            for k in range(batch.num_rows):
                text = batch.column(2)[k]
                found = _numbered(text.as_buffer().to_pybytes()) if text.is_valid else []
                if not found:
                    continue
                n = len(found)
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(line) for _, line, _ in found), dtype=">i8").reshape(n, 2)
                ahead, back = _stretches(np.array([w for _, _, w in found]), min_words)
                doc = docs[k].as_py()
                for r, x in zip(rows, (np.full(n, _LAST if doc is None else doc), np.full(n, prints[k].as_py()), np.arange(n), h[:, 0], h[:, 1], ahead, back), strict=True):
                    r.append(x)
                held += n
                if held > 200_000:
                    yield flush()
                    held = 0
            yield flush()

    return lines


def _ranked(keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The keys found twice or more, with ranks in the keys' order."""
    counted = keys.groupBy(*columns).count().where("count > 1").select(*columns)
    return materialize(counted.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("rank", F.monotonically_increasing_id()), name)


def _named(stretches: DataFrame, level: DataFrame, k: int) -> DataFrame:
    """The stretches of 2^k to 2^(k+1) - 1 lines whose lines are all repeated, with the ranks that name them."""
    mine = stretches.where(f"n >= {1 << k} AND n < {1 << k + 1}")
    first = level.select("doc", "tie", F.col("p"), F.col("rank").alias("a"))
    second = level.select("doc", "tie", F.col("p").alias("q"), F.col("rank").alias("b"))
    found = mine.join(first, ["doc", "tie", "p"]).withColumn("q", F.expr(f"p + n - {1 << k}"))
    return found.join(second, ["doc", "tie", "q"]).select("doc", "tie", "p", "n", "a", "b")


def later_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, tie, p, n): stretches of n lines with a word, from the p-th on, that an earlier place has. doc: the id, tie: the hash of the text."""
    docs = docs.select(F.col(plain(id_column)).cast("long").alias("id"), F.xxhash64(F.col(plain(text))).alias("tie"), F.col(plain(text)).alias("text"))
    rows = docs.mapInArrow(_lines(min_words), "doc bigint, tie bigint, p int, h1 bigint, h2 bigint, ahead int, back int")
    lines = materialize(rows, "lines")
    ranks = _ranked(lines, ["h1", "h2"], "line-ranks")
    level = materialize(lines.join(ranks, ["h1", "h2"]).groupBy("doc", "tie", "p").agg(F.first("rank").alias("rank"), F.first("ahead").alias("ahead"), F.first("back").alias("back")), "level-0")
    discard(lines, ranks)
    from_here = level.where("ahead > 0").select("doc", "tie", "p", F.col("ahead").alias("n"))
    up_to_here = level.where("back > 0").select("doc", "tie", F.expr("p + 1 - back").alias("p"), F.col("back").alias("n"))
    stretches = materialize(from_here.union(up_to_here).distinct(), "stretches")
    named, done, k = [], [stretches, level], 0
    level = level.select("doc", "tie", "p", "rank")
    while True:
        named.append(_named(stretches, level, k))
        if 1 << k + 1 > min_words:
            break
        later = level.select("doc", "tie", F.expr(f"p - {1 << k}").alias("p"), F.col("rank").alias("next"))
        pairs = materialize(level.join(later, ["doc", "tie", "p"]), f"pairs-{k}")
        ranks = _ranked(pairs.select("rank", "next").withColumnRenamed("rank", "r"), ["r", "next"], f"ranks-{k + 1}")
        level = materialize(pairs.withColumnRenamed("rank", "r").join(ranks, ["r", "next"]).select("doc", "tie", "p", "rank"), f"level-{k + 1}")
        done.append(level)
        discard(pairs, ranks)
        if level.isEmpty():
            break
        k += 1
    found = named[0]
    for more in named[1:]:
        found = found.union(more)
    found = materialize(found, "named")
    discard(*done)
    place = F.struct("doc", "tie", "p")
    first = found.groupBy("n", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    first = materialize(first, "first-copies")  # a join of two stored tables can be split where an interval is large
    return found.join(first, ["n", "a", "b"]).where(place != F.col("first")).select("doc", "tie", "p", "n")


def _without(texts: pa.Array, places: pa.Array) -> pa.Array:
    out, kept, lines = [], [], []
    for text, gone in zip(texts, places, strict=True):
        value = text.as_py()
        gone = gone.as_py()
        found = _numbered(value.encode()) if value else []
        lines.append(len(found))
        kept.append(len(found))
        if not gone or not found:
            out.append(value)
            continue
        drop = np.zeros(len(found) + 1, dtype=np.int64)
        for x in gone:
            drop[x["p"]] += 1
            drop[x["p"] + x["n"]] -= 1
        drop = np.cumsum(drop[:-1]) > 0
        numbers = {found[k][0] for k in np.flatnonzero(drop)}
        # A blank line between two lines of one deleted stretch goes with them.
        for x in gone:
            numbers.update(range(found[x["p"]][0], found[x["p"] + x["n"] - 1][0] + 1))
        out.append("\n".join(line for k, line in enumerate(value.split("\n")) if k not in numbers))
        kept[-1] -= int(drop.sum())
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(kept, pa.int64())], ["text", "lines", "kept"])


def without_later_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies of repeated runs deleted from the text, and the columns __tm_lines and __tm_kept: lines with a word before and after."""
    gone = later_copies(docs, id_column, text, min_words).groupBy("doc", "tie").agg(F.collect_list(F.struct("p", "n")).alias("__tm_gone"))
    gone = gone.select(F.col("doc").alias("__tm_doc"), F.col("tie").alias("__tm_tie"), "__tm_gone")
    keyed = docs.withColumns({"__tm_id": F.coalesce(F.col(plain(id_column)).cast("long"), F.lit(_LAST)), "__tm_hash": F.xxhash64(F.col(plain(text)))})
    joined = keyed.join(gone, (keyed["__tm_id"] == gone["__tm_doc"]) & (keyed["__tm_hash"] == gone["__tm_tie"]), "left")

    @F.arrow_udf("struct<text:string,lines:bigint,kept:bigint>")
    def without(texts: pa.Array, places: pa.Array) -> pa.Array:
        return _without(texts, places)

    done = joined.withColumn("__tm_done", without(F.col(plain(text)), F.col("__tm_gone")))
    columns = [F.col("__tm_done")["text"].alias(text) if c == text else F.col(plain(c)) for c in docs.columns]
    return done.select(*columns, F.col("__tm_done")["lines"].alias("__tm_lines"), F.col("__tm_done")["kept"].alias("__tm_kept"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = without_later_copies(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        F.col("__tm_lines").alias("n_lines"),
        (F.col("__tm_lines") - F.col("__tm_kept")).alias("n_removed"),
        F.length("text").cast("long").alias("n_chars_kept"),
        F.sha2("text", 256).alias("text_sha256"),
    )


QUERIES = {"op1_line_dedup": op1_line_dedup}

#: Stretches as texts instead of ranks. No line of the tables is blank inside a text, so deleted line numbers are those of stretches.
ORACLE_SQL = {
    "op1_line_dedup": rf"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM split),
lines AS (SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM numbered WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM lines),
lists AS (SELECT doc_id, list(line ORDER BY p) AS l, list(upto ORDER BY p) AS u, list(w ORDER BY p) AS ws FROM summed GROUP BY doc_id),
ends AS (SELECT s.doc_id, s.p,
  s.p + len(list_filter(u[s.p + 1:], lambda x: x - s.upto + s.w < {MIN_WORDS})) AS ahead_end,
  s.p - len(list_filter(u[1:s.p], lambda x: x > s.upto - {MIN_WORDS})) AS back_start, s.upto AS upto, len(l) AS n_lines
  FROM summed s JOIN lists USING (doc_id)),
stretches AS (
  SELECT doc_id, p AS b, ahead_end AS e FROM ends WHERE ahead_end < n_lines
  UNION SELECT doc_id, back_start AS b, p AS e FROM ends WHERE upto >= {MIN_WORDS}),
named AS (SELECT s.doc_id, b, e, array_to_string(l[b + 1:e + 1], chr(10)) AS name FROM stretches s JOIN lists USING (doc_id)),
later AS (SELECT doc_id, b, e FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, b) AS k FROM named) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(b, e + 1)) AS p FROM later),
gone_at AS (SELECT doc_id, n.pos FROM later JOIN lines x USING (doc_id) JOIN lines y USING (doc_id) JOIN numbered n USING (doc_id) WHERE x.p = b AND y.p = e AND n.pos BETWEEN x.pos AND y.pos),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM numbered n WHERE NOT EXISTS (SELECT 1 FROM gone_at g WHERE g.doc_id = n.doc_id AND g.pos = n.pos) GROUP BY doc_id),
many AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(m.n, 0) AS n_lines, coalesce(r.n, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE CAST(length(coalesce(k.text, '')) AS BIGINT) END AS n_chars_kept,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.text, '')) END AS text_sha256
FROM documents d LEFT JOIN many m USING (doc_id) LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
}
