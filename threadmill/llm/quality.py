"""Repetition coverage: how much of a text lies in n-grams and lines that the text has had before.

Words are runs of anything but ASCII white space. For each of several lengths n, a rolling hash names
every window of n words; the characters (code points) of the words inside windows that repeat an earlier
window, over those of all words, is the coverage at n. Lines that equal an earlier one are measured
likewise. A text is rejected when one of these shares passes its limit. All of it is numpy over a few
megabytes of text at a time, so memory is bounded by the batch and one text; no shuffle, no state between
rows, and no limit on a text's length.

Null or empty text: no words, all counts 0, base_failed true, kept false. Rows are judged alone, so
repeated rows get equal results and an empty table gives an empty one. Other columns pass through; a
column named like the result is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.common import IS_SPACE, after_first, byte_chunks, covered, in_repeated, mix64, plain, read, row_sums, spans_per_row, word_bounds

#: Largest percentage of characters in repeated n-grams, by n, and in repeated lines: the limits published with the Gopher model.
NGRAM_PERCENT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_PERCENT = 20

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]


def names(limits: dict[int, int]) -> list[str]:
    return [*COUNTS, *(f"dup_chars_{n}" for n in sorted(limits))]


def _repeated_lines(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier line, and the code points of their words."""
    out = np.zeros((2, len(offsets) - 1), dtype=np.int64)
    for k in range(len(offsets) - 1):
        lines = data[offsets[k] : offsets[k + 1]].split(b"\n")
        if len(set(lines)) == len(lines):
            continue
        seen: set[bytes] = set()
        for line in lines:
            if line in seen and (words := line.split()):
                out[0, k] += 1
                out[1, k] += len(b"".join(words).decode("utf-8", "replace"))
            seen.add(line)
    return out[0], out[1]


def _chunk(data: np.ndarray, offsets: np.ndarray, limits: dict[int, int]) -> dict[str, np.ndarray]:
    raw, rows = data.tobytes(), len(offsets) - 1
    is_word = ~IS_SPACE[data]
    starts, ends, before = word_bounds(is_word, offsets)
    n, n_words = len(starts), spans_per_row(before)
    row = np.repeat(np.arange(rows), n_words)
    points = np.concatenate(([0], np.cumsum(is_word & ((data & 0xC0) != 0x80))))
    chars = points[ends] - points[starts]

    words: list[bytes] = []
    for k in range(rows):
        words += raw[offsets[k] : offsets[k + 1]].split()
    ids: dict[bytes, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    left = before[row] - np.arange(n) if n else row  # words from here to the end of the row

    # Windows of three words by exact numbers: of pairs, then of a pair and a word, then of these in a row.
    repeats = np.zeros(n, dtype=bool)
    if n >= 3:
        pair = pd.factorize(word[:-1] * len(ids) + word[1:])[0]
        triple = pd.factorize(pair[:-1] * len(ids) + word[2:])[0]
        at = np.flatnonzero(left >= 3)
        repeats = covered(at[in_repeated(row[at] * (n + 1) + triple[at])], 3, n)

    # Rolling hashes: each length extends the one before by a word. The row's number is mixed in, so rows stay apart.
    hashed, apart = mix64(word.astype(np.uint64) + np.uint64(1)), mix64(row.astype(np.uint64) * _MULTIPLIER)
    rolling, out = hashed.copy(), {}
    for length in range(2, max(limits) + 1):
        rolling = rolling[: max(0, n - length + 1)]
        if len(rolling):
            rolling = rolling[: n - length + 1] * _MULTIPLIER + hashed[length - 1 :]
        if length in limits:
            at = np.flatnonzero(left >= length)
            again = at[after_first((rolling[at] ^ apart[at]).view(np.int64))] if len(at) else at
            out[f"dup_chars_{length}"] = row_sums(chars * covered(again, length, n), before) if len(again) else np.zeros(rows, np.int64)

    dup_lines, dup_line_chars = _repeated_lines(raw, offsets)
    counts = [n_words, row_sums(chars, before), row_sums(_SYMBOL[data], offsets[1:]), dup_lines, row_sums(repeats, before), dup_line_chars]
    return dict(zip(COUNTS, counts, strict=True)) | out


def measure(texts: pa.Array, limits: dict[int, int] | None = None, line_percent: int = LINE_PERCENT) -> pa.StructArray:
    """The counts of each text, base_failed and kept."""
    limits = limits or NGRAM_PERCENT
    parts = [_chunk(data, offsets, limits) for _, data, offsets in byte_chunks(texts)]
    cols = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in names(limits)}
    failed = (cols["n_words"] < 50) | (100 * cols["n_repeat_words"] > 50 * cols["n_words"])
    kept = ~failed & (100 * cols["dup_line_chars"] <= line_percent * cols["word_chars"])
    for n, percent in limits.items():
        kept &= 100 * cols[f"dup_chars_{n}"] <= percent * cols["word_chars"]
    arrays = {k: pa.array(v, pa.int64()) for k, v in cols.items()} | {"base_failed": pa.array(failed), "kept": pa.array(kept)}
    return pa.StructArray.from_arrays(list(arrays.values()), list(arrays))


def with_repetition(df: DataFrame, text: str = "text", out: str = "repetition", limits: dict[int, int] | None = None, line_percent: int = LINE_PERCENT) -> DataFrame:
    """df and a struct column of the counts (long), base_failed and kept (boolean)."""
    schema = ",".join(f"{k}:bigint" for k in names(limits or NGRAM_PERCENT))

    @F.arrow_udf(f"struct<{schema},base_failed:boolean,kept:boolean>")
    def repetition(texts: pa.Array) -> pa.Array:
        return measure(texts, limits, line_percent)

    return df.withColumn(out, repetition(F.col(plain(text))))


def keep_unrepetitive(df: DataFrame, text: str = "text", limits: dict[int, int] | None = None) -> DataFrame:
    """The rows of df that pass the base rules and the coverage limits, with df's columns."""
    columns, out = df.columns, "__tm_repetition"
    return with_repetition(df, text, out, limits).where(F.col(out)["kept"]).select(*(F.col(plain(c)) for c in columns))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_repetition(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "repetition.*")


QUERIES = {"op4_quality_rules": op4_quality_rules}


def _ngram_sql(n: int) -> str:
    gram = " || ' ' || ".join(f"lead(word, {k}) OVER (PARTITION BY doc_id ORDER BY p)" if k else "word" for k in range(n))
    return f"""c{n} AS (SELECT doc_id, CAST(sum(CASE WHEN hit THEN length(word) ELSE 0 END) AS BIGINT) AS dup_chars_{n} FROM (
  SELECT doc_id, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit FROM (
    SELECT doc_id, p, word, gram IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, gram ORDER BY p) > 1 AS again FROM (
      SELECT doc_id, p, word, {gram} AS gram FROM words))) GROUP BY doc_id)"""


ORACLE_SQL = {
    "op4_quality_rules": rf"""
WITH lists AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM lists),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY p) AS k FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM lists) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_dup_lines, CAST(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS BIGINT) AS dup_line_chars FROM lines WHERE k > 1 GROUP BY doc_id),
r3 AS (SELECT doc_id, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS n_repeat_words FROM (
  SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM (
    SELECT doc_id, p, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS again FROM (
      SELECT doc_id, p, word || ' ' || lead(word, 1) OVER (PARTITION BY doc_id ORDER BY p) || ' ' || lead(word, 2) OVER (PARTITION BY doc_id ORDER BY p) AS gram FROM words))) GROUP BY doc_id),
{", ".join(_ngram_sql(n) for n in sorted(NGRAM_PERCENT))},
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM lists),
counts AS (SELECT b.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars,
  {", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in sorted(NGRAM_PERCENT))}
  FROM base b LEFT JOIN dup USING (doc_id) LEFT JOIN r3 USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in sorted(NGRAM_PERCENT))})
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * dup_line_chars <= {LINE_PERCENT} * word_chars
  AND {" AND ".join(f"100 * dup_chars_{n} <= {p} * word_chars" for n, p in NGRAM_PERCENT.items())} AS kept FROM counts"""
}
