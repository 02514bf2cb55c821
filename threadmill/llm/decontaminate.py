"""Benchmark decontamination by winnowing: passages of test items inside documents.

Words are lower-cased runs of letters, digits and non-ASCII characters. Of every `window - gram + 1`
neighbouring grams of `gram` words the smallest hash is kept, so every span of `window` words that a document shares with
an item shares a kept hash too. Kept hashes of documents are joined with those of the items; each hit is extended to the
windows of `window` words that keep it, which are joined with the items' windows by 128 bits over the hashes of their words. An item of
fewer words is one window and is looked up by its own length, for which winnowing has no guarantee.

Scale: documents are read once, and no text moves. Hashes that no item has leave before the join, by a filter of the items' hashes whose
size is fixed (FILTER_BITS), so what is shuffled follows the hits. Items are shuffled, never gathered: neither their number nor their size
is bounded. The items of a window are named by a digest of their set, so a passage that many items and many documents share costs a row per
document and set, not a row per document, item and window. The right side of each join has a row per key and is stored, so adaptive execution can split a hot
passage's documents. A document's windows meet in one task; these are bounded by its text.

Null or empty text: no words, never hit; such items have no window. Items with equal texts all count; equal rows are one item. An item with a
null item_id makes hits, but has no name to list and doesn't count in n_items. Rows are judged alone, so repeated rows get equal results.
A very long text is taken whole; arrays of its words' hashes are what a task holds. Other columns pass through; a column named like the result is replaced,
and columns that start with __tm_ are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.common import byte_chunks, filter_bytes, in_filter, key_filter, materialize, mix64, plain, read, without

WINDOW = 10
GRAM = 5

_TO_WORDS = bytes(ord(" ") if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) else b + 32 if 65 <= b < 91 else b for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
#: Words whose hash a worker remembers.
TABLE_WORDS = 1 << 17
_SPANS = "array<struct<start:bigint,end:bigint>>"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > TABLE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _rows(data: bytes, offsets: np.ndarray, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each text has."""
    words: list[bytes] = []
    counts = np.zeros(len(offsets) - 1, dtype=np.int64)
    data = data.translate(_TO_WORDS)
    for k in range(len(counts)):
        found = data[offsets[k] : offsets[k + 1]].split()
        counts[k] = len(found)
        words += found
    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words)), counts


def _grams(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` words from each place on (places too near the end have none)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = words[:n].copy()
    for k in range(1, length):
        h = h * _MULTIPLIER + words[k : n + k]
    return mix64(h)


def _left(counts: np.ndarray) -> np.ndarray:
    """Words from each place to its text's end."""
    ends = np.cumsum(counts)
    return np.repeat(ends, counts) - np.arange(int(counts.sum()))


def _least(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The smallest hash of the grams in the window from each place on: the hash that winnowing keeps for it."""
    h, width = _grams(words, gram), window - gram + 1
    n = max(0, len(h) - width + 1)
    least = h[:n].copy()
    for k in range(1, width):
        np.minimum(least, h[k : n + k], out=least)
    return least


def _wide(words: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the windows of `length` words from `starts`."""
    a = words[starts]
    b = mix64(a + _SECOND)
    for k in range(1, length):
        w = words[starts + k]
        a, b = a * _MULTIPLIER + w, b * _SECOND + w
    return mix64(a + np.uint64(length)), mix64(b + np.uint64(length))


_WINDOW = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("g", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_FOUND = "struct<n_words:bigint,windows:array<struct<start:int,n:int,g:bigint,a:bigint,b:bigint>>>"


def _packed(counts: list[np.ndarray], windows: list[list[np.ndarray]]) -> pa.StructArray:
    """Per text its number of words and its windows. windows: text, start, n, g, a, b, in the texts' order, per chunk."""
    per_text = [np.bincount(w[0], minlength=len(c)) for c, w in zip(counts, windows, strict=True)]
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(per_text)))) if counts else np.zeros(1, np.int64)
    columns = [np.concatenate(x) for x in zip(*windows, strict=True)][1:] if windows else [np.zeros(0, np.int64)] * 5
    fields = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, f.type) for x, f in zip(columns, _WINDOW, strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_WINDOW)))
    return pa.StructArray.from_arrays([pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64()), lists], ["n_words", "windows"])


def _searched(texts: pa.Array, hashes: _Hashes, window: int, gram: int, bits: np.ndarray | None, lengths: list[int]) -> pa.StructArray:
    """The windows of texts that pass the filter; of items (bits: None) all, a shorter item being one."""
    all_counts, all_windows = [], []
    for _, data, offsets in byte_chunks(texts):
        words, counts = _rows(data.tobytes(), offsets, hashes)
        left = _left(counts)
        least = _least(words, window, gram)
        starts = np.flatnonzero(left[: len(least)] >= window)
        if bits is not None:
            starts = starts[in_filter(bits, least[starts])]
        parts = [(starts, window, least[starts])]
        if bits is None:
            first, short = np.cumsum(counts) - counts, (counts > 0) & (counts < window)
            lengths = np.unique(counts[short]).tolist()
        for length in lengths:
            at = np.flatnonzero(left >= length) if bits is not None else first[short & (counts == length)]
            parts.append((at, length, np.zeros(len(at), dtype=np.uint64)))
        found = []
        for at, length, g in parts:
            a, b = _wide(words, at, length)
            if bits is not None:
                ok = in_filter(bits, a)
                at, g, a, b = at[ok], g[ok], a[ok], b[ok]
            found.append((at, np.full(len(at), length), g, a, b))
        at, n, g, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        at = at[order]
        ends = np.cumsum(counts)
        row = np.searchsorted(ends, at, side="right")
        all_counts.append(counts)
        all_windows.append([row, at - (ends - counts)[row], n[order], g[order], a[order], b[order]])
    return _packed(all_counts, all_windows)


class Benchmark:
    """The items' side of the joins, as stored tables: grams (g), windows (n, a, b, s1, s2) and sets (s1, s2, item_id); and the filter of its hashes."""

    def __init__(self, items: DataFrame, window: int = WINDOW, gram: int = GRAM):
        """items: item_id, text."""
        self.window, self.gram = window, gram

        @F.arrow_udf(_FOUND)
        def windows_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            hashes = _Hashes()
            for texts in batches:
                yield _searched(texts, hashes, window, gram, None, [])

        items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
        rows = items.select("item_id", F.explode(windows_of("text")["windows"]).alias("w")).select("item_id", "w.n", "w.g", "w.a", "w.b")
        rows = materialize(rows.distinct(), "item-windows")
        self.grams = materialize(rows.where(F.col("n") == window).select("g").distinct(), "item-grams")
        # A set of items has 128 bits that don't depend on their order.
        self.windows = materialize(rows.groupBy("n", "a", "b").agg(F.bit_xor(F.xxhash64("item_id", F.lit(1))).alias("s1"), F.bit_xor(F.xxhash64("item_id", F.lit(2))).alias("s2")), "windows")
        self.sets = materialize(rows.where("item_id IS NOT NULL").join(self.windows, ["n", "a", "b"]).select("s1", "s2", "item_id").distinct(), "item-sets")
        self.lengths = sorted(r["n"] for r in self.windows.where(F.col("n") < window).select("n").distinct().collect())  # below the window's
        self.bits = filter_bytes(materialize(key_filter(self.grams.union(self.windows.select("a")), F.col("g")), "item-filter"))


def candidates(docs: DataFrame, benchmark: Benchmark, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tie, n_words, windows) of each row, stored: the windows that an item may have. tie: the text's hash."""
    shared, lengths, window, gram = docs.sparkSession.sparkContext.broadcast(benchmark.bits), benchmark.lengths, benchmark.window, benchmark.gram

    @F.arrow_udf(_FOUND)
    def searched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = _Hashes()
        for texts in batches:
            yield _searched(texts, hashes, window, gram, shared.value, lengths)

    column = F.col(plain(text))
    out = materialize(docs.select(F.col(plain(id_column)).alias("id"), F.xxhash64(column).alias("tie"), searched(column).alias("s")).select("id", "tie", "s.n_words", "s.windows"), "candidates")
    shared.unpersist()
    return out


def hits(rows: DataFrame, benchmark: Benchmark) -> DataFrame:
    """(id, tie, start, n, s1, s2) of the windows that an item has, stored. rows: of candidates()."""
    found = rows.where(F.size("windows") > 0).select("id", "tie", F.explode("windows").alias("w")).select("id", "tie", "w.*")
    kept = found.where(F.col("n") == benchmark.window).join(benchmark.grams, "g").select("id", "tie", "start", "n", "a", "b")
    short = found.where(F.col("n") < benchmark.window).select("id", "tie", "start", "n", "a", "b")
    return materialize(kept.union(short).join(benchmark.windows, ["n", "a", "b"]).select("id", "tie", "start", "n", "s1", "s2").distinct(), "hits")


def _merge(windows: list[dict]) -> list[dict]:
    out: list[dict] = []
    for start, end in sorted((w["start"], w["start"] + w["n"]) for w in windows):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def judged(found: DataFrame, benchmark: Benchmark) -> DataFrame:
    """(__tm_id, __tm_tie, n_hit, spans, items) of the texts with a hit: spans in words, items' ids ascending. found: of hits()."""

    @F.arrow_udf(_SPANS)
    def merged(lists: pa.Array) -> pa.Array:
        return pa.array([_merge(x.as_py()) for x in lists], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

    spans = found.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "n")).alias("w")).select("id", "tie", merged("w").alias("spans"))
    named = found.select("id", "tie", "s1", "s2").distinct().join(benchmark.sets, ["s1", "s2"]).groupBy("id", "tie").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    named = named.select(F.col("id").alias("id2"), F.col("tie").alias("tie2"), "items")
    both = spans.join(named, spans["id"].eqNullSafe(named["id2"]) & (spans["tie"] == named["tie2"]), "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return both.select(F.col("id").alias("__tm_id"), F.col("tie").alias("__tm_tie"), n_hit.alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "hits", id_column: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs and a struct of n_words, n_hit, the word spans hit, and the ids of the items whose windows occur. benchmark: item_id, text."""
    items = Benchmark(benchmark, window, gram)
    rows = candidates(docs, items, id_column, text)
    done = materialize(_of_rows(rows.select("id", "tie", "n_words").distinct(), hits(rows, items), items), "judged")
    result = F.struct("__tm_words", "__tm_hit", "__tm_spans", "__tm_items").cast(f"struct<n_words:bigint,n_hit:bigint,spans:{_SPANS},items:array<bigint>>")
    done = done.select(F.col("id").alias("__tm_id"), F.col("tie").alias("__tm_tie"), *(F.col(c).alias(f"__tm_{n}") for c, n in (("n_words", "words"), ("n_hit", "hit"), ("spans", "spans"), ("items", "items"))))
    keyed = docs.withColumn("__tm_key", F.col(plain(id_column))).withColumn("__tm_hash", F.xxhash64(F.col(plain(text))))
    joined = keyed.join(done, F.col("__tm_key").eqNullSafe(F.col("__tm_id")) & (F.col("__tm_hash") == F.col("__tm_tie")))
    return joined.select(*(F.col(plain(c)) for c in docs.columns if c != out), result.alias(out))


def _of_rows(rows: DataFrame, found: DataFrame, items: Benchmark) -> DataFrame:
    """(id, tie, n_words, n_hit, spans, items) of each row."""
    done = rows.select("id", "tie", "n_words").join(judged(found, items), F.col("id").eqNullSafe(F.col("__tm_id")) & (F.col("tie") == F.col("__tm_tie")), "left")
    return done.select("id", "tie", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of docs without a benchmark window, with docs' columns. Only rows that a filter of the contaminated ones can't clear are shuffled."""
    items = Benchmark(benchmark)
    found = hits(candidates(docs, items, id_column, text), items).select("id", "tie")
    return without(docs, found, [F.col(plain(id_column)), F.xxhash64(F.col(plain(text)))])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = Benchmark(read(spark, sf_dir, "benchmark"))
    rows = candidates(read(spark, sf_dir, "documents"), items)
    done = _of_rows(rows, hits(rows, items), items)
    names = F.array_sort(F.col("items").cast("array<string>"))
    return done.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op9_decontamination": op9_decontamination}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op9_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, {WINDOW} AS n, array_to_string(w[p + 1:p + {WINDOW}], ' ') AS name FROM (SELECT item_id, w, unnest(range(len(w) - {WINDOW - 1})) AS p FROM i WHERE len(w) >= {WINDOW})
  UNION ALL SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS name FROM i WHERE len(w) > 0 AND len(w) < {WINDOW}),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (SELECT doc_id, n, p, array_to_string(w[p + 1:p + n], ' ') AS name FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, p, n, item_id FROM doc_windows JOIN item_windows USING (n, name)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""
}
