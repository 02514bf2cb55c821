"""How far apart the vocabularies of a language's sources are, and which terms set a source apart.

Terms are counted in the tasks that read the texts (numpy over bytes, a table of bounded size), then per (lang, source, term), so a frequent term or a large source is a few rows a
task. Each kept term is then one row with the vector of its counts by source, sparse and sorted. Terms with the same vector have the same probabilities
in every source, so every pair of sources is evaluated once per distinct vector, and its distance multiplied by the vector's multiplicity. Vectors are spread over the tasks; numpy adds up
a matrix of sources for each language, within ROOM entries, and hands sums on. The ranking of terms goes back to the original terms. Vectors are compared whole; all
arithmetic is exact, in decimals of 38 digits where counts are multiplied by 10^9. A vector has at most as many entries as its language has sources, whose square is the size of the result.

Null text, lang or source: empty strings. A group without kept terms has probabilities from the prior alone; a language without kept terms has pairs of distance 0 and no terms.
Rows that repeat count each. Ties are ranked by the item's bytes. Very long texts and terms are taken whole. An empty table gives an empty result. Further columns, whatever
their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.llm.common import byte_chunks, discard, materialize, plain, read, word_bounds

#: Documents of its language that a term must be in.
MIN_DOCS = 30
#: Added to every count.
PRIOR = 5
SCALE = 1_000_000_000
TOP = 50
#: Bytes of text whose terms are counted together.
COUNT_BYTES = 5 << 20
#: Entries of the matrices of sources that a task adds up before it hands them on.
ROOM = 4 << 20

#: The bytes of terms: ASCII letters, and all of characters beyond ASCII.
IS_TERM = np.zeros(256, dtype=bool)
IS_TERM[0x41:0x5B] = IS_TERM[0x61:0x7B] = IS_TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _counted(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the rows."""
    pairs = pa.StructArray.from_arrays([langs.cast(pa.string()), sources.cast(pa.string())], ["lang", "source"])
    codes: dict[tuple, int] = {}
    groups = np.array([codes.setdefault((p["lang"], p["source"]), len(codes)) for p in pairs.to_pylist()], dtype=np.int64)
    names = list(codes)
    for first, data, offsets in byte_chunks(texts, COUNT_BYTES):
        is_term = IS_TERM[data]
        starts, ends, before = word_bounds(is_term, offsets)
        if not len(starts):
            continue
        at = np.concatenate(([0], np.cumsum(ends - starts)))
        flat = _LOWER[data[is_term]]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat)]).dictionary_encode()
        word, n_words = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(before, prepend=0))
        # Once per row and term, then per group and term.
        in_row, times = np.unique(row * n_words + word, return_counts=True)
        key = groups[first + in_row // n_words] * n_words + in_row % n_words
        cells, inverse = np.unique(key, return_inverse=True)
        n, docs = np.zeros(len(cells), np.int64), np.bincount(inverse, minlength=len(cells))
        np.add.at(n, inverse, times)
        group = cells // n_words
        lang, source = (pa.array([names[g][k] for g in range(len(names))], pa.string()).take(pa.array(group)) for k in (0, 1))
        term = words.dictionary.take(pa.array(cells % n_words)).cast(pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([lang, source, term, pa.array(n), pa.array(docs.astype(np.int64))], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group, stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= COUNT_BYTES:
                yield from whole(held)
                held, size = [], 0
        yield from whole(held)

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            columns = [pa.concat_arrays([b.column(k).cast(pa.large_string()) for b in held]) for k in range(3)]
            yield from _counted(*columns)

    empty = F.lit("")
    rows = docs.select(*(F.coalesce(F.col(plain(c)), empty).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = rows.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return materialize(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exactly."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n.cast("decimal(20,0)") + PRIOR)
    return F.lit(1).cast("long") + F.call_function("div", above, total.cast("decimal(20,0)") + PRIOR * terms.cast("decimal(18,0)"))


def vocabulary(counts: DataFrame, docs: DataFrame, lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored, of term_counts(): groups (lang, source, at: the source's number in its language), terms (lang, term, total, vector: of the sources' counts, (at, n) sorted, without zeros) and
    langs (lang, size: occurrences, terms: their number, sizes: occurrences by source)."""
    empty = F.lit("")
    groups = docs.select(F.coalesce(F.col(plain(lang)), empty).alias("lang"), F.coalesce(F.col(plain(source)), empty).alias("source")).distinct()
    groups = materialize(groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "divergence-groups")
    cells = counts.join(groups, ["lang", "source"])
    terms = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("at", "n"))).alias("vector"))
    terms = materialize(terms.where(F.col("docs") >= min_docs).drop("docs"), "divergence-terms")
    sizes = terms.select("lang", F.explode("vector").alias("x")).groupBy("lang", "x.at").agg(F.sum("x.n").alias("size"))
    by_lang = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    langs = groups.join(sizes, ["lang", "at"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("size", F.lit(0)).alias("size")))).alias("x"))
    langs = langs.join(by_lang, "lang", "left").select("lang", F.col("x.size").alias("sizes"), F.coalesce("terms", F.lit(0)).alias("terms"))
    langs = langs.withColumn("size", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))
    return groups, terms, materialize(langs, "divergence-langs")


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (lang, at, p: of the sources that have the vector's terms, zeros: p of the others, times) the sums of times * abs(p - q) by pair of sources (lang, a, b, value), a < b."""
    held: dict[str, np.ndarray] = {}

    def sums(lang: str, first: int, values: np.ndarray) -> pa.RecordBatch:
        """values: a matrix whose rows are the sources from first on."""
        a, b = np.nonzero(np.triu(np.ones(values.shape, dtype=bool), first + 1))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array((a + first).astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(values[a, b])], names=["lang", "a", "b", "value"])

    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            rows = batch.filter(pc.equal(langs.indices, code))
            n = len(rows.column("zeros")[0])
            step = max(1, ROOM // n)
            if n * n <= ROOM and lang not in held:
                if sum(x.size for x in held.values()) + n * n > ROOM:
                    yield from (sums(k, 0, v) for k, v in held.items())
                    held = {}
                held[lang] = np.zeros((n, n), dtype=np.int64)
            for k in range(0, len(rows), step):
                part = rows.slice(k, step)
                at, times = part.column("at"), part.column("times").to_numpy()
                p = np.tile(np.array(part.column("zeros")[0].as_py(), dtype=np.int64), (len(part), 1))
                p[np.repeat(np.arange(len(part)), pc.list_value_length(at).to_numpy()), at.flatten().to_numpy()] = part.column("p").flatten().to_numpy()
                for a in range(n - 1):
                    value = times @ np.abs(p - p[:, a : a + 1])
                    if lang in held:
                        held[lang][a] += value
                    else:
                        yield sums(lang, a, value[None, :])
    yield from (sums(k, 0, v) for k, v in held.items())


def pair_distances(groups: DataFrame, terms: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, a, b, value), a <> b: of every two sources of a language the sum over its kept terms of the distance of their probabilities."""
    distinct = terms.groupBy("lang", "vector").agg(F.count("*").alias("times"))
    rows = materialize(distinct, "divergence-vectors").join(langs, "lang")
    of = lambda n, size: probability(n, size, F.col("terms"))
    rows = rows.select(
        "lang", F.col("vector.at").alias("at"), F.transform("vector", lambda x: of(x["n"], F.get("sizes", x["at"]))).alias("p"),
        F.transform("sizes", lambda size: of(F.lit(0), size)).alias("zeros"), "times",
    )
    found = rows.mapInArrow(_distances, "lang string, a int, b int, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    found = materialize(found, "divergence-sums")
    every = groups.select("lang", F.col("at").alias("a")).join(groups.select("lang", F.col("at").alias("b")), "lang").where("a <> b")
    less, more = F.least("a", "b"), F.greatest("a", "b")
    known = found.select(F.col("lang").alias("of"), F.col("a").alias("less"), F.col("b").alias("more"), "value")
    joined = every.join(known, (F.col("lang") == F.col("of")) & (less == F.col("less")) & (more == F.col("more")), "left")
    return joined.select("lang", "a", "b", F.coalesce("value", F.lit(0)).alias("value"))


def setting_apart(terms: DataFrame, langs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, a, item, value, rank): the terms whose probability in source a is above that in the language by most."""
    cells = terms.join(langs, "lang").withColumn("q", probability(F.col("total"), F.col("size"), F.col("terms"))).select("lang", "term", "sizes", "terms", "q", F.explode("vector").alias("x"))
    more = cells.select("lang", F.col("x.at").alias("a"), F.col("term").alias("item"), (probability(F.col("x.n"), F.get("sizes", F.col("x.at")), F.col("terms")) - F.col("q")).alias("value")).where("value > 0")
    return more.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "a").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): of each group its distance to the other sources (part pair) and the terms that set it apart (part term)."""
    counts = term_counts(docs)
    groups, terms, langs = vocabulary(counts, docs, min_docs=min_docs)
    discard(counts)
    name = lambda at: groups.select("lang", F.col("at").alias(at), F.col("source").alias(f"{at}_source"))
    pairs = pair_distances(groups, terms, langs).join(name("b"), ["lang", "b"]).select("lang", "a", F.lit("pair").alias("part"), F.col("b_source").alias("item"), "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "a").orderBy(F.desc("value"), "item")))
    found = pairs.union(setting_apart(terms, langs, top).select("lang", "a", F.lit("term").alias("part"), "item", "value", "rank"))
    return found.join(name("a"), ["lang", "a"]).select("lang", F.col("a_source").alias("source"), "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


QUERIES = {"op13_source_divergence": op13_source_divergence}

_P = f"1 + ({SCALE}::HUGEINT * (({{n}}) + {PRIOR})) // (({{size}}) + {PRIOR} * v)"
ORACLE_SQL = {
    "op13_source_divergence": f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
e AS (SELECT lang, source, row, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM e GROUP BY lang, term HAVING count(DISTINCT row) >= {MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM e SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS size, (SELECT count(*) FROM k WHERE k.lang = g.lang) AS v FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
l AS (SELECT lang, sum(size) AS size FROM s GROUP BY lang),
p AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, {_P.format(n="coalesce(n, 0)", size="s.size")} AS p, {_P.format(n="k.total", size="l.size")} AS q
    FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) z ON z.lang = a.lang AND z.source = a.source AND z.other = b.source),
u AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}"""
}
