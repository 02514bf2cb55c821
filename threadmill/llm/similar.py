"""Near-duplicates by similarity: texts whose sets of word shingles have a Jaccard similarity of `least` or more are linked.

This is the near-dedup stage's way to use the SimHash operator. Three differing bits of 64, as simhash links by itself, find few texts of similarity 0.8: these
differ in 10 bits on average, and no exact index of 64 bits reaches so far. So candidates come from MinHash bands, and fingerprints only rule
out; whether two texts are linked is decided by their whole sets of shingle hashes. With BANDS bands of ROWS rows, a pair at 0.8 shares no band with a probability of
(1 - 0.8^ROWS)^BANDS, 3 in 100,000; more similar pairs, less.

Texts with equal sets are one vertex, however many rows they are. In each band's bucket the vertices are first compared with the one of the
smallest id, so a large group of near copies costs a comparison a vertex. Only buckets that these links leave in several components
are searched on, in numpy: in blocks of BLOCK vertices, each compared with each other block. Fingerprints rule out pairs that differ in more than FAR
bits (a pair at 0.8 does with a probability below 1 in a million); then bit maps of the sets' hashes bound the similarity from above, which loses nothing and leaves little but pairs
close to `least`. No task holds more than two blocks, and only what is left is passed on. A vertex is shuffled once for each block of its bucket; a bucket of more
than MOST_BLOCKS is split first: its sets' hashes are counted, and vertices meet only where they share one of the rarest fifth of their hashes, as two sets of the
similarity must. So passages that very many documents share, which make such buckets, bring together only documents that consist of them. Sizes alone rule out pairs below `least`. Components as in simhash.

Words are as in simhash: ASCII lower case, split at ASCII white space. A text of fewer words than a shingle has is one shingle; null or empty text has
none, and is equal to others of the kind only. Rows are judged by their text alone. A very long text is taken whole. An empty table gives an empty result. Columns that
start with __tm_ are the operator's own; all others pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.common import discard, key_filter, materialize, mix64, plain, with_maybe
from threadmill.llm.decontaminate import _grams, _Hashes
from threadmill.llm.simhash import components, keep_rows, smallest_ids

SHINGLE_WORDS = 5
#: The least similarity of linked texts, in hundredths.
LEAST = 80
BANDS, ROWS = 20, 4
_MULTIPLIERS = np.random.default_rng(42).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_STEP = 1 << 12
#: Vertices of a bucket in one block, and the most bits in which fingerprints of candidates differ.
BLOCK, FAR = 4096, 24
#: Blocks of a bucket up to which all of them are compared; each vertex is shuffled as often.
MOST_BLOCKS = 32
#: Least and largest length of a set's bit map.
MAP_BITS = (1 << 10, 1 << 16)


def shingles(text: bytes, hashes: _Hashes, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The set of a text's shingles, as ascending hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    return np.unique(_grams(h, min(shingle_words, len(h))))


def _bands(found: np.ndarray) -> np.ndarray:
    """The keys of a set's bands."""
    least = np.full(len(_MULTIPLIERS), ~np.uint64(0))
    for k in range(0, len(found), _STEP):
        np.minimum(least, (found[k : k + _STEP] * _MULTIPLIERS[:, None]).min(axis=1), out=least)
    least = mix64(least).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key * _MULTIPLIERS[0] + least[:, k])
    return key


def _fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(found), _STEP):
        counts += np.unpackbits(found[k : k + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<u8")[0])


def _digest(found: np.ndarray) -> int:
    """A number of the set; 0 for the empty one."""
    return _Hashes()[found.tobytes()] if len(found) else 0


def _bytes(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _sketched(text: Column, shingle_words: int) -> Column:
    """v (the set's digest), n (its size), its fingerprint and bands of a text."""

    @F.arrow_udf("struct<v:bigint,n:bigint,fp:bigint,bands:array<bigint>>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = _Hashes()
        for texts in batches:
            digests, sizes, prints, keys = [], [], [], []
            for t in texts:
                found = shingles(_bytes(t), hashes, shingle_words)
                digests.append(_digest(found))
                sizes.append(len(found))
                prints.append(_fingerprint(found))
                keys.append(_bands(found) if len(found) else found)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.StructArray.from_arrays([pa.array(np.array(digests, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), bands], ["v", "n", "fp", "bands"])

    return sketch(text)


def _sets(text: Column, shingle_words: int) -> Column:
    @F.arrow_udf("binary")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = _Hashes()
        for texts in batches:
            yield pa.array([shingles(_bytes(t), hashes, shingle_words).tobytes() for t in texts], pa.binary())

    return sets(text)


def _maps(found: Column) -> Column:
    @F.arrow_udf("binary")
    def maps(sets: pa.Array) -> pa.Array:
        return pa.array([_bit_map(np.frombuffer(x.as_buffer(), np.uint64)) for x in sets], pa.binary())

    return maps(found)


def _alike(a: Column, b: Column, least: int) -> Column:
    """Whether two sets have a similarity of `least` hundredths or more, in whole numbers."""

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= least * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return alike(a, b)


def _near(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Whether two sets of these sizes may have the similarity."""
    return np.minimum(a, b) * 100 >= np.maximum(a, b) * least


def _bit_map(found: np.ndarray) -> bytes:
    """A bit for each hash of the set, at its lowest bits; about 16 bits a hash."""
    m = min(max(1 << int(16 * max(1, len(found)) - 1).bit_length(), MAP_BITS[0]), MAP_BITS[1])
    bits = np.zeros(m, dtype=np.uint8)
    bits[(found & np.uint64(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(maps: Column) -> Column:
    """Maps of the least length: what they rule out, the whole ones rule out, too."""

    @F.arrow_udf("binary")
    def folded(maps: pa.Array) -> pa.Array:
        return pa.array([np.bitwise_or.reduce(np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, MAP_BITS[0] // 64), axis=0).tobytes() for x in maps], pa.binary())

    return folded(maps)


def _levels(maps: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the maps of at least that length, folded to it: (row of each vertex, maps)."""
    sizes, out = np.array([len(m) for m in maps]), {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes >= size)
        rows = np.stack([np.bitwise_or.reduce(np.frombuffer(maps[k], np.uint64).reshape(-1, size // 8), axis=0) for k in at])
        place = np.zeros(len(maps), dtype=np.int64)
        place[at] = np.arange(len(at))
        out[size] = place, rows
    return out


def _may_be_alike(p: np.ndarray, q: np.ndarray, n: np.ndarray, sizes: np.ndarray, levels: dict, least: int) -> np.ndarray:
    """False where p's and q's bit maps leave no room for the similarity: a bit that one alone has is a hash that one alone has."""
    ok, of_pair = np.zeros(len(p), dtype=bool), np.minimum(sizes[p], sizes[q])
    for size, (place, rows) in levels.items():
        some = np.flatnonzero(of_pair == size)
        for a in range(0, len(some), step := max(1, (1 << 24) // size)):
            at = some[a : a + step]
            x, y = rows[place[p[at]]], rows[place[q[at]]]
            both = np.minimum(n[p[at]] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), n[q[at]] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
            ok[at] = 100 * both >= least * (n[p[at]] + n[q[at]] - both)
    return ok


def _block_pairs(least: int):
    """frames: rows of pairs of blocks, (band, i, k, side, v, n, root, fp, map), each pair in one run. Candidates (u, v)."""

    def of_group(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        v, n, root, side = (x[c].to_numpy() for c in ("v", "n", "root", "side"))
        fp, same = x["fp"].to_numpy().view(np.uint64), x["i"].iat[0] == x["k"].iat[0]
        maps = x["map"].tolist()
        levels, sizes = _levels(maps), np.array([len(m) for m in maps])
        step = max(1, (1 << 20) // len(x))
        for a in range(0, len(x), step):
            p, q = np.nonzero(np.bitwise_count(fp[a : a + step, None] ^ fp[None, :]) <= FAR)
            p += a
            ok = (root[p] != root[q]) & _near(n[p], n[q], least) & ((v[p] < v[q]) if same else (side[p] < side[q]))
            p, q = p[ok], q[ok]
            ok = _may_be_alike(p, q, n, sizes, levels, least)
            p, q = p[ok], q[ok]
            yield pd.DataFrame({"u": np.minimum(v[p], v[q]), "v": np.maximum(v[p], v[q])})

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            groups = [g for _, g in held.groupby(["band", "i", "k"], sort=False)]
            for g in groups[:-1]:
                yield from of_group(g)
            held = groups[-1] if groups else None
        if held is not None and len(held):
            yield from of_group(held)

    return pairs


def _prefixes(hot: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """(h, w) for the vertices of hot (v): of each set's hashes the rarest n - least * n + 1, as far as another one has them. Two sets of the similarity share one of these, as all sets
    take the same order: by how many of these vertices have a hash, then by the hash."""

    @F.arrow_udf("array<bigint>")
    def hashes(sets: pa.Array) -> pa.Array:
        parts = [np.frombuffer(x.as_buffer(), np.int64) for x in sets]
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))

    elements = materialize(sets.join(hot.select(F.col("v").alias("w")).distinct(), "w", "left_semi").select("w", F.explode(hashes("s")).alias("h")), "elements")
    often = materialize(elements.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "often")
    of_set = Window.partitionBy("w")
    ranked = elements.join(often, "h", "left").withColumns({"df": F.coalesce("df", F.lit(1)), "n": F.count("*").over(of_set), "place": F.row_number().over(of_set.orderBy(F.coalesce("df", F.lit(1)), "h"))})
    out = materialize(ranked.where((F.col("df") > 1) & (F.col("place") <= F.col("n") - F.ceil(F.col("n") * least / 100) + 1)).select("h", "w"), "prefixes")
    discard(elements, often)
    return out


def _compared(rows: DataFrame, maps: DataFrame, least: int, block: int) -> DataFrame:
    """Candidates (u, v) of the rows (band, v, n, fp, root) of a bucket, in blocks; buckets of one component have none. maps: __tm_w, map."""
    apart = rows.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).where("low <> high")
    apart = materialize(apart.select("band", F.ceil(F.col("members") / block).cast("int").alias("blocks")), "apart")
    left = rows.join(apart, "band").withColumn("side", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.join(maps, left["v"] == maps["__tm_w"]).select("band", F.least("side", "j").alias("i"), F.greatest("side", "j").alias("k"), "side", "v", "n", "root", "fp", "map")
    return left.repartition("band", "i", "k").sortWithinPartitions("band", "i", "k").mapInPandas(_block_pairs(least), "u bigint, v bigint")


def links(marked: DataFrame, vertices: DataFrame, text: str, least: int = LEAST, shingle_words: int = SHINGLE_WORDS, most_blocks: int = MOST_BLOCKS, block: int = BLOCK) -> DataFrame:
    """Pairs (u, v) of linked vertices that join each component. vertices: v, n, fp, bands, the least id, `least`, and the row that gives the set; marked: stored rows with __tm_row."""
    bucketed = vertices.select("v", "n", "fp", "least", "row", F.explode("bands").alias("band"))
    first = bucketed.groupBy("band").agg(F.min(F.struct(F.col("least").isNull(), "least", "v", "n")).alias("first"), F.count("*").alias("members")).where("members > 1")
    first = materialize(first.select("band", F.col("first.v").alias("v0"), F.col("first.n").alias("n0")), "first-of-bucket")
    shared = materialize(bucketed.join(first, "band").select("band", "v", "n", "fp", "row", "v0", "n0"), "shared")
    discard(first)
    near = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * least
    pair = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))

    # The sets of the vertices in shared buckets alone, each from one row. Rows that a filter of these can rule out don't move.
    wanted = materialize(shared.select(F.col("v").alias("w"), "row").distinct(), "wanted")
    bits = materialize(key_filter(wanted, F.xxhash64("row")), "wanted-filter")
    rows = with_maybe(marked.select("__tm_row", F.col(plain(text)).alias("t")), F.xxhash64("__tm_row"), bits).where("__tm_maybe")
    sets = materialize(rows.join(wanted, rows["__tm_row"] == wanted["row"]).select("w", _sets(F.col("t"), shingle_words).alias("s")), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        a, b = sets.select(F.col("w").alias("u"), F.col("s").alias("a")), sets.select(F.col("w").alias("v"), F.col("s").alias("b"))
        return materialize(pairs.join(a, "u").join(b, "v").where(_alike(F.col("a"), F.col("b"), least)).select("u", "v"), "links")

    tried = materialize(shared.where((F.col("v") != F.col("v0")) & near(F.col("n"), F.col("n0"))).select(*pair(F.col("v"), F.col("v0"))).distinct(), "pairs")
    found = linked(tried)
    roots = components(found).select(F.col("u").alias("__tm_u"), "root")
    named = materialize(shared.join(roots, shared["v"] == roots["__tm_u"], "left").select("band", "v", "n", "fp", F.coalesce("root", "v").alias("root")), "named")
    # Buckets of so many blocks that comparing all of them would shuffle each vertex too often are split by what their sets have that few others have.
    sizes = materialize(named.groupBy("band").agg(F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high")).where((F.col("low") != F.col("high")) & (F.col("members") > most_blocks * block)).select("band"), "hot-buckets")
    maps = sets.select(F.col("w").alias("__tm_w"), _maps(F.col("s")).alias("map"))
    rest = _compared(named.join(sizes, "band", "left_anti"), maps, least, block)
    if not sizes.isEmpty():
        hot = materialize(named.join(sizes, "band", "left_semi").select("v", "n", "fp", "root").distinct(), "hot")
        split = _prefixes(hot, sets, least).join(hot, F.col("w") == F.col("v")).select(F.col("h").alias("band"), "v", "n", "fp", "root")
        rest = rest.union(_compared(materialize(split, "hot-split"), maps.withColumn("map", _folded(F.col("map"))), least, block))
    rest = materialize(rest.distinct(), "candidates")
    # What is linked so far is a star per component already.
    return roots.select(F.col("__tm_u").alias("u"), F.col("root").alias("v")).union(linked(rest.join(tried, ["u", "v"], "left_anti")))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Of each component the row with the smallest id, one of repeated rows, with docs' columns. A component without any id keeps a row per set."""
    columns = docs.columns
    sketched = docs.withColumn("__tm_s", _sketched(F.col(plain(text)), shingle_words)).withColumn("__tm_row", F.monotonically_increasing_id())
    marked = materialize(sketched.select(*(F.col(plain(c)) for c in columns), "__tm_row", F.col("__tm_s.v").alias("__tm_v"), F.col("__tm_s.n").alias("__tm_n"), F.col("__tm_s.fp").alias("__tm_fp"), F.col("__tm_s.bands").alias("__tm_bands")), "marked-docs")
    # A vertex is a set; its row is the one whose text gives the set again.
    vertices = materialize(marked.groupBy(F.col("__tm_v").alias("v")).agg(F.min(plain(id_column)).alias("least"), F.min("__tm_row").alias("row"), F.first("__tm_n").alias("n"), F.first("__tm_fp").alias("fp"), F.first("__tm_bands").alias("bands")), "vertices")
    found = smallest_ids(vertices.select("v", "least"), components(links(marked, vertices, text, least, shingle_words)))
    return keep_rows(marked, found, columns, id_column)
