"""SimHash near-duplicates, found in a hierarchical index over fingerprints in Gray order.

Two 64-bit fingerprints link when at most `most` bits differ; documents reachable through links form a
component. Fingerprints are made per text in numpy. Then, over the distinct fingerprints only:

* upper nodes: of `most + 1` disjoint blocks of bits, two linked fingerprints agree in one at least, so each
  fingerprint goes to a node per block, named by the masked bit pattern that the node's members share. A node
  with more than NODE_MOST members is cut by longer masks in the same way, until none is too large: no
  task gets an unbounded group, and no link is lost. Tasks take nodes in order and hold a bounded number of rows.
* lower nodes: a node's members stand in Gray order, where neighbours differ in few bits. Runs of eight, of
  eight runs and so on form a tree; each tree node holds the bits that all below it share. A search goes
  from the top, adds up the differences in the bits that each step newly fixes, and drops a whole group once
  these exceed `most`.
* each node's task joins its links into trees, so that a member has one edge at most, and Spark joins the
  trees by alternating large-star and small-star rounds, each written to the shared folder.

Null or empty text: fingerprint zero, linked like any other. Rows with equal texts have equal fingerprints and
cost one entry in the index, however many they are. component_id is the smallest doc_id that isn't null
(null where a component has no other). An empty table gives an empty result. A very long text is taken whole, its shingles in slices. Columns that
start with __tm_ are the operator's own; all others pass through keep_one, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.common import discard, materialize, plain, read, without

MOST_BITS = 3
SHINGLE_WORDS = 3
#: Members of an index node beyond which it is cut again.
NODE_MOST = 512
#: Members of nodes that a task works on at once.
NODE_ROWS = 1 << 16
FAN = 8


def _fingerprint(text: bytes, shingle_words: int) -> int:
    words = text.lower().split()  # of bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle_words:
        starts, ends = starts[: 1 - shingle_words], ends[shingle_words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + (1 << 16)].tolist(), ends[k : k + (1 << 16)].tolist(), strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """df and the fingerprints of its texts (long; the same 64 bits)."""

    @F.arrow_udf("bigint")
    def fingerprint(texts: pa.Array) -> pa.Array:
        found = (_fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle_words) for t in texts)
        return pa.array(np.fromiter(found, dtype=np.uint64, count=len(texts)).view(np.int64))

    return df.withColumn(out, fingerprint(F.col(plain(text))))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Places of 64-bit patterns in the reflected Gray order."""
    x = x.astype(np.uint64, copy=True)
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def linked(patterns: np.ndarray, group: np.ndarray, most: int, chunk: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of linked patterns of one group. group ascends; within it, patterns are in Gray order."""
    n = len(patterns)
    if n < 2:
        return
    # Level 0 is the patterns; a node of the next level is a run of FAN nodes of one group, with the bits all below share.
    levels = [{"value": patterns, "same": np.full(n, ~np.uint64(0)), "end": np.arange(1, n + 1), "group": group, "child": np.arange(n)}]
    while True:
        low = levels[-1]
        new = np.concatenate(([True], low["group"][1:] != low["group"][:-1]))
        if new.all():
            break
        begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        first = np.flatnonzero((np.arange(len(new)) - begin) % FAN == 0)
        ones = np.bitwise_and.reduceat(low["value"] & low["same"], first)
        zeros = np.bitwise_and.reduceat(~low["value"] & low["same"], first)
        levels.append({"value": ones, "same": ones | zeros, "end": low["end"][np.append(first[1:], len(new)) - 1], "group": low["group"][first], "child": first})
    top = np.searchsorted(levels[-1]["group"], group)
    for start in range(0, n, chunk):
        query = np.arange(start, min(n, start + chunk))
        node, differ = top[query], np.zeros(len(query), dtype=np.int64)
        fixed = np.zeros(len(query), dtype=np.uint64)
        for depth in range(len(levels) - 1, -1, -1):
            at = levels[depth]
            # The bits that this step fixes, beyond those fixed above.
            differ = differ + np.bitwise_count((patterns[query] ^ at["value"][node]) & at["same"][node] & ~fixed)
            ok = (differ <= most) & (at["end"][node] > query + 1)
            query, node, differ = query[ok], node[ok], differ[ok]
            if depth == 0:
                break
            fixed = at["same"][node]
            begin = at["child"][node]
            stop = np.where(node + 1 < len(at["child"]), at["child"][np.minimum(node + 1, len(at["child"]) - 1)], len(levels[depth - 1]["value"]))
            times = stop - begin
            query, differ, fixed = np.repeat(query, times), np.repeat(differ, times), np.repeat(fixed, times)
            node = np.repeat(begin - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(len(query))
        later = node > query
        yield query[later], node[later]


def _smallest(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i and j: of each tree the smallest place."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (step := labels[labels]).tobytes() != labels.tobytes():
            labels = step
    return labels


def _edges(mask: np.ndarray, bits: np.ndarray, patterns: np.ndarray, most: int) -> pd.DataFrame:
    """Trees of the links in whole nodes."""
    order = np.lexsort((gray_rank(patterns), bits, mask))
    mask, bits, patterns = mask[order], bits[order], patterns[order]
    group = np.cumsum(np.concatenate(([0], (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1]))))
    labels = np.arange(len(patterns))
    for i, j in linked(patterns, group, most):
        labels = _smallest(labels, i, j)
    tied = np.flatnonzero(labels != np.arange(len(labels)))
    return pd.DataFrame({"u": patterns[tied].view(np.int64), "v": patterns[labels[tied]].view(np.int64)})


def _node_edges(most: int):
    def edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """frames: sorted by node. What a task holds is NODE_ROWS rows and a node."""
        held = [np.zeros(0, np.int64)] * 3
        for frame in frames:
            held = [np.concatenate((x, frame[c].to_numpy())) for x, c in zip(held, ("mask", "bits", "fp"), strict=True)]
            if len(held[0]) < NODE_ROWS:
                continue
            mask, bits, patterns = held
            last = np.flatnonzero((mask != mask[-1]) | (bits != bits[-1]))  # the last node may go on
            if len(last):
                end = last[-1] + 1
                yield _edges(mask[:end], bits[:end], patterns[:end].view(np.uint64), most)
                held = [x[end:] for x in held]
        if len(held[0]):
            yield _edges(held[0], held[1], held[2].view(np.uint64), most)

    return edges


def _blocks(mask: int, parts: int) -> list[int]:
    """The bits outside mask in so many disjoint parts, the mask added to each."""
    free = [1 << b for b in range(64) if not mask >> b & 1]
    return [mask | sum(free[len(free) * k // parts : len(free) * (k + 1) // parts]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fingerprints: DataFrame, most: int = MOST_BITS, node_most: int = NODE_MOST) -> DataFrame:
    """Edges (u, v) that join the linked ones of the distinct fingerprints `fp` into trees."""
    spark, parts, found = fingerprints.sparkSession, most + 1, []
    masks = _blocks(0, parts)
    rows = fingerprints.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask")).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
    while True:
        large = materialize(rows.groupBy("mask", "bits").count().where(F.col("count") > node_most).select("mask", "bits"), "simhash-large")
        fine = rows.join(large, ["mask", "bits"], "left_anti")
        found.append(fine.repartition("mask", "bits").sortWithinPartitions("mask", "bits").mapInPandas(_node_edges(most), "u bigint, v bigint"))
        if large.isEmpty():
            break
        # Each mask is cut alike wherever it is too large.
        masks = [m for m in masks if m != (1 << 64) - 1]
        cuts = {m: _blocks(m, parts) for m in masks}
        child = F.create_map(*(x for m, c in cuts.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(b)) for b in c)))))
        rows = materialize(rows.join(large, ["mask", "bits"], "left_semi").select("fp", F.explode(child[F.col("mask")]).alias("mask")).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask"))).distinct(), "simhash-rows")
        masks = sorted({b for c in cuts.values() for b in c})
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for the vertices of the edges (u, v) that aren't the smallest of their component, root being that. What is joined is stored, so that a vertex with many edges can be split."""
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        # Large star: every neighbour above u moves to the smallest of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large-star")
        discard(edges, least)
        # Small star: u and its neighbours below move to the smallest of them.
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "small-least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "small-star")
        discard(large, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select("u", F.col("v").alias("root"))
        before = now


def smallest_ids(vertices: DataFrame, roots: DataFrame) -> DataFrame:
    """(v, component_id) of all vertices (v, least): of each component the smallest least, stored. roots: of components()."""
    roots = roots.select(F.col("u").alias("__tm_u"), "root")
    of = materialize(vertices.join(roots, vertices["v"] == roots["__tm_u"], "left").select("v", "least", F.coalesce("root", "v").alias("root")), "rooted")
    ids = materialize(of.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    out = materialize(of.join(ids, "root").select("v", "component_id"), "classes")
    discard(of, ids)
    return out


def classes(marked: DataFrame, fingerprint: str = "__tm_fp", id_column: str = "doc_id", most: int = MOST_BITS, node_most: int = NODE_MOST) -> DataFrame:
    """(v, component_id) of the distinct fingerprints v of a stored table, stored."""
    named = materialize(marked.groupBy(F.col(fingerprint).alias("v")).agg(F.min(plain(id_column)).alias("least")), "fingerprints")
    return smallest_ids(named, components(links(named.select(F.col("v").alias("fp")), most, node_most)))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", most: int = MOST_BITS, node_most: int = NODE_MOST) -> DataFrame:
    """A row per row of docs: its id, its fingerprint (16 hex digits), and the smallest id of its component."""
    marked = with_fingerprint(docs.select(F.col(plain(id_column)).alias("__tm_id"), F.col(plain(text)).alias("__tm_text")), "__tm_text", "__tm_fp").select("__tm_id", "__tm_fp")
    marked = materialize(marked, "marked")
    found = classes(marked, "__tm_fp", "__tm_id", most, node_most)
    return marked.join(found, marked["__tm_fp"] == found["v"]).select(F.col("__tm_id").alias(id_column), F.lpad(F.lower(F.hex("__tm_fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_rows(marked: DataFrame, found: DataFrame, columns: list[str], id_column: str) -> DataFrame:
    """Of each class the row with the smallest id, one of repeated rows. marked: stored rows with __tm_row and __tm_v; found: v and component_id. Only rows that a filter of those to go can't clear are shuffled."""
    slim = marked.select("__tm_row", "__tm_v", F.col(plain(id_column)).alias("__tm_id"))
    judged = slim.join(found, slim["__tm_v"] == found["v"]).select("__tm_row", "__tm_v", "__tm_id", F.col("__tm_id").eqNullSafe(F.col("component_id")).alias("__tm_stays"))
    judged = materialize(judged, "judged")
    # Rows that repeat id and class: the first stays.
    again = judged.where("__tm_stays").groupBy("__tm_id", "__tm_v").agg(F.min("__tm_row").alias("__tm_first"), F.count("*").alias("__tm_n")).where("__tm_n > 1")
    again = materialize(again.select(F.col("__tm_id").alias("i"), F.col("__tm_v").alias("v"), "__tm_first"), "repeated")
    repeated = judged.where("__tm_stays").join(again, F.col("__tm_id").eqNullSafe(F.col("i")) & (F.col("__tm_v") == F.col("v"))).where("__tm_row <> __tm_first")
    gone = judged.where("NOT __tm_stays").select("__tm_row").union(repeated.select("__tm_row"))
    return without(marked, gone, [F.col("__tm_row")]).select(*(F.col(plain(c)) for c in columns))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", most: int = MOST_BITS) -> DataFrame:
    """Of each component the row with the smallest id, one of repeated rows, with docs' columns. A component without any id keeps a row per fingerprint."""
    marked = materialize(with_fingerprint(docs, text, "__tm_v").withColumn("__tm_row", F.monotonically_increasing_id()), "marked-docs")
    return keep_rows(marked, classes(marked, "__tm_v", id_column, most), docs.columns, id_column)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op5_simhash": op5_simhash}
ORACLE_SQL: dict[str, str] = {}
