"""Exact vector search over a stored index of cells (RET-04, JON-16, SRT-03 for many queries and large stores).

Vectors are put into the cell of the nearest of up to MOST_CELLS centres, which are fitted on a bounded sample. An index is three tables: centres; blocks, where a row holds up to
BLOCK vectors of one cell, partitioned by segment and cell; and cells, with the number of vectors of each cell and the largest angle (reach) of any to the centre. On the sphere,
a vector of a cell is within its reach of the centre, so by the triangle inequality no cosine to a query is above cos(angle to the centre - reach). A search scores the cells
with the best bounds until they hold k vectors; the k-th best score found there is what any further cell must be able to reach to be read at all. What is returned is exact;
what the bounds spare depends on how far the vectors cluster (each query's column scored says how many were scored).

Queries and vectors meet in a join on the cell, a row per block on both sides, so a large cell or one that all queries ask for is many rows that adaptive execution can split;
queries of up to SENT_BYTES, once for each cell they ask for, are broadcast, and the partitions of their cells alone are read. More than that are shuffled, whatever Spark takes their
size to be: the driver gets no more of them. What a task computes at once is bounded by MATRIX, whatever the number of queries and cells. add() appends a segment; the row in cells comes last, so what a failed one
has written counts for nothing.

A vector of another length than the index's, or none, is an error. A vector of length 0 has the score 0 with every query, and stands in a cell of its own. An empty index gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.operators.vectors import _matrix, _units
from threadmill.plans.tables import settled

MOST_CELLS = 4096
#: Bytes of queries, once for each cell asked, up to which they are broadcast.
SENT_BYTES = 4 << 20
#: Numbers in a matrix of points and centres, and rows (query, cell) made at once.
MATRIX, ASKED_ROWS = 1 << 22, 1 << 16
#: Bytes of vectors that centres are fitted on.
SAMPLE_BYTES = 64 << 20
ROUNDS = 10
#: Vectors, and queries, in a row of blocks.
BLOCK, QUERY_BLOCK = 4096, 512
#: What a bound is raised by: scores and angles are rounded.
SLACK = 1e-6
#: The cell of vectors of length 0.
NOWHERE = -1


@dataclass
class Cells:
    centres: np.ndarray
    blocks: DataFrame
    #: Of each cell: (reach, n).
    cells: dict[int, tuple[float, int]]

    @property
    def n(self) -> int:
        return sum(n for _, n in self.cells.values())


def fit(chunks: DataFrame, n_cells: int | None = None, seed: int = 0) -> np.ndarray:
    """Centres: k-means on the sphere over a sample of SAMPLE_BYTES, chosen by the hash of chunk_id; as many as the square root of the number of vectors if not said."""
    head = chunks.select(F.count("*"), F.max(F.size("embedding"))).first()
    n, d = head[0], head[1] or 0
    if not n or d < 1:
        return np.zeros((0, max(d, 0)))
    n_cells = min(MOST_CELLS, n_cells or max(1, round(n**0.5)))
    share = min(1.0, SAMPLE_BYTES / (4 * d) / n)
    rows = chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("chunk_id", "embedding").toArrow()
    rows = rows.sort_by("chunk_id").combine_chunks()
    points = _matrix(pa.concat_arrays(rows.column("embedding").chunks), d)
    points = points[points.any(axis=1)]
    if not len(points):
        return np.zeros((0, d))
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(n_cells, len(points)), replace=False)]
    for _ in range(ROUNDS):
        near = _nearest(points, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        filled = sums.any(axis=1)
        centres = np.where(filled[:, None], _units(sums), centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, and the cosine to it."""
    at, best = np.zeros(len(points), np.int64), np.zeros(len(points))
    step = max(1, MATRIX // max(1, len(centres)))
    for k in range(0, len(points), step):
        cosine = points[k : k + step] @ centres.T
        at[k : k + step] = cosine.argmax(axis=1)
        best[k : k + step] = cosine.max(axis=1)
    return at, best


def _packed(rows: DataFrame, id_column: str, most: int) -> DataFrame:
    """rows (cell, id, embedding) as rows (cell, ids, vectors) of up to `most` of one cell, in the order of their ids. A large cell is spread over the tasks."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, vectors, size = None, [], [], 0

        def block() -> pa.RecordBatch:
            whole, flat = pa.concat_arrays(ids), pa.concat_arrays(vectors)
            lists = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), lists(whole), lists(flat)], ["cell", "ids", "vectors"])

        for batch in batches:
            cells = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                while a < b:
                    if size and (cell != int(cells[a]) or size == most):
                        yield block()
                        ids, vectors, size = [], [], 0
                    n = min(b - a, most - size)
                    cell, size = int(cells[a]), size + n
                    ids.append(batch.column(1).slice(a, n))
                    vectors.append(batch.column(2).slice(a, n).flatten())
                    a += n
        if size:
            yield block()

    ordered = rows.select("cell", id_column, "embedding").repartitionByRange("cell", id_column).sortWithinPartitions("cell", id_column)
    return ordered.mapInArrow(pack, f"cell int, ids array<{kinds[id_column]}>, vectors {kinds['embedding']}")


def write(chunks: DataFrame, path: str, centres: np.ndarray | None = None) -> None:
    """A new index of chunks (chunk_id, embedding) under path."""
    centres = fit(chunks) if centres is None else centres
    d = centres.shape[1]
    chunks.sparkSession.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)] or [(NOWHERE, [0.0] * d)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    add(chunks, path)


def add(chunks: DataFrame, path: str) -> None:
    """Add chunks to the index as a segment of it. That none of them is there already is the caller's concern."""
    spark = chunks.sparkSession
    centres, segment = _centres(spark, path), uuid.uuid4().hex
    d, sent = centres.shape[1], spark.sparkContext.broadcast(centres)

    @F.arrow_udf("struct<cell:int,angle:double>")
    def placed(vectors: pa.Array) -> pa.Array:
        points, to = _matrix(vectors, d), sent.value
        if len(to):
            at, cosine = _nearest(points, to)
        else:
            at, cosine = np.full(len(points), NOWHERE), np.ones(len(points))
        nowhere = ~points.any(axis=1)
        at[nowhere], cosine[nowhere] = NOWHERE, 1.0
        return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.arccos(np.clip(cosine, -1, 1)))], ["cell", "angle"])

    same = F.assert_true(F.coalesce(F.size("embedding"), F.lit(-1)) == d, F.lit(f"the index has {d} dimensions"))
    rows = chunks.where(same.isNull()).select("chunk_id", "embedding", placed("embedding").alias("at")).select("chunk_id", "embedding", "at.cell", "at.angle")
    rows = settled(rows, "cells")
    _packed(rows, "chunk_id", BLOCK).withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment", "cell").parquet(f"{path}/blocks")
    rows.groupBy("cell").agg(F.max("angle").alias("reach"), F.count("*").alias("n")).withColumn("segment", F.lit(segment)).coalesce(1).write.mode("append").parquet(f"{path}/cells")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    centres = np.array([r.centre for r in rows])
    return centres if rows[0].cell != NOWHERE else np.zeros((0, centres.shape[1]))


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> Cells:
    """A stored index. Its centres and cells, MOST_CELLS at most, are held by the driver."""
    stats = spark.read.schema("cell int, reach double, n bigint, segment string").parquet(f"{path}/cells")
    rows = stats.groupBy("cell").agg(F.max("reach").alias("reach"), F.sum("n").alias("n")).collect()
    segments = [r.segment for r in stats.select("segment").distinct().collect()]
    blocks = spark.read.schema(f"ids array<{id_type}>, vectors array<float>, segment string, cell int").parquet(f"{path}/blocks")
    return Cells(_centres(spark, path), blocks.where(F.col("segment").isin(segments)), {r.cell: (r.reach, r.n) for r in rows})


def _asked(queries: DataFrame, index: Cells, k: int) -> DataFrame:
    """(query, embedding, cell, n): the cells to score for each query. Without a column least, those with the best bounds until they have k vectors, else the others whose bound reaches least."""
    names = sorted(index.cells)
    near = [c for c in names if c != NOWHERE]
    reach, n = (np.array([index.cells[c][x] for c in names]) for x in (0, 1))
    sent = queries.sparkSession.sparkContext.broadcast(index.centres[near])
    d, again = index.centres.shape[1], "least" in queries.columns
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    step = max(1, ASKED_ROWS // len(names))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, step) for whole in batches for a in range(0, len(whole), step)):
            asked = _matrix(batch.column(1), d)
            bound = np.zeros((len(asked), len(names)))
            if near:
                angle = np.arccos(np.clip(asked @ sent.value.T, -1, 1))
                bound[:, len(names) - len(near) :] = np.cos(np.maximum(0, angle - reach[len(names) - len(near) :]))
            bound[~asked.any(axis=1)] = 0
            order = np.argsort(-bound, axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order]
            first = np.zeros(bound.shape, dtype=bool)
            np.put_along_axis(first, order, before < k, axis=1)
            taken = ~first & (bound >= batch.column(2).to_numpy()[:, None] - SLACK) if again else first
            of, at = np.nonzero(taken)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(np.array(names, dtype=np.int32)[at]), pa.array(n[at].astype(np.int64))], ["query", "embedding", "cell", "n"])

    rows = queries.select("query", "embedding", *(["least"] if again else []))
    return rows.mapInArrow(cells, f"query {kinds['query']}, embedding {kinds['embedding']}, cell int, n bigint")


def _scored(asked: DataFrame, index: Cells, k: int) -> DataFrame:
    """(query, chunk_id, score): of every block of an asked cell the k best of each query, at least. asked: stored."""
    d = index.centres.shape[1]
    sides = _packed(asked, "query", QUERY_BLOCK).select("cell", F.col("ids").alias("queries"), F.col("vectors").alias("asked"))
    kinds = {f.name: f.dataType.elementType.simpleString() for f in [*index.blocks.schema, *sides.schema] if f.name in ("ids", "queries")}

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queries, asked, ids, vectors in zip(*(batch.column(c) for c in ("queries", "asked", "ids", "vectors")), strict=True):
                matrix = lambda x: _units(x.values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, d))
                score, ids = matrix(asked) @ matrix(vectors).T, ids.values
                by_id = pc.array_sort_indices(ids).to_numpy()
                top = by_id[np.argsort(-score[:, by_id], axis=1, kind="stable")[:, :k]]
                of = np.repeat(np.arange(len(score)), top.shape[1])
                yield pa.RecordBatch.from_arrays([queries.values.take(pa.array(of)), ids.take(pa.array(top.ravel())), pa.array(score[of, top.ravel()])], ["query", "chunk_id", "score"])

    few = asked.count() * 4 * d <= SENT_BYTES
    joined = (F.broadcast(sides) if few else sides.hint("merge")).join(index.blocks, "cell").select("queries", "asked", "ids", "vectors")
    return joined.mapInArrow(best, f"query {kinds['queries']}, chunk_id {kinds['ids']}, score double")


def _placed(rows: DataFrame, k: int) -> DataFrame:
    place: Column = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("chunk_id")))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def search(index: Cells, queries: DataFrame, k: int) -> DataFrame:
    """RET-04: (query, chunk_id, score, place, scored) of each query's k most similar chunks, ties by smaller chunk_id. queries: query (unique), embedding. scored: how many chunks' scores were computed for it."""
    if not index.cells:
        kinds = {f.name: f.dataType for f in queries.schema} | {"chunk_id": index.blocks.schema["ids"].dataType.elementType}
        return queries.sparkSession.createDataFrame([], f"query {kinds['query'].simpleString()}, chunk_id {kinds['chunk_id'].simpleString()}, score double, place int, scored bigint")
    first = settled(_asked(queries, index, k), "cells-first")
    found = settled(_placed(_scored(first, index, k), k), "cells-found")
    least = found.where(F.col("place") == k).select("query", F.col("score").alias("least"))
    further = settled(_asked(queries.select("query", "embedding").join(least, "query"), index, k), "cells-further")
    rows = found.select("query", "chunk_id", "score").union(_scored(further, index, k))
    counted = first.select("query", "n").union(further.select("query", "n")).groupBy("query").agg(F.sum("n").alias("scored"))
    return _placed(rows, k).join(counted, "query")
