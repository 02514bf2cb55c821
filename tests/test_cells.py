"""Exact search over stored cells: the rows of all pairs, and what bounds spare."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill.operators import cells
from threadmill.plans.tables import new_path, settled


def clustered(n, groups=12, d=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d)) * 4
    return (centres[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * 0.3).astype(np.float32)


def brute(ids, vectors, queries, k):
    unit = lambda m: m / np.where((s := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, s)
    out = set()
    for q, v in queries:
        score = unit(vectors.astype(float)) @ unit(np.array([v], dtype=np.float32).astype(float))[0]
        for place, i in enumerate(sorted(range(len(ids)), key=lambda i: (-round(score[i], 9), ids[i]))[:k], 1):
            out.add((q, ids[i], place, round(score[i], 6)))
    return out


def frame(spark, ids, vectors, name="chunk_id"):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], f"{name} long, embedding array<float>")


def found(index, queries, k):
    rows = cells.search(index, queries, k).collect()
    return {(r.query, r.chunk_id, r.place, round(r.score, 6)) for r in rows}, {r.query: r.scored for r in rows}


def test_exact_and_sparing(spark, monkeypatch):
    vectors = clustered(900)
    vectors[5] = 0
    vectors[100:400] = vectors[100]  # a third are copies of one vector: ties by id
    ids = np.arange(900)
    path = new_path(spark, "cells")
    cells.write(frame(spark, ids[:600], vectors[:600]), path)
    cells.add(frame(spark, ids[600:], vectors[600:]), path)
    index = cells.read(spark, path)
    queries = [(int(i), vectors[i]) for i in ids[::50]] + [(9999, np.zeros(16, np.float32))]
    got, scored = found(index, frame(spark, [q for q, _ in queries], [v for _, v in queries], "query"), 7)
    assert got == brute(ids, vectors, queries, 7)
    assert np.mean([n for q, n in scored.items() if q != 9999]) < 0.5 * 900
    assert scored[9999] == 900  # every score is 0
    # A segment whose row in cells was never written counts for nothing.
    orphan = spark.read.parquet(f"{path}/blocks").limit(1).withColumn("segment", F.lit("failed"))
    orphan.write.mode("append").partitionBy("segment", "cell").parquet(f"{path}/blocks")
    assert found(cells.read(spark, path), frame(spark, [0], [vectors[0]], "query"), 7)[0] == brute(ids, vectors, [(0, vectors[0])], 7)


def test_more_asked_than_there_is(spark):
    vectors = clustered(20)
    path = new_path(spark, "cells")
    cells.write(frame(spark, range(20), vectors), path)
    assert found(cells.read(spark, path), frame(spark, [1], [vectors[3]], "query"), 50)[0] == brute(range(20), vectors, [(1, vectors[3])], 50)


def test_nothing_and_zero_vectors(spark):
    for rows in ([], np.zeros((3, 4), np.float32)):
        path = new_path(spark, "cells")
        cells.write(frame(spark, range(len(rows)), rows), path, np.zeros((0, 4)))
        got, _ = found(cells.read(spark, path), frame(spark, [1], [np.ones(4)], "query"), 2)
        assert got == ({(1, 0, 1, 0.0), (1, 1, 2, 0.0)} if len(rows) else set())


def test_another_length_is_an_error(spark):
    path = new_path(spark, "cells")
    cells.write(frame(spark, range(9), clustered(9, d=4)), path)
    with pytest.raises(Exception, match="4 dimensions"):
        cells.add(frame(spark, [10], [[1.0, 2.0]]), path)


def test_plan_has_no_cross_join(spark):
    path = new_path(spark, "cells")
    vectors = clustered(200)
    cells.write(frame(spark, range(200), vectors), path)
    plan = cells.search(cells.read(spark, path), frame(spark, range(4), vectors[:4], "query"), 3)._jdf.queryExecution().toString()
    assert "Cross" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_many_queries_are_not_broadcast(spark, monkeypatch):
    """They went through the driver with each cell that they ask for, as their shuffle was small by Spark's count."""
    monkeypatch.setattr(cells, "SENT_BYTES", 1000, raising=False)
    monkeypatch.setattr(cells, "ASKED_ROWS", 20, raising=False)
    path, vectors = new_path(spark, "cells"), np.random.default_rng(3).normal(size=(300, 8)).astype(np.float32)
    cells.write(frame(spark, range(300), vectors), path)
    index, queries = cells.read(spark, path), frame(spark, range(40), vectors[:40], "query")
    found_by = cells._scored(settled(cells._asked(queries, index, 5)), index, 5)
    assert found_by.count() and "Broadcast" not in found_by._jdf.queryExecution().executedPlan().toString()
    assert found(index, queries, 5)[0] == brute(range(300), vectors, list(enumerate(vectors[:40])), 5)
