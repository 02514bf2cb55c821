"""Vector search, recency, diversity, and the hybrid of these with full text.

Scores are column expressions over the stored vectors, so a search is one scan with a top-k, and a filter of conversations is a semi
join before it. Only re-ranking for diversity is sequential; it gets CANDIDATES rows a query at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from threadmill.functions.scalars import parse_timestamp
from threadmill.operators import fulltext
from threadmill.operators.filters import at_least, intersect_or_all, minus
from threadmill.plans.tables import new_path
from threadmill.schema import Store

#: Rows that re-ranking looks at; a limit of the feature.
CANDIDATES = 1000
FIRST_MENTION = 0.65
#: Queries that are scored at once, and the bytes of queries that go to every task.
QUERY_BLOCK, QUERY_BYTES = 512, 64 << 20
#: Chunks that a block of queries is scored against at once.
CHUNK_BLOCK = 1024


def similar(chunks: DataFrame, query: list[float]) -> DataFrame:
    """RET-04, JON-16: chunks with `score`, the cosine to the query: a matrix product a batch. A vector of another length is an error; one without length has 0."""
    unit, d = _units(np.array([query], dtype=float))[0], len(query)

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        return pa.array(_matrix(vectors, d) @ unit)

    same = F.assert_true(F.coalesce(F.size("embedding"), F.lit(-1)) == d, F.concat(F.lit(f"the query has {d} dimensions, a chunk "), F.size("embedding")))
    return chunks.where(same.isNull()).withColumn("score", score("embedding"))


def _units(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1, size)


def _matrix(vectors: pa.Array, d: int) -> np.ndarray:
    """The vectors of a batch, each of length 1 or 0."""
    return _units(vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d))


def nearest(chunks: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK, most: int = QUERY_BYTES) -> DataFrame:
    """RET-04 for many queries (query, embedding): (query, chunk_id, score, place) of each one's k most similar chunks, ties by smaller chunk_id.

    Queries of up to `most` bytes in all go to every task, which scores the chunks that it reads, a block of queries and CHUNK_BLOCK chunks at a time, and keeps the best k of each
    query: chunks aren't shuffled, and what a task holds doesn't grow with the rows that Spark gives it at once. More queries than that meet the chunks in cells (cells.py)."""
    shape = queries.select(F.count("*"), F.max(F.size("embedding"))).first()
    n, d = shape[0], shape[1] or 0
    if 8 * n * d > most:
        from threadmill.operators import cells

        path = new_path(queries.sparkSession, "nearest")
        cells.write(chunks.select("chunk_id", "embedding"), path)
        kind = chunks.schema["chunk_id"].dataType.simpleString()
        return cells.search(cells.read(queries.sparkSession, path, kind), queries, k).drop("scored")
    asked = queries.select("query", "embedding").toArrow().combine_chunks()
    names = asked.column("query").combine_chunks()
    units = _matrix(asked.column("embedding").combine_chunks(), d) if n else np.zeros((0, d))
    sent = queries.sparkSession.sparkContext.broadcast((names, units))
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *chunks.schema]}
    chunk_type = to_arrow_type(chunks.schema["chunk_id"].dataType)
    same = F.assert_true(F.coalesce(F.size("embedding"), F.lit(-1)) == d, F.lit(f"the queries have {d} dimensions, a chunk has others"))
    found = chunks.where(same.isNull()).select("chunk_id", "embedding").mapInArrow(_best(sent, k, block, chunk_type), f"query {kinds['query']}, chunk_id {kinds['chunk_id']}, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("chunk_id")))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _best(sent: Broadcast, k: int, block: int, chunk_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (chunk_id, embedding) to rows (query, chunk_id, score): each query's k best of all of them. sent: the queries' names and unit vectors."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, units = sent.value
        d = units.shape[1]
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in (whole.slice(a, CHUNK_BLOCK) for whole in batches for a in range(0, len(whole), CHUNK_BLOCK)):
            ids = np.array(batch.column(0).to_pylist())
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], _matrix(batch.column(1), d)[order]
            for first in range(0, len(units), block):
                score = units[first : first + block] @ vectors.T
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                score, own = np.take_along_axis(score, top, axis=1), ids[top]
                if first in held:
                    score, own = np.concatenate((held[first][0], score), axis=1), np.concatenate((held[first][1], own), axis=1)
                    top = np.lexsort((own, -score), axis=1)[:, :k]
                    score, own = np.take_along_axis(score, top, axis=1), np.take_along_axis(own, top, axis=1)
                held[first] = score, own
        for first, (score, own) in held.items():
            of = np.repeat(np.arange(first, first + len(score)), score.shape[1])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), pa.array(own.ravel().tolist(), chunk_type), pa.array(score.ravel())], ["query", "chunk_id", "score"])

    return best


def top_k(chunks: DataFrame, query: list[float], k: int, ids: DataFrame | None = None) -> DataFrame:
    """RET-04, SRT-03: the k most similar chunks, ties by smaller chunk_id; of the given conversations only."""
    if ids is not None:
        chunks = chunks.join(ids.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
    return similar(chunks, query).orderBy(F.desc("score"), F.asc("chunk_id")).limit(k)


def recency_weight(ts: Column, as_of: Column, half_life_days: float = 30.0, max_boost: float = 1.15) -> Column:
    """RET-05: max_boost today, half of the boost after half_life_days, 1 in the limit and for times that can't be read."""
    if max_boost <= 1:
        return F.lit(1.0)
    days = (F.unix_micros(as_of) - F.unix_micros(parse_timestamp(ts))) / 86_400e6
    days = F.when(days < 0, 0.0).otherwise(days)
    return F.coalesce(1 + (max_boost - 1) * F.exp(-F.log(F.lit(2.0)) * days / half_life_days), F.lit(1.0))


def with_recency(results: DataFrame, conversations: DataFrame, as_of: Column, half_life_days: float = 30.0, max_boost: float = 1.15) -> DataFrame:
    """RET-05: scores by age; embedding_sim keeps the similarity, recency_boost the weight."""
    rows = results.join(conversations.select(F.col("id").alias("conversation_id"), "started_at"), "conversation_id", "left")
    weight = recency_weight(F.col("started_at"), as_of, half_life_days, max_boost)
    return rows.withColumns({"embedding_sim": F.col("score"), "recency_boost": weight}).withColumn("score", F.col("score") * F.col("recency_boost")).drop("started_at")


def mmr(results: DataFrame, limit: int = 10, lambda_: float = 0.7, query: str = "query") -> DataFrame:
    """RET-06, WIN-09: of each query's results (query, chunk_id, conversation_id, embedding, score) the diverse ones, with mmr_rank and mmr_penalty.

    Each step takes the largest lambda * score - (1 - lambda) * penalty; the penalty is 1 for a conversation taken before, else the largest
    cosine to what was taken, 0 at least and at first. Ties go to the larger chunk_id. score stays as it is."""
    kept = [f for f in results.schema.fields if f.name != "embedding"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", mmr_rank int, mmr_penalty double"

    def rank(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk_id", ascending=False, kind="stable").reset_index(drop=True)
        vectors = np.stack([np.asarray(v, dtype=float) for v in frame["embedding"]])
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = vectors / np.where(size == 0, 1, size)
        group = pd.factorize(frame["conversation_id"])[0]
        score, near, taken = frame["score"].to_numpy(float), np.zeros(len(frame)), np.zeros(group.max() + 1, dtype=bool)
        free, picks, penalties = np.ones(len(frame), dtype=bool), [], []
        for _ in range(min(limit, len(frame))):
            penalty = np.where(taken[group], 1.0, near)
            value = np.where(free, lambda_ * score - (1 - lambda_) * penalty, -np.inf)
            best = int(np.argmax(value))  # the first of equals: the largest chunk_id
            picks.append(best)
            penalties.append(penalty[best])
            free[best], taken[group[best]] = False, True
            near = np.maximum(near, vectors @ vectors[best])
        out = frame.iloc[picks].drop(columns="embedding")
        return out.assign(mmr_rank=np.arange(1, len(picks) + 1), mmr_penalty=penalties)

    return results.groupBy(query).applyInPandas(rank, schema)


def conversation_scores(results: DataFrame, limit: int = 10) -> DataFrame:
    """RET-10, AGG-21: by conversation: best and mean score, chunks, and the first 500 characters of the best."""
    best = F.max_by("text", F.struct("score", "chunk_id"))
    rows = results.groupBy("conversation_id").agg(F.max("score").alias("max_score"), F.avg("score").alias("mean_score"), F.count("*").alias("chunks"), F.substring(best, 1, 500).alias("excerpt"))
    return rows.orderBy(F.desc("max_score"), "conversation_id").limit(limit)


def threads(results: DataFrame) -> DataFrame:
    """RET-11, SRT-07: results with tier 1 where the conversation's best score is above the mean of all conversations' best, else 2."""
    best = results.groupBy("conversation_id").agg(F.max("score").alias("max_score"))
    mean = best.agg(F.avg("max_score").alias("mean"))
    return results.join(best.crossJoin(F.broadcast(mean)).select("conversation_id", "max_score", F.when(F.col("max_score") > F.col("mean"), 1).otherwise(2).alias("tier")), "conversation_id")


def in_thread_order(threaded: DataFrame) -> DataFrame:
    """SRT-07: tier 1 by time, tier 2 by score. threaded has started_at."""
    return threaded.orderBy("tier", F.when(F.col("tier") == 1, F.col("started_at")), F.when(F.col("tier") == 2, -F.col("score")), "chunk_id")


def by_time(results: DataFrame) -> DataFrame:
    """SRT-06."""
    return results.orderBy("started_at", "chunk_id")


def first_mention(results: DataFrame, store: Store, threshold: float = FIRST_MENTION) -> DataFrame:
    """RET-09, WIN-06: the earliest result from this score on: by its earliest prompt, its conversation's start where no prompt is known."""
    above = at_least(results, threshold)
    times = store["prompts"].select(F.col("id").alias("prompt_id"), "timestamp")
    prompts = above.select("chunk_id", F.explode("source_ids").alias("prompt_id")).join(times, "prompt_id").where("timestamp <> ''").groupBy("chunk_id").agg(F.min("timestamp").alias("first"))
    rows = above.join(prompts, "chunk_id", "left").join(store["conversations"].select(F.col("id").alias("conversation_id"), "started_at"), "conversation_id", "left")
    return rows.withColumn("mentioned_at", F.coalesce("first", "started_at", F.lit(""))).drop("first", "started_at").orderBy("mentioned_at", "chunk_id").limit(1)


def exchanges_behind(results: DataFrame, exchanges: DataFrame) -> DataFrame:
    """RET-12: the exchanges that each result stands for; the chunk's own text where it names none."""
    sources = results.select("chunk_id", "text", F.explode_outer("source_ids").alias("prompt_id"))
    rows = sources.join(exchanges.select("prompt_id", "timestamp", "prompt_text", "response_text"), "prompt_id", "left")
    return rows.select("chunk_id", "prompt_id", "timestamp", F.when(F.col("prompt_id").isNull(), F.col("text")).otherwise(F.col("prompt_text")).alias("prompt_text"), "response_text")


def enriched(results: DataFrame, store: Store) -> DataFrame:
    """JON-12: results with the conversation's start and workspace."""
    rows = store["conversations"].select(F.col("id").alias("conversation_id"), "started_at", "workspace_id").join(store["workspaces"].select(F.col("id").alias("workspace_id"), F.col("path").alias("workspace")), "workspace_id", "left").drop("workspace_id")
    return results.join(rows, "conversation_id", "left")


def explained(results: DataFrame, lambda_: float = 0.7) -> DataFrame:
    """RET-15, FN-29: results with `breakdown`, a JSON of how the score came about, to four places."""
    four = lambda c: F.round(c, 4)
    final = lambda_ * F.col("score") - (1 - lambda_) * F.col("mmr_penalty")
    parts = F.struct(four(F.col("embedding_sim")).alias("embedding_sim"), four(F.col("recency_boost")).alias("recency_boost"), four(F.col("score")).alias("pre_mmr_score"), four(F.col("mmr_penalty")).alias("mmr_penalty"), F.col("mmr_rank"), four(final).alias("final_score"))
    return results.withColumn("breakdown", F.to_json(parts))


def widened(limit: int, thread: bool = False, by_conversation: bool = False, diverse: bool = True) -> int:
    """SRT-11: how many chunks to score for a limit."""
    n = max(limit, 40) if thread else max(10 * limit, 100) if by_conversation else limit
    return min(3 * n, CANDIDATES) if diverse else n


def hybrid(store: Store, query: str, embed: Callable[[str], list[float]], as_of: Column, index: fulltext.Index | None = None, candidates: DataFrame | None = None, live: DataFrame | None = None, limit: int = 10, recall_limit: int = 80, lambda_: float = 0.7, diverse: bool = True, recency: bool = True) -> DataFrame:
    """RET-07: candidates by metadata, less live conversations, met with full-text recall; similarity, recency, diversity; enriched."""
    ids = candidates
    if live is not None:
        ids = minus(ids if ids is not None else store["chunks"].select(F.col("conversation_id").alias("id")), live)
    if index is not None:
        found = fulltext.recall(index, query, recall_limit).select("id")
        ids = intersect_or_all(found, ids if ids is not None else store["chunks"].select(F.col("conversation_id").alias("id")))
    chunks = store["chunks"].withColumnRenamed("id", "chunk_id")  # nothing to rename where it has that name already
    results = top_k(chunks, embed(query), widened(limit, diverse=diverse), ids)
    if recency:
        results = with_recency(results, store["conversations"], as_of)
    else:
        results = results.withColumns({"embedding_sim": F.col("score"), "recency_boost": F.lit(1.0)})
    if diverse:
        results = mmr(results.withColumn("query", F.lit(query)), limit, lambda_).drop("query")
        return enriched(results, store).orderBy("mmr_rank")
    return enriched(results.drop("embedding"), store).orderBy(F.desc("score"), "chunk_id").limit(limit)


def hashed_vector(text: str, dimension: int = 64) -> list[float]:
    """EXT-02: a vector that needs no model: words hashed to signed places. Any function of a text can stand in for it."""
    import re

    import xxhash

    out = np.zeros(dimension)
    for word in re.findall(r"\w+", text.lower()):
        h = xxhash.xxh64_intdigest(word)
        out[h % dimension] += 1 if h >> 63 else -1
    return out.tolist()
