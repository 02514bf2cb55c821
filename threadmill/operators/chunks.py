"""Chunks for the vector index: windows of exchanges bounded in tokens, kept up to date.

Conversations are spread over the cluster; a conversation's exchanges pass its task in order, sorted by Spark, and no more than the open window of them is held, so a
conversation of any length takes constant memory. Vectors are made batch by batch by a
function that is loaded once per worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.functions.scalars import stable_id
from threadmill.operators.filters import minus

TARGET, MOST, OVERLAP = 256, 512, 25
BATCH = 64
#: Chunks that go back to Spark at once.
OUT_ROWS = 1000
SCHEMA = "conversation_id string, chunk_no int, chunk_type string, text string, token_count int, source_ids array<string>"
_WORD = re.compile(r"\w+|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")

Counter = Callable[[str], int]


def count_words(text: str) -> int:
    """FN-23: the stand-in for a model's tokenizer: words and single marks."""
    return len(_WORD.findall(text))


def _packed(parts: list[str], count: Counter, target: int, overlap: int) -> Iterator[list[str]]:
    """Runs of parts of about target tokens; each begins with the last parts of the one before that fit in overlap."""
    run: list[tuple[str, int]] = []
    for part in parts:
        n = count(part)
        if run and sum(k for _, k in run) + n > target:
            yield [p for p, _ in run]
            tail, held = [], 0
            while run and held + run[-1][1] <= overlap:
                held += run[-1][1]
                tail.insert(0, run.pop())
            run = tail
        run.append((part, n))
    if run:
        yield [p for p, _ in run]


def split_text(text: str, count: Counter = count_words, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """RET-19: a text of target tokens or fewer as it is; a longer one by sentences, those of more than `most` tokens by words."""
    text = text.strip()
    if not text or count(text) <= target:
        return [text] if text else []
    out: list[str] = []
    held: list[str] = []
    for sentence in (s.strip() for s in _SENTENCE.split(text)):
        if sentence and count(sentence) > most:
            out += [" ".join(r) for r in _packed(held, count, target, overlap)] + [" ".join(r) for r in _packed(sentence.split(), count, target, overlap)]
            held = []
        elif sentence:
            held.append(sentence)
    return out + [" ".join(r) for r in _packed(held, count, target, overlap)]


def windows(exchanges: Iterable[tuple[str, str]], count: Counter = count_words, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> Iterator[tuple[str, list[str]]]:
    """RET-18: (text, prompt ids) of runs of exchanges (prompt id, text) of about target tokens; an exchange of more than `most` is cut on its own."""
    held: list[tuple[str, str]] = []
    size = 0

    def joined() -> tuple[str, list[str]]:
        return "\n\n".join(t for _, t in held), [p for p, _ in held]

    for prompt, text in exchanges:
        n = count(text)
        if held and (n > most or size + n > target):
            yield joined()
            held, size = [], 0
        if n > most:
            yield from ((part, [prompt]) for part in split_text(text, count, target, most, overlap))
        else:
            held.append((prompt, text))
            size += n
    if held:
        yield joined()


def chunk_exchanges(exchanges: DataFrame, count: Counter = count_words, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """RET-18: SCHEMA, from conversation_id, prompt_id, timestamp, text."""

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for f in frames for r in zip(f["conversation_id"], f["prompt_id"], f["text"], strict=True))
        out: list[tuple] = []
        for conversation, own in groupby(rows, key=lambda r: r[0]):
            for k, (text, ids) in enumerate(windows(((p, t) for _, p, t in own), count, target, most, overlap)):
                out.append((conversation, k, "exchange", text, count(text), ids))
                if len(out) == OUT_ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)

    order = ["conversation_id", "timestamp", "prompt_id"]
    return exchanges.select(*order, "text").repartition("conversation_id").sortWithinPartitions(*order).select("conversation_id", "prompt_id", "text").mapInPandas(cut, SCHEMA)


def embedded(chunks: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], created_at: str) -> DataFrame:
    """RET-20, SNK-03: chunks with id and embedding. load() is called once in each task and returns the model."""

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            texts = frame["text"].tolist()
            vectors = [v for k in range(0, len(texts), BATCH) for v in model(texts[k : k + BATCH])]
            yield frame.assign(embedding=vectors)

    made = chunks.mapInPandas(embed, SCHEMA + ", embedding array<float>")
    return made.select(stable_id(F.col("conversation_id"), F.col("chunk_no")).alias("id"), "conversation_id", "chunk_type", "text", "embedding", "token_count", "source_ids", F.lit(created_at).alias("created_at"))


def unindexed(exchanges: DataFrame, chunks: DataFrame) -> DataFrame:
    """RET-20: exchanges of conversations that no chunk is of."""
    return exchanges.join(chunks.select("conversation_id"), "conversation_id", "left_anti")


def without_orphans(chunks: DataFrame, conversations: DataFrame) -> DataFrame:
    """DML-09, JON-15, SET-03: chunks whose conversation exists."""
    return chunks.join(conversations.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")


def stale_conversations(conversations: DataFrame, chunks: DataFrame) -> DataFrame:
    """SET-04: ids of conversations without a chunk."""
    return minus(conversations, chunks.select(F.col("conversation_id").alias("id")))


META = {"schema_version": "1", "strategy": "exchange-window", "target_tokens": str(TARGET), "max_tokens": str(MOST), "overlap_tokens": str(OVERLAP)}


def index_meta(spark, backend: str, model: str, dimension: int, built_at: str) -> DataFrame:
    """SNK-08: what an index was made with: (key, value)."""
    rows = META | {"backend": backend, "model": model, "dimension": str(dimension), "built_at": built_at}
    return spark.createDataFrame(sorted(rows.items()), "key string, value string")


def incompatible(metas: DataFrame, backend: str, model: str, dimension: int) -> DataFrame:
    """RET-21, CHK-04: of many indexes' metas (index, key, value) those that differ: index, and of schema, backend, model and dimension the first that does, was and now."""
    wanted = [("schema_version", META["schema_version"]), ("backend", backend), ("model", model), ("dimension", str(dimension))]
    place = F.array_position(F.array(*(F.lit(k) for k, _ in wanted)), F.col("key"))
    now = F.element_at(F.create_map(*(F.lit(x) for pair in wanted for x in pair)), F.col("key"))
    differing = metas.where(F.col("key").isin([k for k, _ in wanted])).withColumn("now", now).where(F.col("value") != F.col("now"))
    return differing.groupBy("index").agg(F.min_by(F.struct("key", F.col("value").alias("was"), "now"), place).alias("x")).select("index", "x.*")


def check_compatible(meta: dict[str, str], backend: str, model: str, dimension: int) -> None:
    """RET-21, CHK-04: an error for the first of schema, backend, model, dimension that differs; what an index doesn't say is no difference."""
    for key, now in (("schema_version", META["schema_version"]), ("backend", backend), ("model", model), ("dimension", str(dimension))):
        if (was := meta.get(key)) is not None and str(was) != str(now):
            raise ValueError(f"the index was built with {key} {was}, not {now}; build it anew")
