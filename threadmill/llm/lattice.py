"""LM scoring by subword lattices: a text's probability is the sum over all its segmentations into pieces.

The pieces are an existing vocabulary. A unigram model gives each a probability: its start is Zipf's law over the vocabulary's own
order of scores, then rounds of expectation-maximisation over the training texts' words, until one gains less than TOLERANCE. No piece crosses white space, so a
text's lattice falls apart into those of its words, and these into parts between characters that no piece has side by side (cuts.py). Each distinct word's
lattice is run once: a forward recursion in log space, over all parts of a batch of one length together. A part of more than WIDE characters is run alone,
character by character, with a scale that keeps its numbers finite. Both take time in proportion to the characters, whatever the words' lengths. A text's score is
the sum of its words' log10 marginal probabilities, and that of the end, which is a piece of its own.

Scale: words are counted over all texts, pre-aggregated in each task. What EM gathers are expected counts per piece, as many as the vocabulary has at
most. Words that make up a share of COMMON or more of all tokens - at most 1 / COMMON, whatever the corpus - and have COMMON_BYTES or less go to every worker, by
their 128-bit hashes (so at most 1 / COMMON rows of 40 bytes);
the others of a text meet their counts in an equi-join on the word; by that definition no key is hot but a long word that very many texts have, which adaptive
execution can split, as the words are stored.

Base: add-one smoothed unigrams over words. Training texts: crc32(id as text) mod FOLDS is not HELD_OUT.
Null or empty text: one token, the end. A null id counts as the text ''. Rows equal in id and text get equal
scores, and each counts in training. An empty table gives an empty result; with nothing to learn from, V and N are 0 and the start's pieces stay.
A very long text or word is taken whole. Columns besides id and text are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.common import discard, materialize, mix64, plain, read
from threadmill.llm.cuts import Cuts

FOLDS, HELD_OUT = 7, 2
#: Share of all tokens from which on a word is common.
COMMON = 1e-6
#: Rounds of expectation-maximisation end with the one that raises the training words' log probability by less than this share, or after ROUNDS.
TOLERANCE, ROUNDS = 0.03, 8
#: Distinct words that a task counts before it passes the counts on.
TASK_WORDS = 300_000
COMMON_BYTES = 64
#: Words whose lattices are run together.
RUN_WORDS = 50_000
#: Characters beyond which a part is run alone.
WIDE = 64
SPACE = "▁"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SCALE = math.exp(230.0)


class Vocabulary:
    """The pieces of a SentencePiece file: ids by the hash of their code points, per length; byte pieces for other characters."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.end = sp.get_piece_size(), sp.eos_id()
        normal = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        names = [sp.id_to_piece(i) for i in range(self.size)]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.single = np.zeros(0x110000, dtype=bool)
        by_length: dict[int, list[int]] = {}
        for i in normal:
            by_length.setdefault(len(names[i]), []).append(i)
            if len(names[i]) == 1:
                self.single[ord(names[i])] = True
        self.cuts = Cuts([names[i] for i in normal])
        self.tables = {}
        for length, ids in sorted(by_length.items()):
            codes = np.array([[ord(c) for c in names[i]] for i in ids], dtype=np.uint64)
            h = codes[:, 0].copy()
            for k in range(1, length):
                h = h * _MULTIPLIER + codes[:, k]
            h, order = (x := mix64(h)), np.argsort(x)
            self.tables[length] = (h[order], np.array(ids)[order])
        # Zipf's law over the order of the vocabulary's scores; control pieces but the end have none.
        order = np.argsort([-sp.get_score(i) for i in normal], kind="stable")
        start = np.zeros(self.size)
        start[np.array(normal)[order]] = 1.0 / (np.arange(len(normal)) + 2)
        start[self.byte_ids] = 1.0 / (len(normal) + 2)
        start[self.end] = 1e-2
        self.start = np.log(np.maximum(start / start.sum(), 1e-300))
        self.scored = start > 0

    def find(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """codes: words x characters. By length, the piece from each place on, -1 where there is none."""
        n, width = codes.shape
        h, out = np.zeros((n, width), dtype=np.uint64), {}
        for length in range(1, min(width, max(self.tables)) + 1):
            part = codes[:, length - 1 :].astype(np.uint64)
            h = part if length == 1 else h[:, : width - length + 1] * _MULTIPLIER + part
            if length in self.tables:
                keys, ids = self.tables[length]
                mixed = mix64(h)
                at = np.minimum(np.searchsorted(keys, mixed), len(keys) - 1)
                out[length] = np.where(keys[at] == mixed, ids[at], -1)
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


class Parts:
    """The words' parts, a space before each word: the distinct ones by length."""

    def __init__(self, words: list[str], cuts: Cuts):
        text = "".join(SPACE + w for w in words).encode("utf-32-le")
        self.codes = np.frombuffer(text, dtype=np.uint32)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        opens = cuts.before(self.codes) if len(words) else np.zeros(0, dtype=bool)
        opens[np.cumsum(sizes) - sizes] = True
        self.starts = np.flatnonzero(opens)
        self.sizes = np.diff(np.append(self.starts, len(self.codes)))
        self.word = np.searchsorted(np.cumsum(sizes), self.starts, side="right")

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(codes of distinct parts of one length, the places of all parts that they are, which of them each is)."""
        order = np.argsort(self.sizes, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(self.sizes[order])) + 1) if len(order) else ():
            length = int(self.sizes[at[0]])
            step = max(1, (1 << 18) // length)
            rows = self.codes[self.starts[at][:, None] + np.arange(length)] if length <= WIDE else None
            if rows is None:  # long and rare: one by one
                for k in at.tolist():
                    yield self.codes[self.starts[k] : self.starts[k] + length][None, :], np.array([k]), np.zeros(1, dtype=np.int64)
                continue
            h = rows[:, 0].astype(np.uint64)
            for k in range(1, length):
                h = mix64(h * _MULTIPLIER + rows[:, k])
            _, first, which = np.unique(h, return_index=True, return_inverse=True)
            if (rows[first][which] != rows).any():  # two parts of one hash
                first, which = np.arange(len(rows)), np.arange(len(rows))
            by_part = np.argsort(which, kind="stable")
            ends = np.searchsorted(which[by_part], np.arange(step, len(first) + step, step), side="left")
            for k, part in enumerate(np.split(by_part, ends[:-1])):
                yield rows[first[k * step : (k + 1) * step]], at[part], which[part] - k * step


class Lattices:
    def __init__(self, vocabulary: Vocabulary, logp: np.ndarray):
        self.v, self.logp = vocabulary, np.append(logp, -np.inf)  # place -1: no piece

    def _byte_scores(self, codes: np.ndarray) -> np.ndarray:
        """Of characters without a piece the sum of their bytes' scores; no way for others."""
        out = np.full(codes.shape, -np.inf)
        if len(at := np.flatnonzero(~self.v.single[codes].ravel())):
            chars, which = np.unique(codes.ravel()[at], return_inverse=True)
            out.ravel()[at] = np.array([sum(self.logp[self.v.byte_ids[b]] for b in chr(c).encode("utf-8", "surrogatepass")) for c in chars])[which]
        return out

    def _forward(self, scores: dict[int, np.ndarray], raw: np.ndarray) -> np.ndarray:
        n, width = raw.shape
        if width > WIDE:
            return np.stack([self._along({k: s[i] for k, s in scores.items()}, raw[i]) for i in range(n)], axis=1)
        a = np.full((width + 1, n), -np.inf)
        a[0] = 0
        for end in range(1, width + 1):
            ways = [a[end - 1] + raw[:, end - 1]] + [a[end - k] + s[:, end - k] for k, s in scores.items() if k <= end]
            ways = np.array(ways)
            top = ways.max(axis=0)
            a[end] = top + np.log(np.exp(ways - top).sum(axis=0))
        return a

    @staticmethod
    def _along(scores: dict[int, np.ndarray], raw: np.ndarray) -> np.ndarray:
        """The recursion over one long part: plain numbers, scaled back whenever they have become small."""
        width, longest = len(raw), max([1, *scores])
        ends, lengths, ways = [], [], []
        for k, s in [(1, raw), *scores.items()]:
            at = np.flatnonzero(np.isfinite(s))
            ends.append(at + k)
            lengths.append(np.full(len(at), k))
            ways.append(np.exp(s[at]))
        ends, lengths, ways = (np.concatenate(x) for x in (ends, lengths, ways))
        order = np.argsort(ends, kind="stable")
        steps = np.searchsorted(ends[order], np.arange(width + 2)).tolist()
        lengths, ways = lengths[order].tolist(), ways[order].tolist()
        a, scale, log_scale = [0.0] * (width + 1), np.zeros(width + 1), 0.0
        a[0] = 1.0
        for end in range(1, width + 1):
            total = 0.0
            for k in range(steps[end], steps[end + 1]):
                total += a[end - lengths[k]] * ways[k]
            a[end] = total
            if total < 1e-100:
                # What the recursion can still reach is scaled; the places before keep the scale they had.
                log_scale -= 230.0
                low = max(0, end - longest)
                scale[low : end + 1] = log_scale
                for k in range(low, end + 1):
                    a[k] *= _SCALE
            else:
                scale[end] = log_scale
        with np.errstate(divide="ignore"):
            return np.log(np.array(a)) + scale

    def marginals(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability, over all its segmentations."""
        parts = Parts(words, self.v.cuts)
        found = np.zeros(len(parts.sizes))
        for codes, at, which in parts.groups():
            scores = {k: self.logp[p] for k, p in self.v.find(codes).items()}
            found[at] = self._forward(scores, self._byte_scores(codes))[-1][which]
        return np.bincount(parts.word, weights=found, minlength=len(words))

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, the words counted as often as given; last, the log probability of all of them."""
        out, likelihood = np.zeros(self.v.size), 0.0
        parts = Parts(words, self.v.cuts)
        for codes, at, which in parts.groups():
            times = np.bincount(which, weights=counts[parts.word[at]], minlength=len(codes))
            pieces = self.v.find(codes)
            scores = {k: self.logp[p] for k, p in pieces.items()}
            raw = self._byte_scores(codes)
            a = self._forward(scores, raw)
            # The same from the other end.
            b = self._forward({k: s[:, ::-1] for k, s in scores.items()}, raw[:, ::-1])[::-1]
            weight = np.log(times) - a[-1]
            likelihood += float(times @ a[-1])
            for k, p in pieces.items():
                used = np.flatnonzero(p.ravel() >= 0)
                i, j = np.divmod(used, p.shape[1])
                share = np.exp(a[j, i] + scores[k][i, j] + b[j + k, i] + weight[i])
                out += np.bincount(p[i, j], weights=share, minlength=self.v.size)
            i, j = np.nonzero(np.isfinite(raw))
            if len(i):
                share = np.exp(a[j, i] + raw[i, j] + b[j + 1, i] + weight[i])
                chars, one = np.unique(codes[i, j], return_inverse=True)
                for char, uses in zip(chars.tolist(), np.bincount(one, weights=share).tolist(), strict=True):
                    for byte in chr(char).encode("utf-8", "surrogatepass"):
                        out[self.v.byte_ids[byte]] += uses
        return np.append(out, likelihood)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches, put together to RUN_WORDS rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= RUN_WORDS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _tokens(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(training, text) to (word, times in training texts, times in all)."""

    def flush() -> pa.RecordBatch:
        words = list(both[0].keys() | both[1].keys())
        train, rest = (np.array([c[w] for w in words], dtype=np.int64) for c in both)
        for c in both:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(train, pa.int64()), pa.array(train + rest, pa.int64())], ["word", "c", "n"])

    both: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for learn, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            both[0 if learn else 1].update(_tokens(text.as_py()))
            if len(both[0]) + len(both[1]) > TASK_WORDS:
                yield flush()
    yield flush()


def held_out(id_column: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def train(words: DataFrame, ends: int, path: str, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Log probabilities of the pieces. words: word, c; ends: the end's count. Rounds go on until one has raised the training words' log probability by less than the tolerance, or there were `rounds`."""
    vocabulary, spark = load(path), words.sparkSession
    logp, before = vocabulary.start, -math.inf
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(logp)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattices, total = Lattices(load(path), shared.value), 0
            for run in _runs(batches):
                total = total + lattices.expected(run.column(0).to_pylist(), run.column(1).to_numpy())
            if not np.isscalar(total):
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["piece", "uses"])

        # As many rows as the vocabulary has pieces, at most.
        uses = words.where("c > 0").select("word", "c").mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        shared.unpersist()
        weight, likelihood = np.where(vocabulary.scored, 0.1, 0.0), ends * logp[vocabulary.end]
        for piece, n in uses:
            if piece == vocabulary.size:
                likelihood += n
            else:
                weight[piece] += n
        weight[vocabulary.end] += ends
        logp = np.where(weight > 0, np.log(np.maximum(weight, 1e-300)) - math.log(weight.sum()), vocabulary.start.min())
        if likelihood - before < tolerance * abs(likelihood):
            break
        before = likelihood
    return logp


class _Common(dict):
    """Places of common words, which a worker looks up by their 128-bit hashes once; -1 for others."""

    def __init__(self, table: "_Words"):
        self.table = table

    def __missing__(self, word: bytes) -> int:
        if len(self) > TASK_WORDS:
            self.clear()
        self[word] = place = self.table.place(word)
        return place


class _Words:
    """Common words, by their hashes in order, and known, base and score of each."""

    def __init__(self, hashes: np.ndarray, known: np.ndarray, scores: np.ndarray):
        order = np.lexsort((hashes[:, 1], hashes[:, 0]))
        self.high, self.low, self.known, self.scores = hashes[order, 0], hashes[order, 1], known[order], scores[:, order]

    def place(self, word: bytes) -> int:
        if len(word) > COMMON_BYTES:
            return -1
        high, low = _hash(word)
        at = int(np.searchsorted(self.high, np.uint64(high)))
        while at < len(self.high) and self.high[at] == high:
            if self.low[at] == low:
                return at
            at += 1
        return -1


def _hash(word: bytes) -> tuple[int, int]:
    return divmod(xxhash.xxh3_128_intdigest(word), 1 << 64)


def _scored(words: DataFrame, logp: np.ndarray, path: str) -> DataFrame:
    """words (word, c, n, base) and the log10 of each word's marginal probability."""
    shared = words.sparkSession.sparkContext.broadcast(logp)

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(load(path), shared.value)
        for run in _runs(batches):
            score = pa.array(lattices.marginals(run.column("word").to_pylist()) / math.log(10))
            yield from run.append_column("score", score).to_batches()

    out = materialize(words.mapInArrow(marginal, "word string, c bigint, n bigint, base double, score double"), "scored-words")
    shared.unpersist()
    return out


def score(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", rounds: int = ROUNDS, tolerance: float = TOLERANCE, common: float = COMMON) -> DataFrame:
    """A row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(plain(id_column)).alias("id"), F.col(plain(text)).alias("text"), held_out(F.col(plain(id_column))).alias("held_out"))
    counted = docs.select(~F.col("held_out"), "text").mapInArrow(_count_words, "word string, c bigint, n bigint")
    counts = materialize(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")
    tokens, all_tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    ends = docs.where(~F.col("held_out")).count()
    tokens, kinds = tokens + ends, kinds + (ends > 0)
    base = lambda c: math.log10((c + 1) / (tokens + kinds + 1))
    logp = train(counts, ends, path, rounds, tolerance)
    words = _scored(counts.select("word", "c", "n", F.log10((F.col("c") + 1) / F.lit(float(tokens + kinds + 1))).alias("base")), logp, path)
    discard(counts)
    # No more than 1 / common words can have this share, nor more than COMMON_BYTES each.
    least = max(1, math.ceil(common * all_tokens))
    is_common = (F.col("n") >= least) & (F.octet_length("word") <= COMMON_BYTES)
    rows = words.where(is_common).toArrow()
    hashes = np.array([_hash(w.encode()) for w in rows["word"].to_pylist()], dtype=np.uint64).reshape(-1, 2)
    table = spark.sparkContext.broadcast(_Words(hashes, rows["c"].to_numpy() > 0, np.stack([rows["base"].to_numpy(), rows["score"].to_numpy()])))

    @F.arrow_udf("struct<n_tokens:bigint,n_known:bigint,base:double,score:double,rare:array<struct<word:string,times:bigint>>>")
    def common_part(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shares, places = table.value, _Common(table.value)
        for texts in batches:
            n, known_n, sums, rare_words, rare_times, ends_at = [], [], [], [], [], [0]
            for text in texts:
                found = _tokens(text.as_py())
                at = np.fromiter(map(places.__getitem__, found), dtype=np.int64, count=len(found))
                here = at[at >= 0]
                n.append(len(found))
                known_n.append(int(shares.known[here].sum()))
                sums.append(shares.scores[:, here].sum(axis=1))
                left = Counter(map(found.__getitem__, np.flatnonzero(at < 0).tolist()))
                rare_words += left
                rare_times += left.values()
                ends_at.append(len(rare_words))
            base_sum, score_sum = np.array(sums).reshape(-1, 2).T if sums else np.zeros((2, 0))
            pairs = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()).cast(pa.string()), pa.array(rare_times, pa.int64())], ["word", "times"])
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(known_n, pa.int64()), pa.array(base_sum), pa.array(score_sum), pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pairs)], ["n_tokens", "n_known", "base", "score", "rare"])

    parts = materialize(docs.select("id", "held_out", F.xxhash64("text").alias("tie"), common_part("text").alias("s")).select("id", "held_out", "tie", "s.*"), "common-parts")
    table.unpersist()
    # The rare words of a text, whatever the number of rows that have it.
    rare = parts.where(F.size("rare") > 0).groupBy("id", "tie").agg(F.first("rare").alias("rare")).select("id", "tie", F.explode("rare").alias("r")).select("id", "tie", "r.word", "r.times")
    found = rare.join(words.where(~is_common).select("word", "c", "base", "score"), "word")
    sums = found.groupBy("id", "tie").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.col("base")).alias("more_base"), F.sum(F.col("times") * F.col("score")).alias("more_score"))
    sums = sums.select(F.col("id").alias("id2"), F.col("tie").alias("tie2"), "more_known", "more_base", "more_score")
    done = parts.join(sums, parts["id"].eqNullSafe(sums["id2"]) & (parts["tie"] == sums["tie2"]), "left")
    end_base, end_score = base(ends), float(logp[load(path).end] / math.log(10))
    zero = F.lit(0)
    return done.select(
        F.col("id").alias(id_column),
        "held_out",
        (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.col("n_known") + F.coalesce("more_known", zero) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) + F.lit(end_base)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero) + F.lit(end_score)).alias("score"),
    )


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op10_lattice_lm": op10_lattice_lm}
ORACLE_SQL: dict[str, str] = {}
