"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no piece of the vocabulary can cross: before a run of spaces, around line feeds, and inside the
resulting words between characters that no piece has side by side (cuts.py). The distinct words of a batch become one flat numpy array of symbols. In each round every part
of a word
takes the smallest rank among its adjacent pairs, and all words at once merge that pair, from the left and
not overlapping; the array is compacted, and parts without a pair leave. A part merges several places of
a rank in one round only as far as no merge makes a pair of that rank or a better one, so the result is that
of merging one best, leftmost pair after another. Characters without a piece become byte pieces.
The vocabulary is an existing file, read once per Python worker; nothing is trained. Words met before are
kept in a table of bounded size. Memory follows the batch and the longest text; there is no shuffle. Rounds follow the longest part, not the
longest word, so a megabyte of Chinese or base64 without a space costs about what ordinary text does; only a long run inside which all neighbours fit together,
as of one letter, needs more.

Null or empty text: no pieces but the end id. A null list of ids decodes to null. Repeated rows get equal
results; other columns pass through; a column named like the result is replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.common import plain, read
from threadmill.llm.cuts import Cuts, Table

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Bytes of text that are encoded at once; a longer text stands alone.
SLICE_BYTES = 1 << 20
#: Words kept per worker; beyond it the table starts anew.
TABLE_WORDS = 250_000


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    lengths, starts = lengths[lengths > 0], starts[lengths > 0]
    steps = np.ones(total, dtype=np.int64)
    ends = np.cumsum(lengths)
    steps[0] = starts[0]
    steps[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(steps)


class Pieces:
    """A SentencePiece BPE vocabulary with byte pieces, no normalisation and a leading space."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = sp.get_piece_size()
        self.end = sp.eos_id()
        names = [sp.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {names[i]: i for i in normal}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)

        # Characters: their piece, or beyond the vocabulary's size for those without.
        self.symbol = np.arange(0x110000, dtype=np.int32) + size
        for name, i in ids.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        # Pairs: every cut of a piece into two pieces. Equal scores have equal ranks.
        scores = sorted({sp.get_score(i) for i in normal}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        pairs = [((ids[n[:k]] << 22) + ids[n[k:]], i, rank[sp.get_score(i)]) for n, i in ids.items() for k in range(1, len(n)) if n[:k] in ids and n[k:] in ids]
        keys, *values = zip(*pairs, strict=True)
        self.pairs = Table(np.array(keys, dtype=np.int64))
        self.pair_ids, self.pair_ranks = np.array([*values[0], 0], dtype=np.int32), np.array([*values[1], NONE], dtype=np.int32)
        self.cuts = Cuts(list(ids))
        # Words: no piece may hold a space after another character, nor a line feed beside others.
        if any(SPACE in n.lstrip(SPACE) for n in ids):
            raise ValueError("a piece holds a space inside: words can't be cut at spaces")
        feed = not any("\n" in n for n in ids)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+" if feed else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

        self._reset()
        # For decoding: what each piece adds, spaces restored.
        surface = [b"" if sp.is_control(i) else sp.decode([i]).encode() if sp.is_unknown(i) else bytes([int(n[3:5], 16)]) if sp.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.surface_len = np.array([len(x) for x in surface], dtype=np.int64)
        self.surface_at = np.concatenate(([0], np.cumsum(self.surface_len)))[:-1]
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.is_byte = np.array([bool(sp.is_byte(i)) for i in range(size)])
        self.opens = np.array([n.startswith(SPACE) and not sp.is_byte(i) and not sp.is_control(i) for i, n in enumerate(names)])

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.lengths, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.int32), 0

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of adjacent symbols; rank NONE where they don't merge."""
        keys = left.astype(np.int64) * np.int64(1 << 22) + right
        at = self.pairs.find(keys)
        return self.pair_ranks[at], self.pair_ids[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in one array, and how many each has."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        symbols = self.symbol[codes]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        # Parts of words that no piece can cross merge on their own, so a long word needs no more rounds than its longest part.
        opens = self.cuts.before(codes)
        opens[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        word_of = np.repeat(np.arange(len(words)), sizes)[opens]
        word = np.cumsum(opens) - 1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            same = word[:-1] == word[1:]
            rank = np.full(len(symbols), NONE, dtype=np.int32)
            merged = np.zeros(len(symbols), dtype=np.int32)
            rank[:-1], merged[:-1] = self._pairs(symbols[:-1], symbols[1:])
            rank[:-1][~same] = NONE
            first = np.concatenate(([0], np.flatnonzero(~same) + 1))
            count = np.diff(np.append(first, len(symbols)))
            best = np.repeat(np.minimum.reduceat(rank, first), count)
            over = best == NONE
            if over.any():
                done.append((symbols[over], word[over]))
                symbols, word, rank, merged, best = symbols[~over], word[~over], rank[~over], merged[~over], best[~over]
                if not len(symbols):
                    break
            # From the left, not overlapping: every second one of a run of neighbours.
            at = np.flatnonzero(rank == best)
            opens = np.concatenate(([True], np.diff(at) > 1))
            run = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            # A merge that makes a pair of this rank or a better one is the word's last in this round.
            before, after = at - 1, at + 2
            joined = np.concatenate(([False], np.diff(at) == 2))
            left = np.where(joined, merged[np.concatenate(([0], at[:-1]))], symbols[np.maximum(before, 0)])
            left_rank = np.where((before >= 0) & (word[np.maximum(before, 0)] == word[at]), self._pairs(left, merged[at])[0], NONE)
            after_in = np.minimum(after, len(symbols) - 1)
            right_rank = np.where((after < len(symbols)) & (word[after_in] == word[at]), self._pairs(merged[at], symbols[after_in])[0], NONE)
            last = np.minimum(left_rank, right_rank) <= best[at]
            if last.any():
                lasts = np.cumsum(last) - last  # before this one
                new = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
                base = np.maximum.accumulate(np.where(new, lasts, 0))
                at = at[lasts == base]
            symbols[at] = merged[at]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        symbols, word = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (symbols, word)
        order = np.argsort(word, kind="stable")
        symbols, word = symbols[order], word[order]
        if (unknown := symbols >= self.size).any():  # into the bytes of their UTF-8
            chars = [chr(c).encode() for c in symbols[unknown] - self.size]
            times = np.ones(len(symbols), dtype=np.int64)
            times[unknown] = [len(c) for c in chars]
            word = np.repeat(word, times)
            is_byte = np.repeat(unknown, times)
            symbols = np.repeat(symbols, times)
            symbols[is_byte] = self.byte_ids[np.frombuffer(b"".join(chars), dtype=np.uint8)]
        return symbols, np.bincount(word_of[word], minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        """Enter new words in the table."""
        ids, counts = self.merge(words)
        first, n = len(self.index), len(words)
        while first + n > len(self.starts):
            self.starts, self.lengths = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lengths))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[first : first + n] = counts
        self.starts[first : first + n] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.index.update(zip(words, range(first, first + n), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, the end id after each, and how many each text has."""
        if len(self.index) > TABLE_WORDS or self.used > 16 * TABLE_WORDS:
            self._reset()
        cuts = [self.cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if new := list(set(chain.from_iterable(cuts)).difference(self.index)):
            self._learn(new)
        index = self.index
        words = np.fromiter(map(index.__getitem__, chain.from_iterable(cuts)), dtype=np.int64)
        per = np.fromiter(map(len, cuts), dtype=np.int64, count=len(cuts))
        lengths = self.lengths[words]
        total = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(per)]
        counts = np.diff(total, prepend=0) + 1
        out = np.empty(int(counts.sum()), dtype=np.int32)
        ends = np.cumsum(counts) - 1
        inner = np.ones(len(out), dtype=bool)
        inner[ends] = False
        out[inner] = self.flat[_ragged(self.starts[words], lengths)]
        out[ends] = self.end
        return out, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each list of ids. Bytes that are no UTF-8 become U+FFFD, one each."""
        lengths, starts = self.surface_len[ids].copy(), self.surface_at[ids].copy()
        total = np.concatenate(([0], np.cumsum(lengths)))
        ends = np.cumsum(counts)
        # The first piece that adds anything loses its leading space.
        first = np.searchsorted(total, total[ends - counts], side="right") - 1
        first = first[(first < ends) & (counts > 0)]
        first = first[self.opens[ids[first]]]
        starts[first] += 1
        lengths[first] -= 1
        total = np.concatenate(([0], np.cumsum(lengths)))
        data = self.surface[_ragged(starts, lengths)].tobytes()
        cuts = total[ends].tolist()
        out, begin = [], 0
        for end in cuts:
            out.append(data[begin:end])
            begin = end
        # An id that adds nothing ends a run of byte pieces; at a text's end it doesn't matter.
        split = np.flatnonzero(self.is_byte[ids[:-1]] & (self.surface_len[ids[1:]] == 0))
        split = split[~np.isin(split + 2, ends)]
        try:
            data.decode()
            if not len(split) and all((x[0] & 0xC0) != 0x80 for x in out if x):
                return out
        except UnicodeDecodeError:
            pass
        return [self._valid(ids[e - c : e], lengths[e - c : e], x) for x, e, c in zip(out, ends, counts, strict=True)]

    def _valid(self, ids: np.ndarray, lengths: np.ndarray, data: bytes) -> bytes:
        out, at, run = [], 0, b""
        for i, n in zip(ids.tolist(), lengths.tolist(), strict=True):
            piece = data[at : at + n]
            at += n
            if self.is_byte[i]:
                run += piece
            else:
                out += [_bytes_to_text(run), piece]
                run = b""
        return b"".join([*out, _bytes_to_text(run)])


def _bytes_to_text(run: bytes) -> bytes:
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                run[at : at + n].decode()
                out.append(run[at : at + n])
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�".encode())
            n = 1
        at += n
    return b"".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def _slices(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows of about `most` in all."""
    group = (np.cumsum(lengths) - lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def encode_column(texts: pa.Array, path: str) -> pa.Array:
    pieces, parts, counts = load(path), [], []
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in _slices(sizes, SLICE_BYTES):
        ids, n = pieces.encode(texts[a:b].to_pylist())
        parts.append(ids)
        counts.append(n)
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def decode_column(lists: pa.Array, path: str) -> pa.Array:
    pieces, out = load(path), []
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in _slices(counts, SLICE_BYTES // 2):
        ids = lists[a:b].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        out += pieces.decode(ids, counts[a:b])
    return pa.array([x if ok else None for x, ok in zip(out, valid, strict=True)], pa.binary()).cast(pa.string())


def with_ids(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df and the ids of its texts, the end id last (array<int>)."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return encode_column(texts, path)

    return df.withColumn(out, encode(F.col(plain(text))))


def with_decoded(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df and the texts of its ids."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        return decode_column(lists, path)

    return df.withColumn(out, decode(F.col(ids)))


def with_round_trip(df: DataFrame, path: str, text: str = "text", out: str = "pieces") -> DataFrame:
    """df and a struct of ids and decoded: the texts encoded, and their ids decoded again, in one pass."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(texts: pa.Array) -> pa.Array:
        ids = encode_column(texts, path)
        return pa.StructArray.from_arrays([ids, decode_column(ids, path)], ["ids", "decoded"])

    return df.withColumn(out, both(F.col(plain(text))))


def digests(docs: DataFrame) -> DataFrame:
    """Of documents with text: doc_id, the number of ids, and the digests of ids and of the decoded text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    done = with_round_trip(docs.select("doc_id", "text"), path)
    return done.select(
        "doc_id",
        F.size("pieces.ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("pieces.ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("pieces.decoded", 256).alias("decoded_sha256"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
