"""Token ids in binary files with Elias-Fano encoded document boundaries.

Documents are range-partitioned and sorted by id, and each task encodes its own and writes files: the ids of all its documents one after another (two bytes each where
the vocabulary fits, else four), then the boundaries and the document ids as Elias-Fano sequences (eliasfano.py), then a footer. A file ends with the document that
brings it to FILE_IDS ids or FILE_DOCS documents, so what a task holds is bounded. Files come from Spark's tasks: a file that a lost or repeated task leaves behind is
named nowhere, as only the manifest, which Spark commits once, says which files there are and in which order. Offsets in the whole corpus are the file's place in
the manifest plus the boundary in it, so nothing grows but the manifest by a row a file. Files go through pyarrow.fs.

A text is cut at spaces, tabs and line ends, and between letters (ASCII and Latin-1) and other ASCII characters, where the vocabulary's pattern cuts it in any case; each
distinct word is encoded by the tokenizers library, many at a time, and kept in a table of bounded size. So the ids are the library's for the whole text. Words of these
letters alone, once lowered, are what normalizer and pattern would leave of them, so they go to the library's model with a space between them; others go through the whole
tokenizer with a special token between them. A slice with the name of an added token is cut at white space alone. A tokenizer of which `crosses` can't tell that this holds is an error.

Null or empty text: the end id alone. A null id sorts first. Rows of one id are in the order of their texts' hashes; rows that repeat are all written, and may be split
among files. A very long text is one document of whatever length, read and written whole. An empty table gives no files and an empty result. Only id and
text are written; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.llm.common import byte_chunks, materialize, new_path, plain, read
from threadmill.llm.eliasfano import EliasFano
from threadmill.llm.pieces import _ragged

#: A file is closed, and the next one begun, from so many ids or documents on.
FILE_IDS = 1 << 26
FILE_DOCS = 1 << 22
#: Bytes of text that are encoded at once, and ids that are read at once; a longer document stands alone.
SLICE_BYTES = 1 << 20
SLICE_IDS = 1 << 20
#: Short documents that are encoded at once.
SLICE_ROWS = 100_000
#: New words that are encoded at once.
LEARN_WORDS = 2000
#: Words, and their bytes and ids together, that a worker keeps; beyond it the half that was met most often stays.
TABLE_WORDS = 250_000
TABLE_SIZE = 32 * TABLE_WORDS
MAGIC = b"TMIDS001"
_FOOTER = struct.Struct("<QQQQB8s")  # ids, bytes of the boundaries, bytes of the document ids, null document ids, bytes an id, magic


def crosses(spec: dict) -> bool:
    """Whether a token might cross white space, as far as a tokenizer's file tells. False for: white space dropped by the pattern that cuts the text, no token added with white space."""
    steps = spec.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    dropped = steps[0].get("type") == "Split" and steps[0].get("invert") is True and steps[0].get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in steps[0].get("pattern", {}).get("Regex", "")
    added = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t["content"].split() != [t["content"]] for t in spec.get("added_tokens", []))
    known = {"NFC", "NFD", "Lowercase", "Replace"}
    rules = spec.get("normalizer") or {}
    return not dropped or added or not {r.get("type") for r in rules.get("normalizers", [rules])} <= known


#: The pattern that leaves a word of letters whole.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = re.compile("[a-zß-öø-ÿ]+")


def leaves_letters(spec: dict) -> bool:
    """Whether a word of _LETTERS reaches the model as it is, but for its bytes' names, and the model gives it one token with its end."""
    rules, steps, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
    # An end has a character that no byte of these letters is named like.
    ends = re.search(r"[!-@\[-`{-~]", model.get("end_of_word_suffix") or "") is not None
    rules, steps = rules.get("normalizers", [rules]), steps.get("pretokenizers", [steps])
    same = all(r.get("type") in ("NFC", "Lowercase") or r.get("type") == "Replace" and r["pattern"] == {"Regex": r"\s+"} for r in rules)
    cut = len(steps) == 2 and steps[0].get("pattern") == {"Regex": _PATTERN} and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex", True)
    return same and cut and model.get("type") == "BPE" and ends and not model.get("dropout") and not model.get("unk_token")


#: Bytes of ASCII letters, those that separate words, and the rest of ASCII without the apostrophe, which may belong to the letters after it.
_LETTER, _SPACE, _OTHER, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
_OTHER[:0x80] = ~(_LETTER | _SPACE)[:0x80]
_OTHER[0x27] = False
_LOWER[0x41:0x5B] += 32
#: Latin-1 letters are this byte and one of these, capitals one of the last.
_LATIN, _SECOND, _CAPITAL = 0xC3, np.zeros(256, bool), np.zeros(256, bool)
_SECOND[0x80:0xC0] = _CAPITAL[0x80:0x9F] = True
_SECOND[[0x97, 0xB7]] = _CAPITAL[0x97] = False


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that belong to letters, and the text with these in lower case, unless a mark may follow: h and a macron below are one character, H and that are two."""
    letter, lower = _LETTER[data], _LOWER[data]
    if len(latin := np.flatnonzero(data[:-1] == _LATIN)):
        latin = latin[_SECOND[data[latin + 1]]]
        letter[latin] = letter[latin + 1] = True
        lower[latin + 1] += np.where(_CAPITAL[data[latin + 1]], 32, 0).astype(np.uint8)
    # Marks that change the character before them begin at U+0300.
    before = np.flatnonzero(data[1:] > _LATIN)
    lower[before] = data[before]
    return letter, lower


class Encoder:
    """Ids of texts, an end id after each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        if crosses(spec):
            raise ValueError(f"texts can't be cut at white space for {path}")
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        added = spec.get("added_tokens", [])
        self.added = [t["content"].lower().encode() for t in added]
        lower = any(r.get("type") == "Lowercase" for r in (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer") or {}]))
        #: A token that stands between words when many are encoded at once, for a tokenizer that lowers letters.
        self.mark = next(((t["content"], t["id"]) for t in added if t["special"] and not t["normalized"]), None) if lower else None
        self.model = self._model() if self.mark and leaves_letters(spec) else None
        if self.model:
            self.is_end = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self.is_end[[i for name, i in spec["model"]["vocab"].items() if name.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.words = pa.array([], pa.large_binary())
        self.ids, self.starts, self.lengths, self.hits = np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in range(3))
        self.size = 0

    def _model(self):
        """The library's model behind a split at spaces, whose byte is named like this."""
        from tokenizers import Tokenizer, pre_tokenizers

        out = Tokenizer(self.tokenizer.model)
        out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), pre_tokenizers.CharDelimiterSplit("Ġ")])
        return out

    def _shrink(self) -> None:
        """Keep the words met most often, as long as these have half of the room."""
        sizes = pc.binary_length(self.words).to_numpy() + self.lengths
        order = np.argsort(-self.hits, kind="stable")[: TABLE_WORDS // 2]
        kept = np.sort(order[: np.searchsorted(np.cumsum(sizes[order]), TABLE_SIZE // 2)])
        self.ids = self.ids[_ragged(self.starts[kept], self.lengths[kept])]
        self.lengths, self.hits, self.size = self.lengths[kept], self.hits[kept] // 2, int(sizes[kept].sum())
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words = self.words.take(kept)

    def _encoded(self, words: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in one array, and how many each has. joined: no word has the mark."""
        if not joined:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            return np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(lengths.sum())), lengths
        mark, mark_id = self.mark
        ids = np.array(self.tokenizer.encode_batch_fast([mark.join(words) + mark], add_special_tokens=False)[0].ids, dtype=np.int32)
        return ids[ids != mark_id], np.diff(np.flatnonzero(ids == mark_id), prepend=-1) - 1

    def _of_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of _LETTERS."""
        ids = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=np.int32)
        ends = np.flatnonzero(self.is_end[ids])
        # A word has one end at most, none where the vocabulary lacks its last byte.
        return (ids, np.diff(ends, prepend=-1)) if len(ends) == len(words) else self._encoded(words, True)

    def _learn(self, new: pa.LargeBinaryArray, joined: bool) -> None:
        words = new.cast(pa.large_string()).to_pylist()
        letters = np.fromiter((joined and self.model is not None and _LETTERS.fullmatch(w) is not None for w in words), dtype=bool, count=len(words))
        starts, lengths, parts, n = np.empty(len(words), np.int64), np.empty(len(words), np.int64), [self.ids], len(self.ids)
        for places, encoded in ((np.flatnonzero(letters), self._of_letters), (np.flatnonzero(~letters), lambda some: self._encoded(some, joined))):
            for k in range(0, len(places), LEARN_WORDS):
                some = places[k : k + LEARN_WORDS]
                ids, lengths[some] = encoded([words[i] for i in some.tolist()])
                starts[some] = n + np.cumsum(lengths[some]) - lengths[some]
                parts.append(ids)
                n += len(ids)
        self.size += pc.sum(pc.binary_length(new)).as_py() + n - len(self.ids)
        self.ids, self.starts, self.lengths = np.concatenate(parts), np.concatenate((self.starts, starts)), np.concatenate((self.lengths, lengths))
        self.hits = np.concatenate((self.hits, np.zeros(len(words), np.int64)))

    def _slice(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > TABLE_WORDS or self.size > TABLE_SIZE:
            self._shrink()
        keep = ~_SPACE[data]
        # Between a letter and another ASCII character but the apostrophe the pattern cuts, too; then case doesn't matter. Not where a text may have added tokens.
        whole = _LOWER[data].tobytes() if self.mark is not None else b""
        finer = self.mark is not None and not any(t in whole for t in self.added)
        opens = keep.copy()
        opens[1:] &= ~keep[:-1]
        if finer:
            (letter, data), other = _letters(data), _OTHER[data]
            opens[1:] |= keep[1:] & (letter[:-1] & other[1:] | other[:-1] & letter[1:])
        first = offsets[:-1][offsets[:-1] < len(data)]
        opens[first] |= keep[first]
        starts = np.flatnonzero(opens)
        at = np.append(np.cumsum(keep)[starts] - 1, keep.sum()).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[keep])])
        # The table's words are distinct and stand first, so a word's number is its place in the table, and new ones follow.
        known = len(self.words)
        coded = pa.concat_arrays([self.words, words]).dictionary_encode()
        if len(coded.dictionary) > known:
            self._learn(coded.dictionary.slice(known), finer)
        self.words = coded.dictionary
        word = coded.indices.to_numpy()[known:]
        self.hits += np.bincount(word, minlength=len(self.words))
        lengths = self.lengths[word]
        total = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(starts, offsets[1:])]
        counts = np.diff(total, prepend=0) + 1
        out = np.empty(int(counts.sum()), dtype=np.int32)
        ends = np.cumsum(counts) - 1
        inner = np.ones(len(out), dtype=bool)
        inner[ends] = False
        out[inner] = self.ids[_ragged(self.starts[word], lengths)]
        out[ends] = end
        return out, counts

    def encode(self, texts: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of runs of texts the first one's place, the ids of all in one array, and how many each has."""
        for first, data, offsets in byte_chunks(texts, SLICE_BYTES):
            yield first, *self._slice(data, offsets, end)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class IdFile:
    """A file of ids: the documents' ids by place, without reading the others."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(path)
        self.file, size = store.open_input_file(place), store.get_file_info(place).size
        self.n_ids, bounds, docs, self.nulls, self.width, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC or self.n_ids * self.width + bounds + docs + _FOOTER.size != size:
            raise ValueError(f"{path} is no whole file of ids")
        self.bounds = EliasFano.from_bytes(self.file.read_at(bounds, self.n_ids * self.width))
        self.doc_ids = EliasFano.from_bytes(self.file.read_at(docs, self.n_ids * self.width + bounds))
        self.n = self.bounds.n - 1

    def ids(self, first: int, end: int) -> np.ndarray:
        """The ids from one boundary to another."""
        return np.frombuffer(self.file.read_at((end - first) * self.width, first * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(*self.bounds.between(i, i + 2).tolist())

    def close(self) -> None:
        self.file.close()


class _Writer:
    def __init__(self, folder: str, width: int):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        self.path, self.width = f"{folder}/{uuid.uuid4().hex}.ids", width
        self.out = store.open_output_stream(f"{root}/{self.path.rsplit('/', 1)[1]}", compression=None)
        self.counts: list[np.ndarray] = []
        self.doc_ids: list[np.ndarray] = []
        self.nulls = self.n_ids = self.docs = 0

    def add(self, doc_ids: np.ndarray, nulls: int, ids: np.ndarray, counts: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.counts.append(counts)
        self.doc_ids.append(doc_ids)
        self.nulls, self.n_ids, self.docs = self.nulls + nulls, self.n_ids + len(ids), self.docs + len(counts)

    def close(self) -> tuple[str, int, int]:
        bounds = EliasFano.of(np.concatenate(([0], np.cumsum(np.concatenate(self.counts))))).to_bytes()
        docs = EliasFano.of(np.concatenate(self.doc_ids)).to_bytes()
        self.out.write(bounds + docs + _FOOTER.pack(self.n_ids, len(bounds), len(docs), self.nulls, self.width, MAGIC))
        self.out.close()
        return self.path, self.docs, self.n_ids


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches together, as a slice costs a pass over the table of words however short it is."""
    some, size, rows = [], 0, 0
    for batch in batches:
        if some and (size + batch.nbytes > SLICE_BYTES or rows + batch.num_rows > SLICE_ROWS):
            yield pa.concat_batches(some) if len(some) > 1 else some[0]
            some, size, rows = [], 0, 0
        some.append(batch)
        size, rows = size + batch.nbytes, rows + batch.num_rows
    if some:
        yield pa.concat_batches(some) if len(some) > 1 else some[0]


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end: int, id_column: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Write the ids of all texts, in ascending order of their document ids, under folder. The manifest, stored: part and seq (the files' order), path, docs, ids."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, own = TaskContext.get().partitionId(), 0, None, encoder(tokenizer)
        done: list[tuple] = []
        for batch in _gathered(batches):
            for first, ids, counts in own.encode(batch.column(1), end):
                keys, ends, k = batch.column(0).slice(first, len(counts)), np.cumsum(counts), 0
                while k < len(counts):
                    out = out or _Writer(folder, own.width)
                    begin = int(ends[k] - counts[k])
                    # As many documents as fit, the one that fills the file included.
                    n = min(len(counts) - k, file_docs - out.docs, int(np.searchsorted(ends[k:], begin + file_ids - out.n_ids)) + 1)
                    some = keys.slice(k, n)
                    out.add(some.drop_null().to_numpy(zero_copy_only=False), some.null_count, ids[begin : ends[k + n - 1]], counts[k : k + n])
                    k += n
                    if out.n_ids >= file_ids or out.docs >= file_docs:
                        done.append((part, seq, *out.close()))
                        out, seq = None, seq + 1
        if out is not None:
            done.append((part, seq, *out.close()))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in done], schema)

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
    key, value = F.col(plain(id_column)).cast("long"), F.col(plain(text))
    # The last column splits rows that are all alike among tasks.
    rows = docs.select(key.alias("id"), value.alias("text"), F.xxhash64(value).alias("tie"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange("id", "tie", "row").sortWithinPartitions("id", "tie", "row")
    return materialize(rows.select("id", "text").mapInArrow(write, "part int, seq int, path string, docs bigint, ids bigint"), "ids-manifest")


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of files, given as rows of the manifest with their start."""
    for row in chain.from_iterable(b.to_pylist() for b in batches):
        file = IdFile(row["path"])
        if (file.n, file.n_ids) != (row["docs"], row["ids"]):
            raise ValueError(f"{row['path']} doesn't have what the manifest says")
        bounds = file.bounds.between(0, file.n + 1)
        keys = np.ma.array(np.concatenate((np.zeros(file.nulls, np.int64), file.doc_ids.between(0, file.doc_ids.n))), mask=np.arange(file.n) < file.nulls)
        group = bounds[:-1] // SLICE_IDS
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), file.n]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            data = pa.py_buffer(file.ids(int(bounds[a]), int(bounds[b])).astype("<u4"))
            # Made of buffers, as pa.array never lets go of a memoryview: a worker would keep the ids of every file it has read.
            at = pa.array((bounds[a : b + 1] - bounds[a]) * 4, pa.int32())
            ids = pa.Array.from_buffers(pa.binary(), b - a, [None, at.buffers()[1], data])
            yield pa.RecordBatch.from_arrays([pa.array(keys.data[a:b], pa.int64(), mask=keys.mask[a:b]), pa.array(row["start"] + bounds[a:b]), pa.array(np.diff(bounds[a : b + 1])), ids], schema=_READ)
        file.close()


def read_ids(manifest: DataFrame) -> DataFrame:
    """A task per file. Each document's doc_id, start (ids of all documents before it), n_tokens and ids (binary, little-endian unsigned 32-bit numbers)."""
    # One row per file: a sum over these in one task is small.
    before = F.sum("ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    files = materialize(manifest.withColumn("start", F.coalesce(before, F.lit(0))), "ids-files")
    tasks = max(1, manifest.count())
    return files.repartitionByRange(tasks, "path").mapInArrow(_scan, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op11_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_ids(read(spark, sf_dir, "documents"), new_path(spark, "ids"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    return read_ids(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op11_id_files": op11_id_files}
ORACLE_SQL: dict[str, str] = {}
