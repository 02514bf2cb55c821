"""Id files, the filter audit and the source audit: against brute force, with odd rows."""

from __future__ import annotations

import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadmill.llm import divergence, filteraudit, idfiles
from threadmill.llm.eliasfano import EliasFano

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = "Lorem ipsum, dolor sit amet! " * 30_000
ODD = [None, "", " \n\t ", "one", "It's 2024: é ü　x\x0by\x85z", "😀 é ﬁ ǅ İstanbul ΟΔΟΣ", "<|startoftext|>a<|endoftext|> b", "a\r\nb\tc", "x" * 3000, "   lead", "trail   ", "中文没有空格的一行"]


# --- Elias-Fano -------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=700), st.integers(0, 63))
def test_elias_fano(numbers, shift):
    numbers = np.sort(np.array(numbers, dtype=np.int64) >> shift)
    if len(numbers) and (int(numbers[-1]) - int(numbers[0])) // max(1, len(numbers)) > 2**62:
        numbers = numbers >> 3
    made = EliasFano.from_bytes(EliasFano.of(numbers).to_bytes())
    assert made.between(0, made.n).tolist() == numbers.tolist()
    for i in range(0, len(numbers), 97):
        assert made[i] == numbers[i]
        assert made.first_at_least(int(numbers[i])) == np.searchsorted(numbers, numbers[i], side="left")


def test_elias_fano_is_small():
    bounds = np.concatenate(([0], np.cumsum(np.random.default_rng(1).integers(1, 4000, 200_000))))
    made = EliasFano.of(bounds)
    assert made.between(131_000, 131_100).tolist() == bounds[131_000:131_100].tolist()
    assert 8 * len(made.to_bytes()) / len(bounds) < 2 + np.log2(bounds[-1] / len(bounds)) + 0.5


# --- Id files ---------------------------------------------------------------------------------------------------------


def brute_ids(rows):
    tokenizer = Tokenizer.from_file(PATH)
    done = Counter()
    by_id = defaultdict(list)
    for doc_id, text in rows:
        by_id[doc_id].append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4"))
    at = 0
    for doc_id in sorted(by_id, key=lambda x: (x is not None, x or 0)):
        sizes = [len(x) for x in by_id[doc_id]]
        for ids in by_id[doc_id] if len(sizes) == 1 else []:
            done[doc_id, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += sum(sizes)
    return done, {d: sorted((len(x), zlib.crc32(x.tobytes())) for x in xs) for d, xs in by_id.items()}


@pytest.mark.parametrize("most", [(idfiles.FILE_IDS, idfiles.FILE_DOCS), (500, 5)])
def test_id_files(spark, most):
    rows = [*enumerate(ODD, -3), (100, LONG), (2**40, "far"), (None, "no id"), (None, None), *[(50, "the same row")] * 40, (50, "another text of this id")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, ids string, start int").repartition(5)
    manifest = idfiles.write_ids(docs, idfiles.new_path(spark, "ids"), PATH, 2, file_ids=most[0], file_docs=most[1])
    found = idfiles.read_ids(manifest).collect()
    want, by_id = brute_ids(rows)
    assert Counter((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in found if len(by_id[r.doc_id]) == 1) == want
    got = defaultdict(list)
    for r in found:
        got[r.doc_id].append((r.n_tokens, zlib.crc32(r.ids)))
    assert {d: sorted(x) for d, x in got.items()} == by_id
    # Every document begins where the one before it ends.
    order = sorted(found, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *(r.n_tokens for r in order)])[:-1].tolist()
    assert [-(10**9) if r.doc_id is None else r.doc_id for r in order] == sorted(-(10**9) if r.doc_id is None else r.doc_id for r in order)
    # One document of a file, without the others.
    file = idfiles.IdFile(manifest.collect()[0].path)
    assert file.width == 2 and file.document(file.n - 1)[-1] == 2
    assert (manifest.count() > 5) == (most[0] == 500)


def test_id_files_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert idfiles.read_ids(idfiles.write_ids(docs, idfiles.new_path(spark, "ids"), PATH, 2)).collect() == []


def test_a_broken_id_file_is_an_error(spark, tmp_path):
    manifest = idfiles.write_ids(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), f"file://{tmp_path}", PATH, 2)
    (file,) = tmp_path.glob("*.ids")
    file.write_bytes(file.read_bytes()[:-9])
    with pytest.raises(ValueError, match="no whole file|buffer"):
        idfiles.IdFile(manifest.collect()[0].path)


def test_what_reads_id_files_keeps_none_of_their_ids(tmp_path):
    out = idfiles._Writer(f"file://{tmp_path}", 2)
    counts = np.full(1000, 4 * idfiles.SLICE_IDS // 1000)
    out.add(np.arange(1000), 0, np.zeros(counts.sum(), np.int32), counts)
    path, docs, ids = out.close()
    files = [pa.RecordBatch.from_pylist([{"path": path, "docs": docs, "ids": ids, "start": 0}] * 3)]
    tracemalloc.start()
    try:
        for _ in range(2):  # what the first pass leaves, like compiled patterns, doesn't count
            before = tracemalloc.get_traced_memory()[0]
            assert sum(b["n_tokens"].to_numpy().sum() for b in idfiles._scan(iter(files))) == 3 * ids
        kept = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    assert kept < idfiles.SLICE_IDS  # bytes; the ids read take 48 times that


def library_ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def own_ids(encoder, texts):
    return [x.tolist() for _, ids, counts in encoder.encode(pa.array(texts, pa.string()), 2) for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_capitals_before_marks():
    # The small letter and the mark are one character, the capital and the mark stay two.
    texts = ["W\u030a w\u030a", "H\u0331T\u0308Y\u030aJ\u030c", "É\u0323 Ü\u0304ÀW\u0323\u030a", "ÀÉÞß×÷ÿ,Ö.ö", "W", "\u030aW"]
    assert own_ids(idfiles.Encoder(PATH), texts) == library_ids(texts)


def test_ids_of_random_words(monkeypatch):
    monkeypatch.setattr(idfiles, "TABLE_WORDS", 300)
    monkeypatch.setattr(idfiles, "LEARN_WORDS", 50)
    monkeypatch.setattr(idfiles, "SLICE_BYTES", 3000)
    rng = np.random.default_rng(5)
    alphabet = np.array([*"abcWHTYJ  \n'.,$<>/w2", *"ÀÉßéü×÷ªµ", *"\u0301\u0308\u030a\u0331āĀσΣİ中ﬁ\u00a0\u0085😀", "</w>", "Ġ", "'s", "'LL", "<|endoftext|>"])
    weights = np.array([1 / 4000 if x == "<|endoftext|>" else 1 for x in alphabet])
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 30), p=weights / weights.sum())) for _ in range(4000)]
    encoder = idfiles.Encoder(PATH)
    assert own_ids(encoder, texts) == library_ids(texts)
    assert len(encoder.words) < 4000


def test_words_of_letters_go_to_the_model_alone():
    """Normalizer and pattern take three quarters of the time, and leave such words as they are."""
    encoder, seen = idfiles.Encoder(PATH), []
    whole = encoder.tokenizer

    class Spy:
        def encode(self, text, **how):
            seen.append(text)
            return whole.encode(text, **how)

        def encode_batch_fast(self, texts, **how):
            seen.extend(texts)
            return whole.encode_batch_fast(texts, **how)

    encoder.tokenizer = Spy()
    rng = np.random.default_rng(6)
    text = " ".join("".join(rng.choice([*"abcdefghéüñçA"], 9)) for _ in range(3000)) + ". 1999"
    assert own_ids(encoder, [text]) == library_ids([text])
    assert sum(map(len, seen)) < 200  # of 30,000 characters: the dot, the number and the marks behind these


def test_short_batches_are_encoded_together():
    batches = [pa.RecordBatch.from_pydict({"id": [k], "text": [f"word{k}"]}) for k in range(1000)]
    assert [b.num_rows for b in idfiles._gathered(iter(batches))] == [1000]
    long = pa.RecordBatch.from_pydict({"id": [0], "text": ["x" * idfiles.SLICE_BYTES]})
    assert [b.num_rows for b in idfiles._gathered(iter([batches[0], batches[1], long, long, batches[2]]))] == [2, 1, 1, 1]
    assert not list(idfiles._gathered(iter([])))


def test_tokenizers_that_cross_white_space_are_refused():
    assert idfiles.crosses({"pre_tokenizer": {"type": "ByteLevel"}})
    with pytest.raises(ValueError, match="white space"):
        idfiles.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


# --- Filter audit -----------------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    out = defaultdict(Counter)
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    docs = []
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows)
        docs.append((source or "", {c for c, f in fails.items() if f}, doc_id in good, doc_id in toxic))
    for part, fails, is_good, is_toxic in docs:
        for order in permutations("ABCDE"):
            first = next((k for k, c in enumerate(order) if c in fails), 5)
            for k, c in enumerate(order):
                row = out[part, "".join(order), k + 1]
                row.update(kept=int(first > k), removed=int(first == k), redundant=int(first < k and c in fails), unique_fails=int(fails == {c}), good_lost=int(first == k and is_good), toxic_lost=int(first == k and is_toxic))
                out[part, c]["shapley"] += first == k
    return {k: {**dict(v), "shapley": out[k[0], k[1][k[2] - 1]]["shapley"]} for k, v in out.items() if len(k) == 3}


def test_filter_audit(spark):
    long_clean = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long_clean, "a"), (2, long_clean, "b"), (2, long_clean, "b"), (3, None, None), (4, "", ""), (5, LONG, "a"), (6, "ABC def #", None), (None, long_clean, "a"), (7, "same " * 60, "a"), (8, "same " * 60, "b"), (9, long_clean + " $", "b"), (None, None, "only"), (10, "É" * 10 + " x", "a")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (7, None, 1), (None, 1, 1), (99, 1, 1), (9, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, part string, first int")
    found = filteraudit.with_shapley(filteraudit.replayed(filteraudit.flagged(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))))
    got = {(r.part, r.filter_order, r.step): {c: r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")} for r in found.collect()}
    assert got == brute_audit(rows, labels)


def test_filter_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.with_shapley(filteraudit.replayed(filteraudit.flagged(docs, labels))).collect() == []
    one = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string")
    assert filteraudit.with_shapley(filteraudit.replayed(filteraudit.flagged(one, labels))).count() == 600


# --- Source divergence ------------------------------------------------------------------------------------------------


def brute_divergence(rows, min_docs, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(la or "", so or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower)))) for t, la, so in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, c in own for t in c)
        kept = sorted(t for t, n in seen.items() if n >= min_docs)
        counts = {s: sum((c for _, so, c in own if so == s), Counter()) for s in {d[1] for d in own}}
        p = lambda count: {t: 1 + 10**9 * (count[t] + 5) // (sum(count[k] for k in kept) + 5 * len(kept)) for t in kept}
        of = {s: p(c) for s, c in counts.items()}
        q = p(sum(counts.values(), Counter()))
        for s in of:
            pairs = [("pair", o, sum(abs(of[s][t] - of[o][t]) for t in kept)) for o in of if o != s]
            terms = [("term", t, of[s][t] - q[t]) for t in kept if counts[s][t] and of[s][t] > q[t]]
            for part, most in ((pairs, len(pairs)), (terms, top)):
                for rank, (name, item, value) in enumerate(sorted(part, key=lambda x: (-x[2], x[1].encode()))[:most], 1):
                    out.add((lang, s, name, item, value, rank))
    return out


@pytest.mark.parametrize("room", [1 << 20, 3])
def test_source_divergence(spark, room, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [*"abcdefgh", "Ünï", "日本", "DON", "zz"]
    rows = [(" ".join(rng.choice(vocabulary, rng.integers(0, 12))) + "'t x1y", rng.choice(["en", "de"]), f"s{rng.integers(4)}") for _ in range(150)]
    rows += [(None, "en", "empty"), ("", None, None), ("only here", None, "lone"), (LONG, "en", "s0"), ("few words", "xx", "a"), ("other", "xx", "b"), ("alone", "one", "source"), *[("same row A", "en", "s1")] * 9]
    docs = spark.createDataFrame([(t, None if la is None else str(la), so, 1, 2) for t, la, so in rows], "text string, lang string, source string, term int, at int")
    if room == 3:  # sums are handed on at once; in this process, as workers have their own module
        monkeypatch.setattr(divergence, "ROOM", room)
        groups, terms, langs = divergence.vocabulary(divergence.term_counts(docs), docs, min_docs=5)
        at = {(r.lang, r["at"]): r.source for r in groups.collect()}
        vectors = terms.groupBy("lang", "vector").count().withColumnRenamed("count", "times").join(langs, "lang")
        vectors = vectors.selectExpr("lang", "vector.at AS at", "vector.n AS p", "transform(sizes, x -> 0L) AS zeros", "times")
        sums = Counter()
        for batch in divergence._distances(iter(vectors.toArrow().to_batches(max_chunksize=7))):
            for r in batch.to_pylist():
                sums[r["lang"], at[r["lang"], r["a"]], at[r["lang"], r["b"]]] += r["value"]
        want = Counter()
        for r in terms.collect():
            n = {at[r.lang, x["at"]]: x["n"] for x in r.vector}
            names = sorted(s for (la, _), s in at.items() if la == r.lang)
            want.update({(r.lang, a, b): abs(n.get(a, 0) - n.get(b, 0)) for a in names for b in names if a < b})
        assert +sums == +want
    else:
        got = [tuple(r) for r in divergence.audit(docs, min_docs=5, top=4).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, 5, 4)


def test_large_counts_are_exact(spark):
    rows = spark.createDataFrame([(9 * 10**17, 10**18, 10**6), (0, 0, 1), (3, 10, 2)], "n long, size long, terms long")
    got = [r[0] for r in rows.select(divergence.probability(rows["n"], rows["size"], rows["terms"])).collect()]
    assert got == [1 + 10**9 * (n + 5) // (s + 5 * t) for n, s, t in [(9 * 10**17, 10**18, 10**6), (0, 0, 1), (3, 10, 2)]]


def test_source_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
