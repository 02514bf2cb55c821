"""Line dedup, sharding, WARC, LM scoring, the pipeline: against brute force."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import LONG, ODD, PATH, WORD, brute_components, brute_fingerprint, brute_hits, brute_quality
from threadmill.llm import lattice, linededup, sharding, similar, warc
from threadmill.llm.common import new_path

# --- Line dedup --------------------------------------------------------------------------------------------------------


def brute_dedup(docs, min_words):
    """The text of each (id, text) without the lines of later copies: by the longest match with any earlier place."""
    places = []
    for d, (_, text) in enumerate(docs):
        places.append([(k, line, len(line.encode().split())) for k, line in enumerate((text or "").split("\n")) if line.encode().split()])
    order = sorted(range(len(docs)), key=lambda d: (docs[d][0] is None, docs[d][0] if docs[d][0] is not None else 0))
    gone = {d: set() for d in range(len(docs))}
    rank = {d: r for r, d in enumerate(order)}
    starts = [(rank[d], i, d) for d in range(len(docs)) for i in range(len(places[d]))]
    for r, i, d in starts:
        best = 0
        for r2, j, e in starts:
            if (r2, j) < (r, i):
                n = 0
                while i + n < len(places[d]) and j + n < len(places[e]) and places[d][i + n][1] == places[e][j + n][1]:
                    n += 1
                if sum(w for _, _, w in places[d][i : i + n]) >= min_words:
                    best = max(best, n)
        if best:
            gone[d] |= set(range(places[d][i][0], places[d][i + best - 1][0] + 1))
    return ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) if t is not None else None for d, (_, t) in enumerate(docs)]


@pytest.mark.parametrize("min_words", [1, 3, 7])
def test_line_dedup(spark, min_words):
    rng = random.Random(min_words)
    lines = ["a", "b b", "c c c", "d", "e e", "", "f f f f"]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12)))) for i in range(14)] + [(None, "a\nb b\nc c c\nd"), (50, None), (51, ""), (52, LONG)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, p int")
    got = linededup.without_later_copies(df, min_words=min_words)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {i: t for (i, _), t in zip(docs, brute_dedup(docs, min_words), strict=True)}


def test_line_dedup_of_runs_longer_than_the_last_level(spark):
    rng = random.Random(21)
    line = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(rng.randrange(1, 4)))
    long_run, other, short = [line() for _ in range(90)], [line() for _ in range(70)], [line() for _ in range(8)]
    own = lambda n: [line() for _ in range(n)]
    docs = [own(5) + long_run + own(3), own(4) + long_run[10:85] + own(6), own(2) + other + own(2) + other[20:] + own(3), short + own(9) + long_run[:40], own(7) + short + long_run[50:], other + long_run, own(30) + ["w"] * 160 + own(4)]
    rows = [(k, "\n".join(x)) for k, x in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a.b", F.lit(1)).withColumn("rank", F.lit(1))
    got = linededup.without_later_copies(df)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == dict(zip(range(len(docs)), brute_dedup(rows, linededup.MIN_WORDS), strict=True))


def test_line_dedup_of_rows_alike_and_of_nothing(spark):
    text = "\n".join(f"line {k} of many words" for k in range(20))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in linededup.without_later_copies(df).collect())
    assert got == [(1, text), (1, text), (2, "")]
    assert linededup.without_later_copies(df.limit(0)).count() == 0


# --- Sharding -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n, bits", [(1, 4), (2, 3), (3, 2), (4, 2)])
def test_the_curve_visits_neighbours(spark, n, bits):
    side = 1 << bits
    points = spark.range(side**n).select(F.array(*[F.expr(f"CAST(floor(id / {side**k}) AS BIGINT) % {side}") for k in range(n)]).alias("p"))
    rows = sorted((r["h"], list(r["p"])) for r in points.select("p", F.expr(sharding.curve_sql("p", n, bits)).alias("h")).collect())
    assert [h for h, _ in rows] == list(range(side**n))
    assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for (_, x), (_, y) in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("n", [0, 1, 5, 24, 100])
def test_shards(spark, n):
    rows = [(i if i % 7 else None, f"s{i % 3}" if i % 5 else None, i % 4, "x") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, shard string")
    got = sharding.hilbert_shards(df, ["source", "size"], ["doc_id"], 24).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == n and (not n or max(counts.values()) - min(counts[s] for s in range(24)) <= 1)
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    ordered = [r["__tm_curve"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert ordered == sorted(ordered)


def test_long_common_starts_are_told_apart(spark):
    rows = [(i, f"https://common.start/{'abcd'[i % 4]}", i % 10) for i in range(400)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, a_b int").withColumnRenamed("a_b", "a.b").withColumn("rank", F.lit(1))
    got = sharding.hilbert_shards(df, ["source", "a.b"], ["doc_id"], 8)
    assert got.columns == [*df.columns, "__tm_curve", "shard", "slot"]
    rows = got.collect()
    assert len(rows) == 403 and len({(r["source"], r["__tm_curve"] // 256) for r in rows}) < len({r["__tm_curve"] for r in rows})
    assert len({r["source"] for r in rows if r["shard"] == 1}) < 4  # sources lie together


def test_sharding_query(spark, tmp_path):
    rng = random.Random(11)
    docs = [(i if i != 5 else None, t, rng.choice(["en", "fr", None]), f"src{rng.choice([0, 0, 0, 1, 2])}", 0) for i, t in enumerate([None, "", "é中😀", LONG, LONG, *["text " * rng.randrange(40) for _ in range(90)]])]
    docs += [docs[0], docs[7], docs[7]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op2_sharding(spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_shards_are_written(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") % 5).alias("size"))
    sharding.write_shards(sharding.hilbert_shards(df, ["size"], ["doc_id"], 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


# --- WARC ---------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    big, other = "é" * 60, "x" * 100
    pages = [(5, "http://a", big), (3, "http://b\nc", big), (9, None, big), (4, "u", "small"), (1, "u", "small"), (7, "u", None), (8, "u", ""), (10, "u", other), (11, "u", "head\r\n\r\nWARC/1.1\r\n" * 20), (12, "u", LONG), (13, "u", LONG), (None, "u", other)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(warc.resolve(df), new_path(spark, "t"), file_bytes=300)
    assert manifest.agg(F.sum("records")).first()[0] == len(pages)
    path = manifest.first()["path"].removeprefix("file:")
    assert gzip.open(path).read(8) == b"WARC/1.1"
    got = {r["page_id"]: r for r in warc.resolved_records(warc.read_archives(manifest).persist()).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        data = (html or "").encode()
        alike = [j for j, _, h in pages if (h or "").encode() == data and j is not None]
        first = min(alike)
        refers = first if len(data) >= 100 and i != first else None
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers)
    assert warc.resolved_records(warc.read_archives(warc.write_archives(warc.resolve(df.limit(0)), new_path(spark, "t")))).count() == 0


def test_warc_of_copies_and_repeated_ids(spark):
    same, other = "<p>boilerplate</p>" * 20, "y" * 300
    pages = [(k, "u", same) for k in range(1000)] + [(2000, "u", other)] * 3 + [(1999, "v", other), (None, "u", other), (None, "u", "z" * 200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("a.b", F.lit(1)).withColumn("original", F.lit(2))
    resolved = warc.resolve(df.repartition(8)).repartition(8, "page_id", "digest")
    manifest = warc.write_archives(resolved, new_path(spark, "t"), file_bytes=4000)
    assert manifest.count() > 8
    headers = warc.read_archives(manifest)
    assert headers.rdd.getNumPartitions() == manifest.count()
    rows = warc.resolved_records(headers.persist()).collect()
    refers = Counter((r["page_id"], r["refers_to"]) for r in rows)
    assert len(rows) == len(pages) and refers[(2000, 1999)] == 3 and refers[(None, 1999)] == 1 and refers[(None, None)] == 1
    assert all(refers[(k, 0 if k else None)] == 1 for k in range(1000))
    # The copies of a page are spread over the tasks that write them.
    spread = warc.resolve(df).where("digest = sha2(repeat('<p>boilerplate</p>', 20), 256)").groupBy(F.expr("hash(page_id, digest) % 8")).count().agg(F.max("count")).first()[0]
    assert spread < 300


# --- LM scoring -----------------------------------------------------------------------------------------------------------


def brute_marginal(word, scores, names, byte_ids):
    word, memo = lattice.SPACE + word, {}

    def p(i):
        if i == len(word):
            return 1.0
        if i not in memo:
            memo[i] = sum(math.exp(scores[names[word[i : i + k]]]) * p(i + k) for k in range(1, 17) if i + k <= len(word) and word[i : i + k] in names)
            if word[i] not in names:
                memo[i] += math.exp(sum(scores[byte_ids[b]] for b in word[i].encode())) * p(i + 1)
        return memo[i]

    return math.log(p(0))


@pytest.fixture(scope="module")
def vocabulary():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    v = lattice.load(PATH)
    return v, {sp.id_to_piece(i): i for i in range(v.size) if v.scored[i] and not sp.is_byte(i) and not sp.is_control(i)}


def test_marginals_sum_all_segmentations(vocabulary):
    v, names = vocabulary
    words = ["the", "thering", "a", "x中z", "😀b", "zqxj", "é", "internationalization", "\x00"]
    got = lattice.Lattices(v, v.start).marginals(words)
    assert got == pytest.approx([brute_marginal(w, v.start, names, v.byte_ids) for w in words])
    used = lattice.Lattices(v, v.start).expected(["thering", "the"], np.array([3, 2]))
    assert sum(used[i] * len(n) for n, i in names.items()) == pytest.approx(3 * 8 + 2 * 4)
    assert math.isclose(sum(math.exp(x) for x, s in zip(v.start, v.scored, strict=True) if s), 1, rel_tol=1e-6)


def test_long_words_take_time_in_proportion(vocabulary):
    v, names = vocabulary
    rng = random.Random(3)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(of) for _ in range(n))
    lattices = lattice.Lattices(v, v.start)
    words = [letters(600), "a" * 600, "the" * 200, letters(600, "中文字化学é😀"), letters(600, "abcXYZ0123456789+/")]
    sums = [0.0] * len(words)
    for k, w in enumerate(words):  # in slices that no piece crosses, so that brute force needs no deep recursion
        codes = [ord(c) for c in lattice.SPACE + w]
        opens = [*[i for i, o in enumerate(v.cuts.before(np.array(codes))) if o], len(codes)]
        a = {0: 0.0}
        for e in range(1, len(codes) + 1):
            ways = [a[e - n] + v.start[names[(lattice.SPACE + w)[e - n : e]]] for n in range(1, min(16, e) + 1) if (lattice.SPACE + w)[e - n : e] in names]
            if chr(codes[e - 1]) not in names:
                ways.append(a[e - 1] + sum(v.start[v.byte_ids[b]] for b in chr(codes[e - 1]).encode()))
            a[e] = max(ways) + math.log(sum(math.exp(x - max(ways)) for x in ways))
        sums[k] = a[len(codes)]
        assert len(opens) > 1
    assert lattices.marginals(words) == pytest.approx(sums)
    began = time.process_time()
    lattices.marginals([letters(200_000), "a" * 200_000, letters(200_000, "中文字化学")])
    assert time.process_time() - began < 20


@pytest.mark.parametrize("common", [1e-6, 0.05])
def test_scores(spark, vocabulary, common):
    rng = random.Random(8)
    texts = [*ODD, *[" ".join(rng.choice(["The", "thing", "of", "Rust", "code"]) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(40))) for _ in range(60)]]
    texts += [LONG, "x" * 3000, "word" * 40 + " word" * 3] * 2
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("a.b", F.lit(1)).withColumn("score", F.lit(1))
    tokens = lambda t: [w for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    ends = sum(not held(i) for i, _ in rows)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    got = lattice.score(df, PATH, common=common).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in rows:
        r, ts = by_id[i], tokens(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(ts) + 1, sum(counts[w] > 0 for w in ts) + 1, n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c + 1) / (n + v + 1)) for c in [*(counts[w] for w in ts), ends]))
    words = spark.createDataFrame(list(counts.items()), "word string, c long")
    logp = lattice.train(words, ends, PATH)
    vocab, names = vocabulary
    for i, t in rows[10:25]:
        want = sum(brute_marginal(w, logp, names, vocab.byte_ids) for w in tokens(t)) + logp[vocab.end]
        assert by_id[i]["score"] == pytest.approx(want / math.log(10))


def test_training_helps_held_out_texts(spark):
    df = spark.createDataFrame([(i, f"the quantum flux of node{i % 9} rises and the flux falls") for i in range(200)], "doc_id long, text string")
    mean = lambda rounds: lattice.score(df, PATH, rounds=rounds).where("held_out").agg(F.avg(F.col("score") / F.col("n_tokens"))).first()[0]
    few, more, most = mean(0), mean(1), mean(lattice.ROUNDS)
    assert few < more < most


def test_rounds_end_when_they_gain_little(spark, vocabulary):
    counts = [("thering", 30), ("the", 200), ("internationalization", 4), ("zqxj", 1)]
    words = spark.createDataFrame(counts, "word string, c long")
    fit = lambda logp: sum(n * x for (_, n), x in zip(counts, lattice.Lattices(vocabulary[0], logp).marginals([w for w, _ in counts]), strict=True)) + 9 * logp[vocabulary[0].end]
    fits = [fit(lattice.train(words, 9, PATH, rounds=r, tolerance=0)) for r in range(4)]
    assert fits == sorted(fits)
    done = fit(lattice.train(words, 9, PATH))
    assert fits[1] < done and done - fits[3] > -lattice.TOLERANCE * abs(done)


def test_scoring_nothing(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    empty = lattice.score(df.limit(0), PATH)
    assert empty.count() == 0


# --- Pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: rng.choice("bcdfghklmnprst") + rng.choice("aeiou") + rng.choice("bcdfghklmnprst") + rng.choice("aeiou") + rng.choice("lmnrst")
    line = lambda n: " ".join(word() for _ in range(n))
    texts = ["\n".join(line(rng.randrange(8, 30)) for _ in range(6)) for _ in range(25)]
    shared, leak = line(60), line(20)
    texts[3] += "\n" + shared
    texts[4] += "\n" + shared
    texts[5] += " " + leak
    near = texts[6].replace("\n", " ")
    texts += [texts[0], near, near[:-5] + "zuzul", None, "", "short", "again and again " * 40]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(0, leak)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(i, t) for i, t, *_ in docs if brute_quality(t)["kept"]]
    kept = [(i, t) for (i, _), t in zip(kept, brute_dedup(kept, linededup.MIN_WORDS), strict=True) if t.strip()]
    ids = [i for i, _ in kept]
    kept = [(i, t) for (i, t), c in zip(kept, brute_components([brute_fingerprint(t) for _, t in kept], ids), strict=True) if i == c]
    kept = [(i, t) for i, t in kept if brute_hits(t, items)[1] == 0]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {(i, len(x), hashlib.sha256(sp.decode(x).encode()).hexdigest()) for i, x in ((i, sp.encode(t, add_eos=True)) for i, t in kept)}
    got = {(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 5 not in {i for i, _, _ in got} and len(got) >= 20


def test_stages_take_odd_documents(spark, tmp_path):
    text = "\n".join(" ".join(f"w{k}x{j}" for j in range(12)) for k in range(9))
    rows = [(1, text, "en", None, None, 7, 8), (1, text, "en", None, None, 7, 8), (2, text, None, "s", 3, 7, 8), (None, text + " more", "en", "s", 3, 7, 8), (3, None, "en", "s", 3, 7, 8), (4, "", "en", "s", 3, 7, 8), (5, LONG, "en", "s", 3, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id int, `a.b` int")
    spark.createDataFrame([(1, "none of these ten words stands in any of the texts"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left, nothing = docs, docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left, nothing = stage(spark, left, str(tmp_path)), stage(spark, nothing, str(tmp_path))
        assert left.columns == docs.columns == nothing.columns
    last = text.split("\n")[-1] + " more"
    assert sorted(((r["doc_id"], r["text"], r["n_chars"], r["a.b"]) for r in left.collect()), key=str) == [(1, text, None, 8), (None, last, len(last), 8)]
    assert nothing.count() == 0
    for docs in (left, nothing):
        assert corpus_pipeline.sentencepiece(spark, docs, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


# --- Near-dedup of the pipeline ----------------------------------------------------------------------------------------


def brute_similar(rows, words=5):
    """Of each (id, text) the smallest id of its component, by the similarity of all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().encode().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 10 * len(a & b) >= 8 * len(a | b) > 0:
                label = [label[j] if x == label[i] else x for x in label]
    return [min(rows[j][0] for j in range(len(rows)) if label[j] == label[i]) for i in range(len(rows))]


@pytest.mark.parametrize("block, most_blocks", [(4096, 32), (5, 32), (5, 0)])
def test_near_dedup_by_similarity(spark, block, most_blocks, monkeypatch):
    monkeypatch.setattr(similar.links, "__defaults__", (*similar.links.__defaults__[:-2], most_blocks, block))
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = ["", None, "few words", "few words", "Few  words here"]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(base))
        for changed in (0, 1, 2, 3, 5, 8):  # spread out, so that each costs five shingles
            copy = list(base)
            for k in range(changed):
                copy[k * len(copy) // changed] = word()
            texts.append(" ".join(copy))
    # A chain: neighbours are similar, the ends are not.
    chain = [word() for _ in range(200)]
    texts += [" ".join(chain[k * 15 : k * 15 + 140]) for k in range(4)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("v", F.lit(1)).withColumn("a.b", F.lit(1)).withColumn("component_id", F.lit(1))
    want = {i for (i, _), c in zip(rows, brute_similar(rows), strict=True) if i == c}
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(want)
    assert len(want) < len({c for c in brute_components([brute_fingerprint(t) for _, t in rows], [i for i, _ in rows])})
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0


def test_a_bucket_of_one_passage_is_split(spark, monkeypatch):
    """Documents that share a passage of half their length, and have the rest of their own: one bucket, no links, and no shuffle by blocks."""
    monkeypatch.setattr(similar.links, "__defaults__", (*similar.links.__defaults__[:-2], 1, 64))
    rng, asked, compared = random.Random(5), [], similar._compared
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for k in range(600)] + [(1000 + k, passage + " one two three four five six seven eight nine ten eleven " + "x " * k) for k in range(4)]

    def counting(buckets, *rest):
        asked.append(buckets.count())
        return compared(buckets, *rest)

    monkeypatch.setattr(similar, "_compared", counting)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in similar.keep_one(df).collect())
    assert kept == sorted({c for c in brute_similar(rows)})
    assert len(asked) == 2 and asked[1] < 2 * len(rows)  # rows after the split, whatever the number of blocks


def test_bit_maps_lose_no_link():
    rng = np.random.default_rng(4)
    sets = []
    for size in (1, 3, 40, 60, 63, 64, 65, 500, 5000, 20_000):
        base = rng.integers(0, 2**64, size, dtype=np.uint64)
        for share in (1, 0.95, 0.9, 0.88, 0.8, 0.5):
            n = int(size * share)
            sets.append(np.unique(np.concatenate((base[:n], rng.integers(0, 2**64, size - n, dtype=np.uint64)))))
    maps, n = [similar._bit_map(x) for x in sets], np.array([len(x) for x in sets])
    p, q = np.nonzero(np.ones((len(sets), len(sets)), dtype=bool))
    ok = similar._may_be_alike(p, q, n, np.array([len(m) for m in maps]), similar._levels(maps), 80)
    alike = np.array([10 * len(np.intersect1d(sets[a], sets[b])) >= 8 * len(np.union1d(sets[a], sets[b])) for a, b in zip(p, q, strict=True)])
    assert ok[alike].all() and ok.sum() < 1.3 * alike.sum()
