"""Quality rules, SentencePiece, SimHash, winnowing, secrets, preference pairs: against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from threadmill.llm import common, decontaminate, pieces, preference, quality, secrets, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 30_000
ODD = [None, "", "   \n\t ", "one", "one two", "a b c a b c", "é ü　x y", "line one here\nline one here\n\nline one here", "x\x00y <s> </s> ▁ ▁▁b", "😀 " * 70]


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "own", True) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, kept boolean")


# --- Quality rules ----------------------------------------------------------------------------------------------------


def brute_quality(text):
    words = WORD.findall(text or "")
    hit, later = set(), {n: set() for n in quality.NGRAM_PERCENT}
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= {i, i + 1, i + 2}
    for n in later:
        seen = set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g in seen:
                later[n] |= set(range(i, i + n))
            seen.add(g)
    dup, seen = [], set()
    for line in (text or "").split("\n"):
        if WORD.search(line):
            if line in seen:
                dup.append(line)
            seen.add(line)
    chars = sum(map(len, words))
    line_chars = sum(len(w) for line in dup for w in WORD.findall(line))
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    over = {f"dup_chars_{n}": sum(len(words[i]) for i in at) for n, at in later.items()}
    kept = not failed and 100 * line_chars <= quality.LINE_PERCENT * chars and all(100 * over[f"dup_chars_{n}"] <= p * chars for n, p in quality.NGRAM_PERCENT.items())
    return {"n_words": len(words), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(dup), "n_repeat_words": len(hit), "dup_line_chars": line_chars, **over, "base_failed": failed, "kept": kept}


def random_texts(seed, n=120):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", "bb", "çc", "#d", "e"]) + rng.choice([" ", " ", "\n", "\t ", " "]) for _ in range(rng.randrange(0, 160))) for _ in range(n)]


def test_quality_counts():
    texts = ODD + random_texts(1)
    assert quality.measure(pa.array(texts)).to_pylist() == [brute_quality(t) for t in texts]
    assert quality.measure(pa.array([], pa.string())).to_pylist() == []


def test_quality_chunks_do_not_matter(monkeypatch):
    texts = random_texts(2, 40)
    whole = quality.measure(pa.array(texts)).to_pylist()
    monkeypatch.setattr(quality, "byte_chunks", lambda t: __import__("threadmill.llm.common", fromlist=["x"]).byte_chunks(t, 50))
    assert quality.measure(pa.array(texts)).to_pylist() == whole


def test_quality_filter_keeps_columns(spark):
    good = " ".join(f"w{k}" for k in range(60))
    df = frame(spark, [good, "short", None, LONG, good])
    kept = quality.keep_unrepetitive(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 4]
    assert quality.keep_unrepetitive(df.limit(0)).count() == 0


# --- SentencePiece ----------------------------------------------------------------------------------------------------

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_pieces_are_the_library_s(library):
    rng = random.Random(3)
    parts = ["a", "b", "t", "th", "he", "ing", " ", "  ", "\n", "▁", "é", "中", "😀", "\x00", "aa", "abab", "<s>", "0", "　"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["".join(rng.choice("the rinasto") for _ in range(80)) for _ in range(1500)] + ["a" * 3000, " " * 500, "ab" * 900]
    got = pieces.encode_column(pa.array(texts), PATH)
    want = [library.encode(t or "", add_eos=True) for t in texts]
    assert got.to_pylist() == want
    assert pieces.decode_column(got, PATH).to_pylist() == [library.decode(x) for x in want]


def test_unbroken_text_takes_time_in_proportion(library):
    rng = random.Random(5)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(of) for _ in range(n))
    texts = [letters(200_000), letters(100_000, "".join(map(chr, range(0x4E00, 0x5E00)))), letters(500_000, "ABCDEFGHabcdefgh0123456789+/"), "a" * 100_000, "the" * 30_000, letters(1000) + " " + letters(1000)]
    began = time.process_time()
    got = pieces.encode_column(pa.array(texts), PATH).to_pylist()
    assert time.process_time() - began < 20
    assert got == [library.encode(t, add_eos=True) for t in texts]


def test_any_ids_decode_as_the_library_s(library):
    rng = random.Random(4)
    lists = [[rng.randrange(32000 if rng.random() < 0.3 else 300) for _ in range(rng.randrange(9))] for _ in range(4000)]
    got = pieces.decode_column(pa.array([*lists, None], pa.list_(pa.int32())), PATH).to_pylist()
    assert got == [*(library.decode(x) for x in lists), None]


def test_the_table_of_words_is_bounded(library, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_WORDS", 50)
    monkeypatch.setattr(pieces, "SLICE_BYTES", 200)
    texts = random_texts(5, 60) + [LONG[:5000]]
    assert pieces.encode_column(pa.array(texts), PATH).to_pylist() == [library.encode(t, add_eos=True) for t in texts]


def test_digests(spark, library):
    rows = {r["doc_id"]: r for r in pieces.digests(frame(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode(t or "", add_eos=True)
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.digests(frame(spark, ["a"]).limit(0)).count() == 0


# --- SimHash ----------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids, most=3):
    label = np.arange(len(prints))
    x = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= most
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    return [min((ids[j] for j in range(len(x)) if label[j] == label[i] and ids[j] is not None), default=None) for i in range(len(x))]


def test_links_in_gray_order():
    rng = np.random.default_rng(0)
    x = []
    for b in rng.integers(0, 2**63, 60, dtype=np.uint64):
        for _ in range(12):
            v = int(b)
            for k in rng.integers(0, 64, rng.integers(0, 6)):
                v ^= 1 << int(k)
            x.append(v)
    x = np.unique(np.array(x, dtype=np.uint64))
    group = rng.integers(0, 3, len(x))
    order = np.lexsort((simhash.gray_rank(x), group))
    x, group = x[order], group[order]
    got = {(int(i), int(j)) for a, b in simhash.linked(x, group, 3, chunk=50) for i, j in zip(a, b, strict=True)}
    near = (np.bitwise_count(x[:, None] ^ x[None, :]) <= 3) & (group[:, None] == group[None, :])
    assert got == {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}


@pytest.mark.parametrize("node_most", [512, 8])
def test_components(spark, node_most):
    rng = random.Random(6)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) + str(rng.randrange(9)) for _ in range(80)) for _ in range(12)]
    texts = list(ODD)
    for b in base:
        words = b.split()
        for _ in range(8):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "zz"
            texts.append(" ".join(copy))
    texts += [base[0]] * 40
    rows = [(None if i == 20 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df, node_most=node_most).collect()
    prints = [brute_fingerprint(t) for t in texts]
    want = brute_components(prints, [i for i, _ in rows])
    assert sorted((r["doc_id"] is None, r["doc_id"], r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted((False, i, format(p, "016x"), c) for (i, _), p, c in zip(rows, prints, want, strict=True) if i is not None)
    assert len(got) == len(rows)


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = frame(spark, [text, text, "quite another text of a few words", None, "", LONG, LONG + "x"]).union(frame(spark, [text]))
    for name in ("component_id", "fp", "a.b", "root", "u"):
        df = df.withColumn(name, F.lit(7))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 5]
    assert sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()) == [(0, 0), (0, 0), (1, 0), (2, 2), (3, 3), (4, 3), (5, 5), (6, 5)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_nodes_are_streamed(monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", 50)
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"mask": 15, "bits": np.repeat(np.arange(40), 20), "fp": rng.integers(0, 2**8, 800)}).sort_values(["mask", "bits"], ignore_index=True)
    once = pd.concat(simhash._node_edges(3)(iter([rows])))
    streamed = pd.concat(simhash._node_edges(3)(rows[k : k + 7] for k in range(0, 800, 7)))
    assert len(once) and sorted(map(tuple, once.to_numpy().tolist())) == sorted(map(tuple, streamed.to_numpy().tolist()))


def test_a_hub_of_many_links(spark):
    edges = spark.range(1, 5000).selectExpr("id AS u", "0L AS v").union(spark.range(1, 400).selectExpr("id + 10000 AS u", "id + 9999 AS v"))
    roots = {r["u"]: r["root"] for r in simhash.components(edges).collect()}
    assert len(roots) == 4999 + 399 and {roots[u] for u in range(1, 5000)} == {0} and {roots[u] for u in range(10001, 10400)} == {10000}


# --- Winnowing --------------------------------------------------------------------------------------------------------


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    mine, hit, found = words(text), set(), set()
    for item, t in items:
        own = words(t)
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(mine) - n + 1) if n else ():
            if tuple(mine[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(mine), len(hit), sorted(str(x) for x in found if x is not None)


@pytest.mark.parametrize("filter_bits", [26, 15])
def test_contamination(spark, filter_bits, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", filter_bits)  # a small filter lets more through, and loses nothing
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefg")
    items = [(k, " ".join(word() for _ in range(rng.choice([12, 15, 20])))) for k in range(8)] + [(100, "x y"), (101, "solo"), (102, ""), (103, None), (None, "p q r s"), (0, "k l m n o p q r s t u")]
    texts = list(ODD) + [" ".join(word() for _ in range(rng.randrange(30))) for _ in range(20)]
    for _, t in items:
        if t:
            texts += ["Before, " + t.upper().replace(" ", "; ") + " after", " ".join(t.split()[1:]), t + " " + t]
    texts += [" ".join(word() for _ in range(3000)), LONG + items[0][1]]
    df = frame(spark, texts).withColumn("a.b", F.lit(1)).withColumn("id", F.lit(2)).withColumn("hits", F.lit(3))
    bench = spark.createDataFrame(items + items[:3], "item_id long, text string")
    got = {r["doc_id"]: r["hits"] for r in decontaminate.with_hits(df, bench).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, hit, found = brute_hits(t, items)
        assert (got[i]["n_words"], got[i]["n_hit"], sorted(map(str, got[i]["items"]))) == (n, hit, found), t
        assert sum(s["end"] - s["start"] for s in got[i]["spans"]) == hit
    assert decontaminate.with_hits(df, bench.limit(0)).where("hits.n_hit > 0").count() == 0
    clean = decontaminate.keep_clean(df.union(df), bench)
    assert clean.columns == df.columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(2 * [i for i, t in enumerate(texts) if not brute_hits(t, items)[1]])
    assert decontaminate.keep_clean(df.limit(0), bench).columns == df.columns
    assert decontaminate.keep_clean(df.limit(0), bench).count() == 0


def test_a_passage_of_many_items_costs_a_row_per_document_and_set(spark):
    passage = "a b c d e f g h i j k l m n"
    bench = spark.createDataFrame([(k, passage) for k in range(200)] + [(500, f"{passage} its own end")], "item_id long, text string")
    items = decontaminate.Benchmark(bench)
    found = decontaminate.hits(decontaminate.candidates(frame(spark, [passage] * 3 + ["none of it", f"x {passage} y"]), items), items)
    assert found.select("id", "s1", "s2").distinct().count() == 4
    assert [len(r["items"]) for r in decontaminate.judged(found, items).collect()] == [201] * 4


# --- Secrets ----------------------------------------------------------------------------------------------------------


def brute_base(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets(spark):
    key, vendor = "0123456789abcdef" * 2, "ghp_" + "A1b2" * 10
    texts = [*ODD, f"😀 token = '{key}' and PASSWORD:short password=token:abcdefghijk", f"AKIA{'X' * 12} AKIAAKIA api-key api_key='aaaaaaaa' {key}{key}", f"é {vendor}", f"é {vendor} {vendor}", f"{'z' * 100_000} secret: {'q' * 9}", "API_KEY=examplekey", "API_KEY=examplekey ", " API_KEY=examplekey"]
    df = spark.createDataFrame([(i, t, f"owner{i}", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    rows = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t)
        assert rows[i]["base_spans"] == ",".join(x for _, _, x in base), t
        assert [rows[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(j == n for _, j, _ in base) for n in range(3)]
    assert rows[len(texts) - 1]["n_example"] == 1 and rows[len(ODD)]["n_live"] >= 1
    assert "vendor:2:46" in rows[len(ODD) + 2]["spans"]  # two owners have it: no example
    alone = secrets.scan(df.where(F.col("doc_id") == len(ODD) + 3)).first()
    assert alone["spans"] == "vendor:2:46,vendor:47:91" and alone["base_spans"] == ""
    twice = secrets.scan(df.union(df)).collect()
    assert len(twice) == 2 * len(texts) and {(r["doc_id"], r["base_spans"]) for r in twice} == {(i, r["base_spans"]) for i, r in rows.items()}
    assert secrets.scan(df.limit(0)).count() == 0


def test_secrets_of_two_owners_have_a_class(spark):
    vendor = "ghp_" + "A1b2" * 10
    rows = [(0, f"{vendor} token=twoowners1", "a"), (1, f"{vendor} token=twoowners1", "b"), (2, "token=liveliveli", "a")] + [(3 + k, "token=example12", f"o{k}") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    assert [(got[i]["n_live"], got[i]["n_shared"], got[i]["n_example"]) for i in range(4)] == [(0, 2, 0), (0, 2, 0), (1, 0, 0), (0, 0, 1)]
    assert got[0]["shared_spans"] == "vendor:0:44,assign:45:61" and got[2]["shared_spans"] == ""


def pem(k, kind="RSA "):
    body = "\n".join(hashlib.sha256(f"{k}/{n}".encode()).hexdigest() for n in range(6))
    return f"-----BEGIN {kind}PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,AB\n\n{body}\n-----END {kind}PRIVATE KEY-----"


def test_each_private_key_is_a_secret(spark):
    rows = [(k, f"x {pem(k)} y", f"o{k}") for k in range(3)] + [(10 + k, pem("copied", ""), f"o{k}") for k in range(3)] + [(20, "-----BEGIN RSA PRIVATE KEY----- is how a key begins", "o1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(df).collect()}
    for k in range(3):
        assert f"vendor:2:{2 + len(pem(k))}" in got[k].split(",")
        assert "vendor" not in got[10 + k]
    assert got[20] == ""


def test_repositories_of_several_owners_make_an_example(spark):
    rows = [(k, "token=copiedaround", f"o{k % 2}", f"repo{k // 2}") for k in range(6)] + [(10 + k, "token=oneofmine", "o1", f"repo{k}") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for scanned in (df, df.withColumn("secret", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("matches", F.lit(3)).withColumn("tie", F.lit(4))):
        got = {r["doc_id"]: r for r in secrets.scan(scanned).collect()}
        assert (got[0]["n_example"], got[0]["n_shared"], got[10]["n_live"], got[10]["n_example"]) == (1, 0, 1, 0)
    scans = secrets.searched(df)._jdf.queryExecution().executedPlan().toString().count("Scan")
    assert scans == 1


# --- Preference pairs -------------------------------------------------------------------------------------------------


def test_preference(spark):
    rows = [
        (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "good"), (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "bad"), (1, False, 2, "user", "more"),
        (2, True, 0, "user", "same"), (2, False, 0, "user", "same"), (3, True, 0, "user", "alone"), (None, True, 0, "user", "lost"), (4, True, None, None, None), (4, False, None, None, None),
    ]
    df = spark.createDataFrame(rows, "pair_id long, is_chosen boolean, turn int, role string, text string")
    got = {r["pair_id"]: r for r in preference.format_pairs(df).collect()}
    assert set(got) == {1, 2, 3, 4}
    one = got[1]
    assert one["prompt"] == "<|user|>\nhi<|end|>\n" and one["chosen"] == "<|assistant|>\ngood<|end|>\n" and one["usable"]
    span = one["chosen_mask"][0]
    assert one["chosen"][span["start"] : span["end"]] == "good<|end|>\n" and len(one["rejected_mask"]) == 1
    assert (got[2]["prompt_turns"], got[2]["chosen"], got[2]["usable"]) == (1, "", False)
    assert (got[3]["prompt_turns"], got[3]["rejected"]) == (0, "") and got[4]["prompt_turns"] == 1
    assert preference.format_pairs(df.limit(0)).count() == 0


def test_pairs_of_branches_share_their_prefix(spark):
    long = "very " * 200_000
    rows = [
        (0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", None), (0, 3, "assistant", "last of 0"), (0, 4, "user", "after"),
        (1, 0, "user", "q1"), (1, 1, "assistant", "last of 1"), (1, 1, "assistant", "last of 1"), (2, 0, "user", "no answer"), (3, 0, "assistant", long), (4, 0, None, "x"), (4, 1, "assistant", "y"), (None, 0, "assistant", "z"), (4, None, "assistant", "w"),
    ]
    df = spark.createDataFrame([(*r, "p", True, "c") for r in rows], "conv_id long, turn int, role string, text string, pair_id string, is_chosen boolean, last string")
    got = {r["pair_id"]: r for r in preference.format_pairs(preference.branches(df)).collect()}
    assert set(got) == {0, 1, 3, 4}
    assert (got[0]["prompt_turns"], got[0]["chosen"], got[0]["rejected"], got[0]["usable"]) == (3, "<|assistant|>\nlast of 0<|end|>\n", "<|assistant|>\nlast of 1<|end|>\n", True)
    assert (got[1]["prompt_turns"], got[1]["rejected"], got[1]["chosen"].count("last of 1")) == (1, "", 2)  # conversation 2 has no answer
    assert got[3]["rejected"] == "<|assistant|>\ny<|end|>\n" and long in got[3]["chosen"] and got[4]["usable"] is False
    assert preference.branches(df.limit(0)).count() == 0


JWT = "eyJ" + "a1" * 8 + ".eyJ" + "b-" * 8 + "." + "c_" * 8


def test_secret_scan_equals_its_sql_where_there_are_providers_secrets(spark, tmp_path):
    """The given tables have none of the kinds access and vendor."""
    parts = [JWT, f"x{JWT}", f"-{JWT}", f"é{JWT} {JWT}.{JWT}", "AKIA" + "X1" * 8, "ghp_" + "A1b2" * 10, f"{pem(1)}{JWT}", pem(2, ""), pem(3).replace("\n", "\\n"), "eyJ" * 50, "sk_live_" + "z" * 20, "AIza" + "Q" * 40, "xoxb-" + "1-" * 9]
    parts += ["-----BEGIN PRIVATE KEY-----\nDEK-Info: AAAA-----END PRIVATE KEY-----\n", "token=" + JWT, ".eyJ" * 9 + "." + JWT]
    rows = [(i, f"{a} and {b}", f"o{i % 5}", f"l{i % 3}") for i, (a, b) in enumerate((a, b) for a in parts for b in parts[::3])]
    rows += [(10**6, None, None, None), *((2 * 10**6 + k, f"{'y' * k} {JWT.replace('c_', 'd2')} secret=oftwoowners", f"o{k % 2}", "l") for k in range(4))]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name, query in secrets.QUERIES.items():
        found, want = query(spark, str(tmp_path)), db.sql(secrets.ORACLE_SQL[name])
        assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(want.fetchall())
    assert found.where("n_shared = 2 AND shared_spans LIKE '%vendor%assign%'").count() == 4


@pytest.mark.parametrize("unit", ["eyJ", "eyJ" + "a" * 20 + ".", "-----BEGIN PRIVATE KEY-----\n", "Proc-Type: 4\n", "-----BEGIN PRIVATE KEY-----Proc-Type ", "QUJDREVG", "AKIA", "abc0", "secret ", "password= ", "-----BEGIN A "])
def test_secrets_of_a_long_text_take_no_time(spark, unit):
    df = spark.createDataFrame([(1, "-----BEGIN PRIVATE KEY-----" + unit * (1_000_000 // len(unit)), "o", "r")], "doc_id long, text string, source string, lang string")
    began = time.time()
    secrets.searched(df)
    assert time.time() - began < 10
