"""Full-text search: an inverted index as tables, BM25, match queries, two-phase recall, snippets.

An index is two tables: postings (term, content_id, tf, length, positions) and texts (content_id, conversation_id, side, length, text). A stored one has them in segments, a segment
for each insert, and one small file, versions/<number>, that says which segments and deletions count; it comes last, so an insert, a deletion or a merge that fails leaves the index as it
was, and readers keep the version they began with.

Postings are stored in the order of their terms, so a query reads the row groups of its own terms, and each has its text's length, so ranking reads nothing else; texts are read for
the rows that are returned. Deleting writes marks, which queries subtract, and how many texts of each term are gone, so a term's frequency stays exact. Segments are merged in tiers: as soon as
WIDTH segments are of one size they become one, so there are at most WIDTH for each power of WIDTH; what is marked is left out on the way, and a segment of which much is marked is
rewritten alone.

A segment's texts are in blocks of like length, and for every term and block the largest frequency and the least length are stored (blocks). These bound what any text of the
block can score, so the best k are found by scoring the most promising blocks, and then only those whose bound reaches the k-th rank (best).
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions.scalars import json_text
from threadmill.plans.pointers import names, read_text, write_once
from threadmill.plans.tables import delete as delete_path
from threadmill.plans.tables import discard, settled
from threadmill.schema import Store

K1, B = 1.2, 0.75
#: Recall with all words counts from so many conversations on.
ENOUGH = 10
TOKEN = r"[\p{L}\p{N}]+"

#: Latin letters with marks and their base letters, by the rule of canonical decomposition.
_MARKED = {chr(c): d[0] for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1}


def folded(text: Column) -> Column:
    """T34: lower case, Latin letters without marks."""
    return F.lower(F.translate(text, "".join(_MARKED), "".join(_MARKED.values())))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))


def query_terms(query: str, least: int = 1) -> list[str]:
    """The words of a query, as the index has them, in order, once each."""
    plain = "".join(_MARKED.get(c, c) for c in query).lower()
    return list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", plain) if len(w) >= least))


@dataclass
class Index:
    """marks, blocks, gone and totals are those of a stored index: deleted entries (content_id, segment), bounds (term, segment, block, n, max_tf, min_length), how many deleted texts had
    a term (term, n), and (texts, words) of what is left."""

    postings: DataFrame
    texts: DataFrame
    marks: DataFrame | None = None
    blocks: DataFrame | None = None
    gone: DataFrame | None = None
    totals: tuple[int, int] | None = None
    segments: dict[str, list] | None = None

    def live(self) -> DataFrame:
        """The texts without deleted ones."""
        return self.texts if self.marks is None else self.texts.join(self.marks, ["content_id", "segment"], "left_anti")


_POSTINGS = "term string, content_id {id}, tf bigint, length bigint, positions array<int>, block int, segment string"
_TEXTS = "content_id {id}, conversation_id {conversation}, side string, length bigint, text string, block int, segment string"
_BLOCKS = "term string, block int, n bigint, max_tf bigint, min_length bigint, segment string"
_MARKS = "content_id {id}, segment string"
_GONE = "term string, n bigint"
#: Texts in a block, and bounds of length between blocks; where there are more texts, blocks of one length are split further by hash.
BLOCK_TEXTS, LENGTHS = 4096, 256
#: Segments of one size before they are merged, and the share of marked texts from which on a segment is rewritten alone.
WIDTH, MARKED = 4, 0.2
#: Blocks that a search for the best begins with.
FIRST_BLOCKS = 4
#: Results up to which those of the first blocks are held by the driver.
LOCAL = 10_000


def content(store: Store) -> DataFrame:
    """SNK-04, JON-13, SET-08: the texts to index: text, content_id, side, conversation_id; empty ones are left out."""
    asked = store["prompt_content"].join(store["prompts"].select(F.col("id").alias("prompt_id"), "conversation_id"), "prompt_id").select(json_text(F.col("content")).alias("text"), F.col("id").alias("content_id"), F.lit("prompt").alias("side"), "conversation_id", "block_type")
    told = store["response_content"].join(store["responses"].select(F.col("id").alias("response_id"), "conversation_id"), "response_id").select(json_text(F.col("content")).alias("text"), F.col("id").alias("content_id"), F.lit("response").alias("side"), "conversation_id", "block_type")
    return asked.unionByName(told).where("block_type = 'text' AND text <> ''").drop("block_type")


def _postings(texts: DataFrame) -> DataFrame:
    """Postings of texts (content_id, length, text, block, segment)."""
    places = texts.select("content_id", "length", "block", "segment", F.posexplode(terms(F.col("text"))).alias("at", "term"))
    return places.groupBy("term", "content_id", "length", "block", "segment").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))


def build(texts: DataFrame, segment: str = "all") -> Index:
    """An index that isn't stored. texts: text, content_id, side, conversation_id."""
    rows = texts.select("content_id", "conversation_id", "side", F.size(terms(F.col("text"))).cast("long").alias("length"), "text", F.lit(0).alias("block"), F.lit(segment).alias("segment"))
    return Index(_postings(rows), rows)


# --- A stored index --------------------------------------------------------------------------------------------------


def _version(spark: SparkSession, path: str) -> dict:
    """segments: of each its texts, words, least and largest content_id; marks: of each folder of them the texts and words that it takes away, by segment."""
    there = [n for n in names(spark, f"{path}/versions") if n.isdigit()]
    return json.loads(read_text(spark, f"{path}/versions/{there[-1]}")) if there else {"number": 0, "segments": {}, "marks": {}}


def _commit(spark: SparkSession, path: str, version: dict) -> None:
    number = version["number"] + 1
    write_once(spark, f"{path}/versions", f"{number:012d}", json.dumps(version | {"number": number}))


def _add_segment(texts: DataFrame, path: str, segment: str) -> list | None:
    """Write texts (content_id, conversation_id, side, text) as a segment, in blocks of like length; what the version says of it, or None if there are none."""
    spark, columns = texts.sparkSession, ["content_id", "conversation_id", "side", "length", "text"]
    rows = settled(texts.select("content_id", "conversation_id", "side", F.size(terms(F.col("text"))).cast("long").alias("length"), "text"), "fulltext-texts")
    n, words, least, most = rows.agg(F.count("*"), F.sum("length"), F.min("content_id"), F.max("content_id")).first()
    if not n:
        return None
    blocks = -(-n // BLOCK_TEXTS)
    bounds, parts = min(blocks, LENGTHS), -(-blocks // LENGTHS)
    cuts = sorted(set(rows.agg(F.percentile_approx("length", [k / bounds for k in range(1, bounds)], 10_000)).first()[0])) if bounds > 1 else []
    below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("length"))) if cuts else F.lit(0)
    placed = rows.select(*columns, (below * parts + F.pmod(F.xxhash64("content_id"), F.lit(parts))).cast("int").alias("block"))
    placed.write.parquet(f"{path}/texts/segment={segment}")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/texts/segment={segment}").withColumn("segment", F.lit(segment))
    order = ["term", "block", "content_id"]
    _postings(stored).drop("segment").repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/postings/segment={segment}")
    postings = spark.read.parquet(f"{path}/postings/segment={segment}")
    bound = postings.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"))
    bound.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(f"{path}/blocks/segment={segment}")
    discard(rows)
    return [n, words, least, most]


def write(index: Index, path: str) -> None:
    """SNK-04: add an index that isn't stored to the one under path, as a segment. A frequent term is spread over several files."""
    spark, version, segment = index.texts.sparkSession, _version(index.texts.sparkSession, path), uuid.uuid4().hex
    if made := _add_segment(index.texts, path, segment):
        version["segments"][segment] = made
    _commit(spark, path, version)


def read(spark: SparkSession, path: str, id_type: str = "string", conversation_type: str = "string") -> Index:
    """A stored index as of now."""
    version = _version(spark, path)
    segments, marks = version["segments"], version["marks"]

    def load(name: str, schema: str) -> DataFrame:
        schema = schema.format(id=id_type, conversation=conversation_type)
        return spark.read.schema(schema).parquet(f"{path}/{name}").where(F.col("segment").isin(list(segments))) if segments else spark.createDataFrame([], schema)

    def taken(name: str, schema: str) -> DataFrame | None:
        return spark.read.schema(schema.format(id=id_type)).parquet(*(f"{path}/{name}/{m}" for m in sorted(marks))) if marks else None

    lost = [sum(of[k] for m in marks.values() for of in m.values()) for k in (0, 1)]
    totals = tuple(sum(of[k] for of in segments.values()) - lost[k] for k in (0, 1))
    return Index(load("postings", _POSTINGS), load("texts", _TEXTS), taken("marks", _MARKS), load("blocks", _BLOCKS), taken("gone", _GONE), totals, segments)


def insert(texts: DataFrame, path: str, id_type: str = "string", conversation_type: str = "string") -> None:
    """SNK-04: the texts that a stored index lacks become a segment of it. Only segments whose range of ids meets that of the texts are asked what they have."""
    spark = texts.sparkSession
    version, rows = _version(spark, path), settled(texts.dropDuplicates(["content_id"]), "fulltext-insert")
    least, most = rows.agg(F.min("content_id"), F.max("content_id")).first()
    meeting = [] if least is None else [s for s, of in version["segments"].items() if of[2] <= most and of[3] >= least]
    if meeting:
        known = read(spark, path, id_type, conversation_type).live().where(F.col("segment").isin(meeting)).select("content_id")
        rows = rows.join(known, "content_id", "left_anti")
    segment = uuid.uuid4().hex
    if made := _add_segment(rows, path, segment):
        version["segments"][segment] = made
        _commit(spark, path, version)


def delete(ids: DataFrame, path: str, id_type: str = "string", conversation_type: str = "string") -> int:
    """DML-05: the texts with these content_ids are marked as deleted; how many there were. The work is in these texts, which are read for their terms, and a scan of the ids."""
    spark, version = ids.sparkSession, _version(ids.sparkSession, path)
    index = read(spark, path, id_type, conversation_type)
    gone = settled(index.live().join(ids.select("content_id").distinct(), "content_id", "left_semi"), "fulltext-gone")
    of = {r.segment: [r.n, r.words] for r in gone.groupBy("segment").agg(F.count("*").alias("n"), F.sum("length").alias("words")).collect()}  # a row a segment
    if of:
        name = uuid.uuid4().hex
        gone.select("content_id", "segment").write.parquet(f"{path}/marks/{name}")
        gone.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).write.parquet(f"{path}/gone/{name}")
        version["marks"][name] = of
        _commit(spark, path, version)
    discard(gone)
    return sum(n for n, _ in of.values())


def replace(texts: DataFrame, path: str, id_type: str = "string", conversation_type: str = "string") -> None:
    """DML-05, SNK-04: texts that have changed, or are new, in place of what the index has under their content_ids."""
    texts = settled(texts, "fulltext-replace")
    delete(texts.select("content_id"), path, id_type, conversation_type)
    insert(texts, path, id_type, conversation_type)


def due(version: dict) -> list[str] | None:
    """The segments to merge next: those of a tier that is full, or one of which much is marked."""
    lost: dict[str, int] = {}
    for of in version["marks"].values():
        for s, (n, _) in of.items():
            lost[s] = lost.get(s, 0) + n
    tiers: dict[int, list[str]] = {}
    for s, of in sorted(version["segments"].items()):
        tiers.setdefault(int(math.log(max(1, of[0] - lost.get(s, 0)), WIDTH)), []).append(s)
    full = [t for t in sorted(tiers) if len(tiers[t]) >= WIDTH]
    if full:
        return tiers[full[0]]
    return next(([s] for s in sorted(lost) if s in version["segments"] and lost[s] >= MARKED * version["segments"][s][0]), None)


def merge(spark: SparkSession, path: str, id_type: str = "string", conversation_type: str = "string") -> int:
    """SNK-04, CHK-13: merge segments until no tier is full and none has many marks, a version each time; how many merges that took. Marked texts are gone afterwards."""
    done = 0
    while segments := due(version := _version(spark, path)):
        index = read(spark, path, id_type, conversation_type)
        left = index.live().where(F.col("segment").isin(segments))
        segment = uuid.uuid4().hex
        made = _add_segment(left, path, segment)
        version["segments"] = {s: of for s, of in version["segments"].items() if s not in segments} | ({segment: made} if made else {})
        # Marks of other segments stay; what is gone of their terms is counted anew.
        if version["marks"]:
            rest = {s: [sum(m.get(s, [0, 0])[k] for m in version["marks"].values()) for k in (0, 1)] for s in version["segments"] if s != segment}
            rest = {s: of for s, of in rest.items() if of[0]}
            version["marks"] = {}
            if rest:
                name = uuid.uuid4().hex
                kept = index.marks.where(F.col("segment").isin(list(rest)))
                kept.write.parquet(f"{path}/marks/{name}")
                texts = index.texts.where(F.col("segment").isin(list(rest))).join(spark.read.schema(_MARKS.format(id=id_type)).parquet(f"{path}/marks/{name}"), ["content_id", "segment"], "left_semi")
                texts.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).write.parquet(f"{path}/gone/{name}")
                version["marks"] = {name: rest}
        _commit(spark, path, version)
        done += 1
    return done


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete what the last version doesn't name; no reader of an earlier one, and no writer, may be at work."""
    version = _version(spark, path)
    for name in ("texts", "postings", "blocks", "marks", "gone"):
        for folder in names(spark, f"{path}/{name}"):
            if folder.removeprefix("segment=") not in (version["segments"] if "segment=" in folder else version["marks"]):
                delete_path(spark, f"{path}/{name}/{folder}")
    for number in names(spark, f"{path}/versions"):
        if number != f"{version['number']:012d}":
            delete_path(spark, f"{path}/versions/{number}")


# --- Match queries -------------------------------------------------------------------------------------------------------


@dataclass
class Match:
    """leaves: lists of words that stand one after the other, and whether the last one is a prefix. test: the query, over the array of the leaves that a text has."""

    leaves: list[tuple[list[str], bool]]
    test: Callable[[Column], Column]

    @staticmethod
    def words(words: list[str], every: bool) -> "Match":
        wanted = F.array(*(F.lit(k) for k in range(len(words))))
        return Match([([w], False) for w in words], lambda has: F.size(has) == len(words) if every else F.arrays_overlap(has, wanted))


_PART = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\*?)|([()])|([\w]+)(\*?))')


def match(query: str) -> Match:
    """RET-01: words and "phrases", each with * as a prefix, joined by NOT, AND (or nothing) and OR, which bind in this order, and parentheses. A query that isn't one is an error."""
    parts, at, query = [], 0, query.rstrip()
    while at < len(query):
        if not (m := _PART.match(query, at)):
            raise ValueError(f"malformed query at {query[at:][:20]!r}")
        phrase, phrase_star, mark, word, star = m.groups()
        parts.append(("mark", mark, False) if mark else ("phrase", phrase, bool(phrase_star)) if phrase is not None else ("mark", word, False) if word in ("AND", "OR", "NOT") else ("phrase", word, bool(star)))
        at = m.end()
    leaves: list[tuple[list[str], bool]] = []

    def joined(level: int) -> Callable[[Column], Column]:
        if level == 3:
            if not parts or parts[0][0] == "mark" and parts[0][1] != "(":
                raise ValueError(f"malformed query: an operand is missing in {query!r}")
            kind, text, prefix = parts.pop(0)
            if kind == "mark":
                inner = joined(0)
                if not parts or parts.pop(0)[:2] != ("mark", ")"):
                    raise ValueError(f"malformed query: a parenthesis is open in {query!r}")
                return inner
            k, said = len(leaves), re.findall(r"[^\W_]+", "".join(_MARKED.get(c, c) for c in text).lower())
            leaves.append((said, prefix))
            return lambda has: F.array_contains(has, k) if said else F.lit(False)
        left, name = joined(level + 1), ("OR", "AND", "NOT")[level]
        while parts and (parts[0][:2] == ("mark", name) or level == 1 and parts[0][:2] not in (("mark", "OR"), ("mark", ")"), ("mark", "NOT"))):
            if parts[0][:2] == ("mark", name):
                parts.pop(0)
            both = left, joined(level + 1)
            left = (lambda has, a=both[0], b=both[1]: a(has) | b(has)) if name == "OR" else (lambda has, a=both[0], b=both[1]: a(has) & b(has)) if name == "AND" else (lambda has, a=both[0], b=both[1]: a(has) & ~b(has))
        return left

    test = joined(0)
    if parts:
        raise ValueError(f"malformed query at {parts[0][1]!r} in {query!r}")
    return Match(leaves, test)


def _leaf(postings: DataFrame, words: list[str], prefix: bool) -> DataFrame:
    """(content_id, segment, length, tf): where the words stand one after the other."""
    is_word = [F.col("term").startswith(w) if prefix and k == len(words) - 1 else F.col("term") == w for k, w in enumerate(words)]
    hits = postings.where(_any(is_word))
    if len(words) == 1:
        return hits.groupBy("content_id", "segment", "length").agg(F.sum("tf").alias("tf")) if prefix else hits.select("content_id", "segment", "length", "tf")
    places = hits.groupBy("content_id", "segment", "length").agg(*(F.flatten(F.collect_list(F.when(c, F.col("positions")))).alias(f"p{k}") for k, c in enumerate(is_word)))
    starts = F.filter("p0", lambda x: _all([F.array_contains(F.col(f"p{k}"), x + k) for k in range(1, len(words))]))
    return places.select("content_id", "segment", "length", F.size(starts).cast("long").alias("tf")).where("tf > 0")


def _any(tests: list[Column]) -> Column:
    return F.coalesce(*(F.when(t, F.lit(True)) for t in tests), F.lit(False))


def _all(tests: list[Column]) -> Column:
    return ~_any([~t for t in tests])


def _weights(df: DataFrame, totals: DataFrame) -> DataFrame:
    """(leaf, mean, idf) of rows (leaf, df), as many as the query has leaves."""
    idf = F.log((F.col("texts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.crossJoin(F.broadcast(totals)).select("leaf", "mean", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"))


def _part(tf: Column, length: Column) -> Column:
    """What a leaf adds to a text's score."""
    return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("mean")))


def _totals(index: Index) -> DataFrame:
    """(texts, mean length): a row."""
    if index.totals is None:
        return index.texts.agg(F.count("*").alias("texts"), F.avg("length").alias("mean"))
    texts, words = index.totals
    return index.texts.sparkSession.createDataFrame([(texts, words / texts if texts else None)], "texts long, mean double")


def scored(index: Index, query: Match | list[str], all_words: bool = False, postings: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """(content_id, segment, rank) of the texts that match: negative BM25 over the query's leaves, so the best is the least. A list of words stands for any of them, or for all.

    postings: some of the index's; weights: of each leaf, if they are known."""
    found = Match.words(query, all_words) if isinstance(query, list) else query
    hits = None
    for k, (words, prefix) in enumerate(found.leaves):
        if words:
            rows = _leaf(index.postings if postings is None else postings, words, prefix).withColumn("leaf", F.lit(k))
            hits = rows if hits is None else hits.union(rows)
    if hits is None:
        return index.texts.select("content_id", "segment", F.lit(0.0).alias("rank")).limit(0)
    if index.marks is not None:
        hits = hits.join(index.marks, ["content_id", "segment"], "left_anti")
    if weights is None:
        weights = _weights(hits.groupBy("leaf").agg(F.count("*").alias("df")), _totals(index))
    out = hits.join(F.broadcast(weights), "leaf").groupBy("content_id", "segment").agg((-F.sum(_part(F.col("tf"), F.col("length")))).alias("rank"), F.collect_set("leaf").alias("has"))
    return out.where(found.test(F.col("has"))).select("content_id", "segment", "rank")


def _here(rows: DataFrame) -> DataFrame:
    """A few rows, computed now and held by the driver."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def bounds(index: Index, found: Match) -> tuple[DataFrame, DataFrame]:
    """Of a query whose leaves are single words: (segment, block, n, bound), where no text of the block can have a rank below -bound and n counts its postings, and the leaves' weights."""
    spark = index.texts.sparkSession
    leaves = spark.createDataFrame([(k, words[0]) for k, (words, _) in enumerate(found.leaves) if words], "leaf int, term string")
    rows = index.blocks.where(F.col("term").isin([w[0] for w, _ in found.leaves if w])).join(F.broadcast(leaves), "term")
    df = rows.groupBy("leaf").agg(F.sum("n").alias("df"))
    if index.gone is not None:
        less = index.gone.join(F.broadcast(leaves), "term").groupBy("leaf").agg(F.sum("n").alias("less"))
        df = df.join(less, "leaf", "left").select("leaf", (F.col("df") - F.coalesce("less", F.lit(0))).alias("df"))
    weights = _here(_weights(df, _totals(index)))  # a row a leaf
    bound = rows.join(F.broadcast(weights), "leaf").groupBy("segment", "block").agg(F.sum("n").alias("n"), F.sum(_part(F.col("max_tf"), F.col("min_length"))).alias("bound"))
    return settled(bound, "fulltext-bounds"), weights


def best(index: Index, query: Match | list[str], limit: int, all_words: bool = False, read_blocks: list[DataFrame] | None = None) -> DataFrame:
    """SRT-04: the rows of scored() with the least ranks, ties by content_id. Of a stored index only blocks are read that can have any of these, if the query is of single words.

    read_blocks gets the blocks that were read."""
    found, order = Match.words(query, all_words) if isinstance(query, list) else query, ["rank", "content_id"]
    if index.blocks is None or not any(w for w, _ in found.leaves) or any(prefix or len(words) > 1 for words, prefix in found.leaves):
        return scored(index, found).orderBy(*order).limit(limit)
    every, weights = bounds(index, found)

    def top(blocks: DataFrame) -> DataFrame:
        rows = index.postings.join(blocks.select("segment", "block"), ["segment", "block"], "left_semi")
        return scored(index, found, postings=rows, weights=weights).orderBy(*order).limit(limit)

    first = _here(every.orderBy(F.desc("bound"), "segment", "block").limit(FIRST_BLOCKS))
    got = _here(top(first)) if limit <= LOCAL else settled(top(first), "fulltext-got")
    n, reached = got.agg(F.count("*"), F.max("rank")).first()
    rest = every.join(first, ["segment", "block"], "left_anti")
    if n == limit:
        rest = rest.where(F.col("bound") >= -reached - 1e-9)
    if read_blocks is not None:
        read_blocks += [first, rest]
    return got.union(top(rest)).orderBy(*order).limit(limit)


def search(index: Index, query: str, limit: int = 20) -> DataFrame:
    """RET-01, SRT-04: (conversation_id, side, content_id, rank, snippet) of the texts that match, best first."""
    found = match(query)
    marked = snippet(F.col("text"), [w for words, _ in found.leaves for w in words])
    return best(index, found, limit).join(index.texts, ["content_id", "segment"]).select("conversation_id", "side", "content_id", "rank", marked.alias("snippet")).orderBy("rank", "content_id")


def conversations_matching(index: Index, words: list[str], all_words: bool) -> DataFrame:
    """(id, rank): conversations by their best text."""
    return scored(index, words, all_words).join(index.texts, ["content_id", "segment"]).groupBy(F.col("conversation_id").alias("id")).agg(F.min("rank").alias("rank"))


def recall(index: Index, query: str, limit: int = 80, enough: int = ENOUGH) -> DataFrame:
    """RET-02, SRT-05, T14: (id, mode): texts with all words, if those are of `enough` conversations, else texts with any word of three letters or more.

    Whether there are enough is asked at once, so only one of the two is searched for afterwards."""
    words, some = query_terms(query), query_terms(query, 3)
    none = index.texts.select(F.col("conversation_id").alias("id"), F.lit("none").alias("mode")).limit(0)
    if not words:
        return none
    both = conversations_matching(index, words, True)
    if both.limit(enough).count() >= enough:
        return both.orderBy("rank", "id").limit(limit).select("id", F.lit("and").alias("mode"))
    if not some:
        return none
    return conversations_matching(index, some, False).orderBy("rank", "id").limit(limit).select("id", F.lit("or").alias("mode"))


def snippet(text: Column, words: list[str], tokens: int = 64, before: str = ">>>", after: str = "<<<", gap: str = "...") -> Column:
    """FN-05: of the stretches of so many words that begin at a hit the first with most distinct hits, the hits marked."""
    pieces = F.regexp_extract_all(text, F.lit(TOKEN + r"[^\p{L}\p{N}]*"), F.lit(0))
    word = lambda p: folded(F.regexp_extract(p, TOKEN, 0))
    wanted = F.array(*map(F.lit, words))
    is_hit = lambda p: F.array_contains(wanted, word(p))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1))), lambda i: is_hit(F.get(pieces, i - 1)))
    value = lambda i: F.size(F.array_distinct(F.filter(F.transform(F.slice(pieces, i, tokens), word), lambda w: F.array_contains(wanted, w))))
    best = F.aggregate(starts, F.struct(F.lit(1).alias("i"), F.lit(0).alias("v")), lambda a, i: F.when(value(i) > a["v"], F.struct(i.alias("i"), value(i).alias("v"))).otherwise(a), lambda a: a["i"])
    marked = F.transform(F.slice(pieces, best, tokens), lambda p: F.when(is_hit(p), F.regexp_replace(p, f"^({TOKEN})", f"{before}$1{after}")).otherwise(p))
    end = F.when(F.size(pieces) >= best + tokens, gap).otherwise("")
    return F.concat(F.when(best > 1, gap).otherwise(""), F.rtrim(F.array_join(marked, "")), end)


def search_only(index: Index, query: str, ids: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """RET-08, SRT-10, T12: full text alone, filtered before the limit; score is the rank without its sign."""
    found = scored(index, query_terms(query), True).join(index.texts, ["content_id", "segment"])
    if ids is not None:
        found = found.join(ids.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
    return found.select("conversation_id", "content_id", "side", F.abs("rank").alias("score")).orderBy(F.desc("score"), "content_id").limit(limit)


def stale(index: Index, texts: DataFrame) -> DataFrame:
    """CHK-12, CHK-13: (content_id, finding): texts that the index lacks, entries without a text, and texts whose number of words differs."""
    now = texts.select("content_id", F.size(terms(F.col("text"))).cast("long").alias("now"))
    both = now.join(index.live().select("content_id", F.col("length").alias("was")), "content_id", "full")
    finding = F.when(F.col("was").isNull(), "missing").when(F.col("now").isNull(), "orphan").when(F.col("was") != F.col("now"), "changed")
    return both.select("content_id", finding.alias("finding")).where("finding IS NOT NULL")
