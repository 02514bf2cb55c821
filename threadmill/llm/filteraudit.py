"""What each of several filters removes, in every order in which they can be applied.

Each document gets the set of filters that it fails and is replayed directly: its flags are crossed with the (broadcast) orders, of which there are 120 for five filters; in
each order the first filter that it fails is where it is removed, five steps are exploded, and each step adds to the counts of its part. The counts are combined in the tasks
that read the documents, so what is shuffled is at most a row per task, part, order and step, whatever part holds most documents. Texts never move: only a digest is
shuffled to find each text's smallest document id, and the join with it is one that adaptive execution can split where a text has many copies.

DataFrame functions only. Null text: empty. Null part: the empty string, one part with those that have it. A null document id has no smaller one and no label, and is
smaller than none, so copies fail by other ids only. Rows that repeat are counted each; as equal ids are not smaller, they don't fail for each other. Repeated labels
of a document count if any of them has the value. Very long texts are taken whole. An empty table gives an empty result. Further columns, whatever their names, are left out.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.common import discard, materialize, plain, read

LETTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITAL_PERCENT = 5


def conditions(text: Column) -> list[Column]:
    """Of the filters A to D, whether a text (not null) fails them. B and C hold the products in longs."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n_words, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return [n_words < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n_words, 100 * capitals > MAX_CAPITAL_PERCENT * F.length(text), text.rlike(r"[#$%&*|]")]


def flagged(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, failed, good, toxic) of each document, stored. failed: bit i is set if it fails filter i."""
    value = F.coalesce(F.col(plain(text)), F.lit(""))
    slim = docs.select(F.col(plain(id_column)).alias("id"), F.coalesce(F.col(plain(part)), F.lit("")).alias("part"), value.alias("text"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(F.col("text")))), F.lit(0))
    rows = materialize(slim.select("id", "part", F.sha2("text", 256).alias("digest"), mask.cast("int").alias("failed")), "audit-flags")
    copied = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first")
    copied = materialize(copied, "audit-copies")
    of = labels.groupBy(F.col("doc_id").alias("of")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    of = materialize(of, "audit-labels")
    # id > null isn't true: no copy with a smaller id.
    whole = rows.join(copied, "digest", "left").withColumn("failed", F.col("failed") + F.when(F.col("id") > F.col("first"), 1 << 4).otherwise(0))
    whole = whole.select("id", "part", "failed").join(of, F.col("id") == F.col("of"), "left")
    out = materialize(whole.select("part", "failed", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")), "audit-flagged")
    discard(rows, copied, of)
    return out


def orders(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """All orders: filter_order, and bits: of each step, the bit of its filter."""
    rows = [("".join(o), [1 << letters.index(c) for c in o]) for o in permutations(letters)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>")


def replayed(flags: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Per part, filter_order and step: the counts of the documents in flags."""
    spark, n = flags.sparkSession, len(letters)
    crossed = flags.crossJoin(F.broadcast(orders(spark, letters)))
    first = F.lit(n + 1)
    for k in reversed(range(n)):
        first = F.when(F.col("failed").bitwiseAND(F.col("bits")[k]) != 0, k + 1).otherwise(first)
    crossed = crossed.select("part", "filter_order", "failed", "good", "toxic", "bits", first.alias("first"))
    stepped = crossed.select("part", "filter_order", "failed", "good", "toxic", "first", F.posexplode("bits").alias("at", "bit"))
    step, one = F.col("at") + 1, F.lit(1).cast("long")
    removed = F.col("first") == step
    count = lambda c: F.count(F.when(c, one))
    counts = stepped.groupBy("part", "filter_order", step.cast("int").alias("step")).agg(
        count(F.col("first") > step).alias("kept"),
        count(removed).alias("removed"),
        count((F.col("first") < step) & (F.col("failed").bitwiseAND(F.col("bit")) != 0)).alias("redundant"),
        count(F.col("failed") == F.col("bit")).alias("unique_fails"),
        count(removed & F.col("good")).alias("good_lost"),
        count(removed & F.col("toxic")).alias("toxic_lost"),
    )
    return counts


def with_shapley(counts: DataFrame) -> DataFrame:
    """counts and shapley: what a step's filter removes in its part, summed over all orders."""
    counts = materialize(counts, "audit-counts")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    total = counts.groupBy(F.col("part").alias("of_part"), letter.alias("of_letter")).agg(F.sum("removed").alias("shapley"))
    return counts.join(total, (F.col("part") == F.col("of_part")) & (letter == F.col("of_letter"))).drop("of_part", "of_letter")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_shapley(replayed(flagged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))))


QUERIES = {"op12_filter_audit": op12_filter_audit}

ORACLE_SQL = {
    "op12_filter_audit": f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN len(words) < {MIN_WORDS} WHEN 'B' THEN 100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words)
        WHEN 'C' THEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_CAPITAL_PERCENT} * length(text) WHEN 'D' THEN regexp_matches(text, '[#$%&*|]') ELSE coalesce(doc_id > first, false) END) AS fails
    FROM w LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM x a, x b, x d, x e, x g
    WHERE a.c NOT IN (b.c, d.c, e.c, g.c) AND b.c NOT IN (d.c, e.c, g.c) AND d.c NOT IN (e.c, g.c) AND e.c <> g.c),
r AS (SELECT part, filter_order, good, toxic, fails, coalesce(list_min(list_transform(fails, lambda x: instr(filter_order, x))), 6) AS first FROM f, o),
s AS (SELECT *, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step FROM r),
a AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
    count(*) FILTER (first < step AND list_contains(fails, substr(filter_order, step, 1))) AS redundant, count(*) FILTER (fails = [substr(filter_order, step, 1)]) AS unique_fails,
    count(*) FILTER (first = step AND good = 1) AS good_lost, count(*) FILTER (first = step AND toxic = 1) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM a"""
}
