"""Secret scans with ownership frequency: what many owners have in their files is an example, what one owner has looks live.

Candidates are found by regular expressions in whole texts and hashed. Over the corpus, each hash is counted by distinct owners and
repositories. One owner's is live-looking, whatever the number of that owner's repositories. A widely copied example has EXAMPLE_OWNERS owners or more, or
several owners and EXAMPLE_REPOSITORIES repositories or more. In between it is shared. Besides the kinds
assign, access and hex, whose spans always count, the formats of well-known providers and whole private keys (from BEGIN to END, so that each key is a
secret of its own) are candidates; the spans of those that are no examples are added.

DataFrame functions only, and one scan of the texts: each text gives one array with its candidates of all kinds. A text's matches are its split at the pattern
and the matched parts; their lengths in order give the spans, in code points. Texts never move: what is stored and shuffled are lengths and hashes. Counts are
pre-aggregated per (hash, owner, repository), so a hash that all documents share stays small; they are stored before they are joined back,
so that adaptive execution can split the join where one secret has many places.

No pattern searches a stretch of text more than a few times: a token of three parts starts only where its characters start, what is repeated doesn't give back, and a private key's
header has 8 lines of 120 characters at most. So a text's cost is in proportion to its length, whatever is in it.

Null or empty text: no spans. A null owner or repository is one of its own. Rows equal in id and text get equal
results, and count once for their owner. A very long text is searched whole, in one row; its candidates are one array. Other columns are left out,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.llm.common import materialize, plain, read

#: Owners from which on a candidate counts as a widely copied example, and repositories of several owners.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 5

#: Kind, pattern, group of the secret, and its least length. Fixed values.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("vendor", "|".join([
        r"gh[pousr]_[A-Za-z0-9]{36,}", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"sk_live_[A-Za-z0-9]{16,}", r"AIza[A-Za-z0-9_-]{35}",
        r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\x20\x09-\x0D\\nr]*+(?:Proc-Type|DEK-Info)[^\n\\]{0,100}+[\n\\]){0,8}+[A-Za-z0-9+/=\x20\x09-\x0D\\]++-----END [A-Z ]*PRIVATE KEY-----",
    ]), 0, 16),
]
BASE = 3
#: Runs of at least so many characters are the matches of [0-9a-f]+ that count; the search needs no others.
_SEARCH = {"hex": r"[0-9a-f]{32,}", "access": r"AKIA[A-Z0-9]{12,}"}


def _matches(kind: int) -> Column:
    """The matches of a kind in the column text: kind, i (its number), gap before it, size, n (size of the secret) and the secret's digest."""
    name, pattern, group, _ = KINDS[kind]
    pattern = _SEARCH.get(name, pattern)
    pieces, hits = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.transform(F.slice(pieces, 1, F.size(hits)), F.length).alias("gap"), F.transform(hits, F.length).alias("size"), values.alias("value"))
    found = F.transform(zipped, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), m["gap"].alias("gap"), m["size"].alias("size"), F.length(m["value"]).alias("n"), F.sha2(F.concat(F.lit(name + ":"), m["value"]), 256).alias("secret")))
    return F.when(F.col("text").rlike(pattern), found).otherwise(F.array())


def searched(docs: DataFrame, id_column: str = "doc_id", text: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """(id, tie, owner, repository, matches) of each row, stored. tie: the text's hash."""
    owner = F.col("source") if owner is None else owner
    repository = F.col("lang") if repository is None else repository
    slim = docs.select(F.col(plain(id_column)).alias("id"), F.xxhash64(plain(text)).alias("tie"), owner.alias("owner"), repository.alias("repository"), F.col(plain(text)).alias("text"))
    return materialize(slim.select("id", "tie", "owner", "repository", F.concat(*(_matches(k) for k in range(len(KINDS)))).alias("matches")), "searched")


def candidates(rows: DataFrame) -> DataFrame:
    """(id, tie, owner, repository, kind, start, end, secret): the candidates in the rows of searched(), stored."""
    found = rows.where(F.size("matches") > 0).select("id", "tie", "owner", "repository", F.explode("matches").alias("m")).select("id", "tie", "owner", "repository", "m.*")
    order = Window.partitionBy("id", "tie", "owner", "repository", "kind").orderBy("i")
    # Rows equal in all this are one: places would add up otherwise.
    found = found.distinct().withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order))
    least = F.element_at(F.array(*(F.lit(k[3]) for k in KINDS)), F.col("kind") + 1)
    return materialize(found.where(F.col("n") >= least).select("id", "tie", "owner", "repository", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "secret"), "candidates")


def ownership(found: DataFrame) -> DataFrame:
    """(secret, owners, repositories) over the corpus; a repository is one of its owner's."""
    of_owner = found.select("secret", "owner", "repository").distinct().groupBy("secret", "owner").agg(F.count("*").alias("n"))
    return of_owner.groupBy("secret").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def _joined(spans: Column) -> Column:
    """kind:start:end of the spans by start, then kind."""
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", owner: Column | None = None, repository: Column | None = None, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """A row per row of docs: its id, counts of the base kinds, base_spans, spans (with those added), and n_live, n_shared and n_example: secrets of one owner, of several, and copied examples. shared_spans: those of several owners, of any kind."""
    rows = searched(docs, id_column, text, owner, repository)
    found = candidates(rows)
    owned = materialize(ownership(found), "ownership")
    judged = found.join(owned, "secret").select("id", "tie", "kind", "start", "end", "owners", "repositories").distinct()
    span = F.struct("start", "kind", "end")
    base, alone = F.col("kind") < BASE, F.col("owners") == 1
    example = (F.col("owners") >= example_owners) | ((F.col("owners") > 1) & (F.col("repositories") >= example_repositories))
    shared = ~alone & ~example
    counted = judged.where(base | ~example).groupBy("id", "tie").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k][0]}") for k in range(BASE)),
        F.collect_list(F.when(base, span)).alias("base_spans"),
        F.collect_list(span).alias("spans"),
        F.collect_list(F.when(shared, span)).alias("shared_spans"),
        F.count(F.when(alone, 1)).alias("n_live"),
        F.count(F.when(shared, 1)).alias("n_shared"),
        F.count(F.when(example, 1)).alias("n_example"),
    )
    counted = counted.select(F.col("id").alias("__tm_id"), F.col("tie").alias("__tm_tie"), *(f"n_{KINDS[k][0]}" for k in range(BASE)), _joined(F.col("base_spans")).alias("base_spans"), _joined(F.col("spans")).alias("spans"), _joined(F.col("shared_spans")).alias("shared_spans"), "n_live", "n_shared", "n_example")
    out = rows.select("id", "tie").join(counted, F.col("id").eqNullSafe(F.col("__tm_id")) & (F.col("tie") == F.col("__tm_tie")), "left")
    zero, none = F.lit(0).cast("long"), F.lit("")
    return out.select(F.col("id").alias(id_column), *(F.coalesce(c, zero).alias(c) for c in ("n_assign", "n_access", "n_hex")), F.coalesce("base_spans", none).alias("base_spans"), F.coalesce("spans", none).alias("spans"), F.coalesce("shared_spans", none).alias("shared_spans"), *(F.coalesce(c, zero).alias(c) for c in ("n_live", "n_shared", "n_example")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scan(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return done.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_live", "n_example", "n_shared", "shared_spans")


def op6_secret_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class between live and example alone: found with several owners, with no example among them."""
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).select("doc_id", "n_shared", "shared_spans")


QUERIES = {"op6_secret_scan": op6_secret_scan, "op6_secret_shared": op6_secret_shared}


def _kind_sql(kind: int) -> str:
    name, pattern, group, least = KINDS[kind]
    letters = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    pattern = pattern.replace("(?i:password|passwd|secret|token|api_?key)", letters).replace("'", "''")
    # RE2 needs no possessive repetition and has no look-behind: the character before is part of the hit, and no match before has it.
    pattern = pattern.replace("}+", "}").replace("++-----", "+-----").replace("*+", "*").replace("(?<![A-Za-z0-9_-])eyJ", "(?:^|[^A-Za-z0-9_-])eyJ")
    cut = "[regexp_replace(h, '^[^A-Za-z0-9_-]eyJ', 'eyJ') FOR h IN vals]" if name == "vendor" else "vals"
    return f"""k{kind} AS (SELECT doc_id, source, lang, {kind} AS kind, upto - {'length(value)' if name == 'vendor' else 'size'} AS start, upto AS "end", '{name}:' || value AS secret FROM (
  SELECT doc_id, source, lang, size, value, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
    SELECT doc_id, source, lang, unnest(range(len(hits))) AS i, unnest([length(x) FOR x IN pieces[1:len(hits)]]) AS gap, unnest([length(x) FOR x IN hits]) AS size, unnest({cut}) AS value FROM (
      SELECT doc_id, source, lang, string_split_regex(text, '{pattern}') AS pieces, regexp_extract_all(text, '{pattern}', 0) AS hits, regexp_extract_all(text, '{pattern}', {group}) AS vals
      FROM documents WHERE regexp_matches(text, '{pattern}')))) WHERE length(value) >= {least})"""


_NAMES = "[" + ", ".join(f"'{k[0]}'" for k in KINDS) + "]"
_FOUND = f"""
WITH {", ".join(_kind_sql(k) for k in range(len(KINDS)))},
found AS ({" UNION ALL ".join(f"SELECT * FROM k{k}" for k in range(len(KINDS)))}),
owned AS (SELECT secret, owners, owners >= {EXAMPLE_OWNERS} OR owners > 1 AND repositories >= {EXAMPLE_REPOSITORIES} AS example FROM (
  SELECT secret, count(DISTINCT coalesce(source, '-none')) AS owners, count(DISTINCT (source, lang)) AS repositories FROM found GROUP BY secret)),
judged AS (SELECT *, {_NAMES}[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT) AS name FROM found JOIN owned USING (secret) WHERE kind < {BASE} OR NOT example)"""
ORACLE_SQL = {
    "op6_secret_scan": f"""{_FOUND},
counted AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{KINDS[k][0]}" for k in range(BASE))},
  string_agg(name, ',' ORDER BY start, kind) FILTER (kind < {BASE}) AS base, string_agg(name, ',' ORDER BY start, kind) AS spans,
  count(*) FILTER (owners = 1) AS n_live, count(*) FILTER (example) AS n_example,
  count(*) FILTER (owners > 1 AND NOT example) AS n_shared, string_agg(name, ',' ORDER BY start, kind) FILTER (owners > 1 AND NOT example) AS shared_spans FROM judged GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{KINDS[k][0]}, 0) AS n_{KINDS[k][0]}" for k in range(BASE))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_shared, 0) AS n_shared, coalesce(shared_spans, '') AS shared_spans FROM documents d LEFT JOIN counted USING (doc_id)""",
    "op6_secret_shared": f"""{_FOUND},
counted AS (SELECT doc_id, count(*) AS n_shared, string_agg(name, ',' ORDER BY start, kind) AS shared_spans FROM judged WHERE owners > 1 AND NOT example GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_shared, 0) AS n_shared, coalesce(shared_spans, '') AS shared_spans FROM documents d LEFT JOIN counted USING (doc_id)""",
}
