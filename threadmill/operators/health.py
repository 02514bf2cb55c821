"""Health checks: each returns findings (check, subject, detail), nothing where all is well."""

from __future__ import annotations

import tomllib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.operators import chunks as chunked
from threadmill.operators import fulltext
from threadmill.operators.filters import minus
from threadmill.operators.maintenance import stale_session_counts
from threadmill.plans.tables import settled
from threadmill.schema import SCHEMAS, Store

SCHEMA = "check string, subject string, detail string"


def _findings(rows: DataFrame, check: str, subject: str, detail) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.col(subject).cast("string").alias("subject"), detail.cast("string").alias("detail"))


def _said(spark: SparkSession, check: str, subject: str | None = None, detail: str = "") -> DataFrame:
    return spark.createDataFrame([(check, subject, detail)] if subject is not None else [], SCHEMA)


def ingest_pending(store: Store, discovered: DataFrame) -> DataFrame:
    """CHK-01: files found (harness, path) that were never ingested, by harness."""
    rows = discovered.join(store["ingested_files"].select("path"), "path", "left_anti").groupBy("harness").agg(F.count("*").alias("n"))
    return _findings(rows, "ingest-pending", "harness", F.col("n"))


def ingest_errors(store: Store, examples: int = 5) -> DataFrame:
    """CHK-02: failed files by harness, the first paths named."""
    rows = store["ingested_files"].where("error IS NOT NULL").join(store["harnesses"].select(F.col("id").alias("harness_id"), F.col("name").alias("harness")), "harness_id", "left")
    from pyspark.sql import Window

    first = rows.withColumn("n", F.count("*").over(Window.partitionBy("harness"))).withColumn("k", F.row_number().over(Window.partitionBy("harness").orderBy("path"))).where(F.col("k") <= examples)
    out = first.groupBy("harness").agg(F.first("n").alias("n"), F.array_join(F.sort_array(F.collect_list("path")), ", ").alias("paths"))
    return _findings(out, "ingest-errors", "harness", F.concat_ws(": ", F.col("n"), F.col("paths")))


def embeddings_available(spark: SparkSession, load: Callable | None) -> DataFrame:
    """CHK-03."""
    return _said(spark, "embeddings-available") if load else _said(spark, "embeddings-available", "backend", "no embedding function is given")


def embeddings_compatible(store: Store, backend: str, model: str, dimension: int) -> DataFrame:
    """CHK-04."""
    meta = {r["key"]: r["value"] for r in store["index_meta"].collect()}  # a handful
    try:
        chunked.check_compatible(meta, backend, model, dimension)
    except ValueError as e:
        return _said(store["index_meta"].sparkSession, "embeddings-compat", "index", str(e))
    return _said(store["index_meta"].sparkSession, "embeddings-compat")


def embeddings_stale(store: Store) -> DataFrame:
    """CHK-05: conversations without a chunk."""
    return _findings(chunked.stale_conversations(store["conversations"], store["chunks"]), "embeddings-stale", "id", F.lit("not indexed"))


def orphaned_chunks(store: Store) -> DataFrame:
    """CHK-06: conversations that chunks name and that don't exist, with their number."""
    rows = store["chunks"].join(store["conversations"].select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti").groupBy("conversation_id").agg(F.count("*").alias("n"))
    return _findings(rows, "orphaned-chunks", "conversation_id", F.col("n"))


def pricing_gaps(store: Store) -> DataFrame:
    """CHK-07, JON-08: models and providers in use without a price. A response without a provider is covered by any price of its model."""
    used = store["responses"].where("model_id IS NOT NULL").select("model_id", "provider_id").distinct()
    price = store["pricing"].select(F.col("model_id").alias("m"), F.col("provider_id").alias("p"))
    gaps = used.join(price, (F.col("model_id") == F.col("m")) & (F.col("provider_id").isNull() | (F.col("provider_id") == F.col("p"))), "left_anti")
    names = gaps.join(store["models"].select(F.col("id").alias("model_id"), "raw_name"), "model_id").join(store["providers"].select(F.col("id").alias("provider_id"), F.col("name").alias("provider")), "provider_id", "left")
    return _findings(names, "pricing-gaps", "raw_name", F.coalesce("provider", F.lit("")))


def queries_valid(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """CHK-08: query texts that Spark can't parse."""
    bad = []
    for name, text in texts.items():
        try:
            spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        except Exception as e:  # noqa: BLE001
            bad.append(("drop-ins-valid", name, str(e).splitlines()[0]))
    return spark.createDataFrame(bad, SCHEMA)


def schema_current(store: Store) -> DataFrame:
    """CHK-10: tables and columns that differ from this version's."""
    bad = []
    for name, schema in SCHEMAS.items():
        if name not in store:
            bad.append(("schema-current", name, "missing"))
        else:
            have = {f.name: f.dataType.simpleString() for f in store[name].schema}
            bad += [("schema-current", f"{name}.{f.name}", have.get(f.name, "missing")) for f in schema if have.get(f.name) != f.dataType.simpleString()]
    return next(iter(store.values())).sparkSession.createDataFrame(bad, SCHEMA)


def pending_tags(store: Store, cutoff: str) -> DataFrame:
    """CHK-11: what STR-07 would expire."""
    rows = stale_session_counts(store, cutoff).where("sessions + tags > 0").withColumn("subject", F.lit("sessions, tags"))
    return _findings(rows, "pending-tags", "subject", F.concat_ws(", ", "sessions", "tags"))


def fts_stale(store: Store, index: fulltext.Index) -> DataFrame:
    """CHK-12, CHK-13: the full-text index against what it should hold."""
    return _findings(fulltext.stale(index, fulltext.content(store)), "fts-stale", "content_id", F.col("finding"))


def config_valid(spark: SparkSession, text: str) -> DataFrame:
    """CHK-14: a configuration that isn't TOML."""
    try:
        tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        return _said(spark, "config-valid", "config", str(e))
    return _said(spark, "config-valid")


def run(spark: SparkSession, checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """EXT-05: the findings of all checks. Each check is run by itself, here, so that one that fails, when it is built or when it runs, is a finding and hides no other."""
    out = spark.createDataFrame([], SCHEMA)
    for name, check in checks.items():
        try:
            found = settled(check().select("check", "subject", "detail"), "check")
        except Exception as e:  # noqa: BLE001  one check's failure doesn't hide the others
            found = _said(spark, name, "error", str(e).splitlines()[0])
        out = out.union(found)
    return out


def unused_workspaces(store: Store) -> DataFrame:
    """Ids of workspaces without a conversation."""
    return minus(store["workspaces"], store["conversations"].select(F.col("workspace_id").alias("id")))
