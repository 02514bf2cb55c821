"""Sharding along a Hilbert curve: rows that lie close in several dimensions share a shard, so files can be pruned by any of them.

Each dimension is quantised to 2^bits buckets of about equal counts, whose bounds are approximate percentiles (at most
2^bits - 1 numbers a dimension reach the driver, whatever the table's size). A string counts by the rank of its whole value among the distinct values.
The bucket numbers become a Hilbert index; rows are sorted by it across the cluster and cut into runs of equal counts.
A row's place is its partition's first place plus its place there: no row passes through a single task. All of it is
DataFrame functions; rows are spread by the index, the id, the digest and lastly their own position, so neither a hot value nor repeated rows
gather in one partition.

The law is `rows`: shard s of n holds the places ceil(s * N / n) to ceil((s + 1) * N / n) - 1, so counts are at most one apart.
A null dimension is bucket 0 with the smallest values. Null or empty text has no bytes, and the checksum of no bytes; of a very long one only size and checksum are
kept. Ties in all sorting columns are rows alike, repeated rows among them: each has a place of its own. An empty table gives an empty result. Bounds are approximate, and may
differ a little from run to run, and with them the shard of a row; the law holds for any bounds. Columns that start with __tm_ are the operator's own; others pass through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm.common import materialize, plain, read

BITS = 6
SHARDS = 24
_PLACE = 33  # monotonically_increasing_id: the partition above, the row in it below


def as_number(df: DataFrame, name: str) -> Column:
    """A dimension that is no string as a number in its own order."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.coalesce(F.unix_timestamp(F.col(plain(name)).cast("timestamp")), F.lit(-(2**62)))
    return F.coalesce(F.col(plain(name)).cast("double"), F.lit(float("-inf")))


def with_rank(df: DataFrame, name: str, out: str) -> DataFrame:
    """df and the rank of a string among the column's distinct values (a long in their order, -1 for null). A rank is its partition's number above, its place there below, so the values pass through no single task; the join's small side has a row per value and is stored, so a hot value can be split."""
    column = plain(name)
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("__tm_value")).distinct()
    ranks = materialize(values.repartitionByRange("__tm_value").sortWithinPartitions("__tm_value").withColumn("__tm_rank", F.monotonically_increasing_id()), "shard-ranks")
    joined = df.join(ranks, F.col(column) == F.col("__tm_value"), "left")
    return joined.select(*(F.col(plain(c)) for c in df.columns), F.coalesce("__tm_rank", F.lit(-1)).alias(out))


def curve_sql(axes: str, n: int, bits: int) -> str:
    """The place on the Hilbert curve of the point in the array column `axes` (Skilling's transposition), as SQL."""
    if n == 1:
        return f"{axes}[0]"
    bind = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"  # noqa: E731  a value bound once
    steps = ", ".join(f"named_struct('q', {1 << b}L, 'i', {i})" for b in range(bits - 1, 0, -1) for i in range(n))
    levels = ", ".join(f"{1 << b}L" for b in range(bits - 1, 0, -1))
    places = ", ".join(f"named_struct('b', {b}, 'i', {i})" for b in range(bits - 1, -1, -1) for i in range(n))
    undone = f"aggregate(array({steps}), {axes}, (a, s) -> transform(a, (x, j) -> IF((a[s.i] & s.q) != 0L, IF(j = 0, x ^ (s.q - 1L), x), IF(j = 0 OR j = s.i, x ^ ((a[0] ^ a[s.i]) & (s.q - 1L)), x))))" if bits > 1 else axes
    gray = "transform(u, (x, j) -> aggregate(slice(u, 1, j + 1), 0L, (t, y) -> t ^ y))"
    turn = f"aggregate(array({levels}), 0L, (t, q) -> IF((g[{n - 1}] & q) != 0L, t ^ (q - 1L), t))" if bits > 1 else "0L"
    index = f"aggregate(array({places}), 0L, (t, s) -> shiftleft(t, 1) | (shiftright(g[s.i] ^ turn, s.b) & 1L))"
    return bind("u", undone, bind("g", gray, bind("turn", turn, index)))


def _bucket(number: Column, bounds: list) -> Column:
    """How many bounds lie below the number."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: number > b)) if bounds else F.lit(0)


def hilbert_shards(df: DataFrame, dimensions: list[str], tie_breaks: list[str], n_shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """df with __tm_curve (Hilbert index), shard and slot, stored in that order. Columns of these names are replaced."""
    columns = [c for c in df.columns if c not in ("shard", "slot", "__tm_curve")]
    numbers, measured = [f"__tm_d{k}" for k in range(len(dimensions))], df
    for number, name in zip(numbers, dimensions, strict=True):
        measured = with_rank(measured, name, number) if isinstance(df.schema[name].dataType, T.StringType) else measured.withColumn(number, as_number(df, name))
    measured = materialize(measured.select(*(F.col(plain(c)) for c in columns), *numbers), "shard-input")
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    bounds = measured.agg(*(F.percentile_approx(k, cuts, 10_000).alias(k) for k in numbers)).first()
    buckets = [_bucket(F.col(k), sorted(set(bounds[k] or []))) for k in numbers]
    placed = measured.withColumn("__tm_axes", F.array(*(b.cast("long") for b in buckets))).withColumn("__tm_curve", F.expr(curve_sql("__tm_axes", len(buckets), bits)))
    order = ["__tm_curve", *(plain(c) for c in tie_breaks), "__tm_row"]
    placed = placed.withColumn("__tm_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.select(*(F.col(plain(c)) for c in columns), "__tm_curve", F.monotonically_increasing_id().alias("__tm_at")), "shard-order")
    part = F.shiftright("__tm_at", _PLACE)
    # One row per partition of the sort: few, and summed in order.
    sizes = placed.groupBy(part.alias("__tm_part")).agg(F.count("*").alias("n"))
    before = sizes.select("__tm_part", (F.sum("n").over(Window.orderBy("__tm_part")) - F.col("n")).alias("__tm_before"), F.sum("n").over(Window.partitionBy()).alias("__tm_n"))
    out = placed.withColumn("__tm_part", part).join(F.broadcast(before), "__tm_part")
    row = F.col("__tm_before") + F.col("__tm_at").bitwiseAND(F.lit((1 << _PLACE) - 1))
    out = out.withColumn("__tm_place", row).withColumn("shard", F.expr(f"CAST(__tm_place * {n_shards} DIV __tm_n AS INT)"))
    first = F.expr(f"(CAST(shard AS BIGINT) * __tm_n + {n_shards - 1}) DIV {n_shards}")
    return out.withColumn("slot", F.col("__tm_place") - first).select(*(F.col(plain(c)) for c in columns), "__tm_curve", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder per shard, with as many files as it takes; each file has a range of slots, in their order, so a shard of any size is written by many tasks."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("__tm_curve").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        "lang",
        "source",
    )
    docs = docs.withColumn("size", F.col("n_bytes") + 8).drop("n_bytes")
    sharded = hilbert_shards(docs, ["source", "lang", "size"], ["doc_id", "text_crc32"])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_sharding": op2_sharding}
ORACLE_SQL: dict[str, str] = {}
