"""Sharding by proportional stratified interleaving. Native only.

Rows are shuffled by a seeded hash within each source and ranked; the rank's place in its source, as a fraction, orders
all rows, so that any stretch of that order holds every source in its share of the whole. The order is cut into shards
whose row counts differ by one at most.

No window ever holds a whole source: ranks come from hash ranges of about `RANGE_ROWS` rows, whose counts are added up
in a small table, so a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept_columns, materialize, table

SHARDS = 16
SEED = "veilscan"
RANGE_ROWS = 4_000
#: Ranges whose counts are added up in one task: of 10^10 rows, 2,500 groups of 1,000 ranges.
GROUP = 1_000
HASH_BITS = 60


def seeded_hash(seed: str, key: Column) -> Column:
    """60 bits of md5, as a long: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, HASH_BITS // 4), 16, 10).cast("long")


def running(counts: DataFrame, order: str) -> DataFrame:
    """(order, before) from (order, n): the sum of n over all lesser ones.

    Two levels: sums within groups of GROUP neighbours, and over the groups; so a task has GROUP rows, or rows / GROUP.
    """
    grouped = counts.withColumn("g", F.floor(F.col(order) / GROUP))
    lesser = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inner = grouped.withColumn("inner", F.coalesce(F.sum("n").over(lesser(Window.partitionBy("g").orderBy(order))), F.lit(0)))
    groups = grouped.groupBy("g").agg(F.sum("n").alias("of"))
    outer = groups.select("g", F.coalesce(F.sum("of").over(lesser(Window.orderBy("g"))), F.lit(0)).alias("outer"))
    return inner.join(outer, "g").select(order, (F.col("inner") + F.col("outer")).alias("before"))


def assign_shards(rows: DataFrame, key: str, stratum: str, shards: int = SHARDS, seed: str = SEED, ties: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with shard and slot appended (int, long); slots run without gaps from 0 in each shard.

    A null stratum is one of its own, null keys are hashed as empty, and texts may be of any length since they are only
    carried. Rows with equal hashes are ordered by `key` and `ties`; rows that are equal in all of these get places in
    any order. An empty table stays empty. Columns shard and slot of `rows` are replaced, whatever their case; names that
    differ in case only are refused (ValueError).
    """
    kept = kept_columns(rows, "shard", "slot")
    c = lambda name: F.col(f"`{name}`")
    base = rows.select(
        F.struct(*[c(x) for x in kept]).alias("row"), F.coalesce(F.concat(F.lit("="), c(stratum).cast("string")), F.lit("")).alias("s"), seeded_hash(seed, c(key)).alias("h"), F.struct(c(key).alias("k"), *[c(t).alias(f"t{i}") for i, t in enumerate(ties)]).alias("tie"),
    )
    total = base.count()
    if not total:
        return base.select("row.*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = -(-total // RANGE_ROWS)
    ranged = base.withColumn("b", F.floor(F.col("h") / F.lit(float(1 << HASH_BITS)) * ranges).cast("long"))
    within = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("s", "b", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("s")).alias("of"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "tie"))
    ranked = ranged.join(starts, ["s", "b"]).withColumn("f", (2 * rank - 1) / (2 * F.col("of"))).drop("before", "of", "b")
    ranked = materialize(ranked, "shard-ranks").withColumn("b", F.floor(F.col("f") * ranges).cast("long"))

    cuts = ranked.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    at = F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("f", "s", "h", "tie")) - 1
    placed = ranked.join(running(cuts, "b"), "b").withColumn("r", at).withColumn("at", F.expr(f"(r * {shards}) div {total}"))
    return placed.select("row.*", F.col("at").cast("int").alias("shard"), (F.col("r") - F.expr(f"(at * {total} + {shards - 1}) div {shards}")).alias("slot"))


def write_shards(rows: DataFrame, path: str, shards: int = SHARDS, max_rows: int = 1_000_000) -> None:
    """Rows with shard and slot as Parquet, a folder for each shard, in the order of the slots.

    Ranges of slots, not whole shards, go to a task, so a shard may be of any size.
    """
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", max_rows).partitionBy("shard").parquet(path)


def op10_shard_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of `documents`, by the law `rows`. Null texts have the size 1, null sources are a
    stratum of their own, repeated rows get a slot each, an empty table gives no rows."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = assign_shards(materialize(docs, "shard-rows"), "doc_id", "source", ties=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
