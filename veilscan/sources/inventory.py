"""What a database says of itself, as tables: which tables a scan may read, by what columns and key, and a row for each
that it may not. Metadata come as DataFrames, from JDBC or from files; at most MAX_TABLES tables go on to a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import location
from ..operators.columns import missing_tables, selected_tables
from .options import Options
from .tables import projection

# Bounds, statuses and reasons; privileges that only read; types whose cells are bytes.
MAX_TABLES = 1_000
FAILED, ABSENT, VIEW, ENGINE, LIMIT = "table_query_or_detection_failed", "requested_table_not_discovered", "database_views_not_scanned", "mysql_storage_engine_not_supported", "database_table_inventory_limit"
READING = ("SELECT", "USAGE", "CONNECT", "SHOW VIEW", "VIEW DEFINITION")
BYTES = ("binary", "varbinary", "image", "timestamp", "rowversion", "tinyblob", "blob", "mediumblob", "longblob", "bytea")


def judged(discovered: DataFrame, kind: str, requested: DataFrame | None = None, grants: DataFrame | None = None) -> DataFrame:
    """(table, location, status, reason): a null status is a table to scan.

    discovered: (table, type, engine). requested: (table), or None for all. grants: (table, privilege); a table that the
    account may do more with than read isn't read. Beyond MAX_TABLES by name there is one row `[inventory]`. Requested
    tables that weren't discovered have a row each. Tables without a name are left out; a name twice counts once.
    """
    known = discovered.where("table is not null").groupBy("table").agg(F.max("type").alias("type"), F.max("engine").alias("engine"))
    scope = known if requested is None else selected_tables(known, requested)
    listed = scope.orderBy("table").limit(MAX_TABLES + 1)
    first = listed.orderBy("table").limit(MAX_TABLES)
    first = first.withColumn("more", F.lit(False)) if grants is None else first.join(grants.groupBy("table").agg(F.max(~F.upper("privilege").isin(*READING)).alias("more")), "table", "left")
    status = F.when(F.col("type") != "BASE TABLE", F.struct(F.lit("excluded"), F.lit(VIEW))).when((F.lit(kind) == "mysql") & (F.lower(F.coalesce("engine", F.lit(""))) != "innodb"), F.struct(F.lit("unsupported"), F.lit(ENGINE))).when(F.col("more"), F.struct(F.lit("failed"), F.lit(FAILED)))
    rows = first.select("table", location(F.col("table")).alias("location"), status.alias("s")).select("table", "location", F.col("s.col1").alias("status"), F.col("s.col2").alias("reason"))
    none = F.lit(None).cast("string").alias("table")
    beyond = listed.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_TABLES).select(none, F.lit("[inventory]").alias("location"), F.lit("partial").alias("status"), F.lit(LIMIT).alias("reason"))
    out = rows.unionByName(beyond)
    return out if requested is None else out.unionByName(missing_tables(requested.where("table is not null"), known).select(none, "location", "status", "reason"))


def described(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(table, columns: (name, binary), key) of (table, column, type, position) and of the keys' (table, column, position);
    both lists by position, a table without a key has an empty one."""
    placed = lambda *c: F.array_sort(F.collect_list(F.struct("position", *c)))
    binary = F.lower("type").isin(*BYTES).alias("binary")
    c = columns.groupBy("table").agg(F.transform(placed(F.col("column").alias("name"), binary), lambda x: F.struct(x["name"].alias("name"), x["binary"].alias("binary"))).alias("columns"))
    k = keys.groupBy("table").agg(F.transform(placed("column"), lambda x: x["column"]).alias("key"))
    return c.join(k, "table", "left").withColumn("key", F.coalesce("key", F.array().cast("array<string>")))


def queries_of(tables: DataFrame, shapes: DataFrame, kind: str, options: Options) -> tuple[dict[str, str], list[str]]:
    """What `scan` takes as `queries` for the tables to scan of `judged`, and the names of those without columns. Only these
    names, at most MAX_TABLES, come to the driver."""
    rows = tables.where("status is null").select("table").join(shapes, "table", "left").collect()
    queries = {r["table"]: projection(kind, r["table"], [(c["name"], c["binary"]) for c in r["columns"]], r["key"], options) for r in rows if r["columns"]}
    return queries, sorted(r["table"] for r in rows if not r["columns"])
