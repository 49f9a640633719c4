"""Tables as sources: Parquet folders, JDBC databases, and entities of key-value tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .options import Options, quoted, wide_row_limits

# drivers' addresses by kind.
URLS = {"postgresql": "jdbc:postgresql://{host}:{port}/{database}", "mysql": "jdbc:mysql://{host}:{port}/{database}", "mssql": "jdbc:sqlserver://{host}:{port};databaseName={database}", "sqlite": "jdbc:sqlite:{path}"}
PORTS = {"postgresql": 5432, "mysql": 3306, "mssql": 1433}
INIT = {"postgresql": "SET default_transaction_read_only = on; SET statement_timeout = {statement}; SET lock_timeout = {lock}", "mysql": "SET SESSION TRANSACTION READ ONLY", "mssql": "SET LOCK_TIMEOUT {lock}"}


def parquet_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def quoted_for(kind: str, name: str) -> str:
    open_, close = {"mysql": "``", "mssql": "[]"}.get(kind, '""')
    return open_ + name.replace(close, close * 2) + close


def projection(kind: str, table: str, columns: list[tuple[str, bool]], key: list[str], options: Options) -> str:
    """The query a database runs: cells as text and one character longer than wanted, bytes as null, by primary key, one
    row more than wanted. `columns`: names and whether they hold bytes."""
    cell, _ = wide_row_limits(len(columns), options.cell_chars, options.batch_size)
    text = {"postgresql": "LEFT(CAST({} AS text), {})", "mysql": "LEFT(CAST({} AS CHAR), {})", "mssql": "LEFT(CAST({} AS NVARCHAR(MAX)), {})", "sqlite": "substr(CAST({} AS TEXT), 1, {})"}[kind]
    q = lambda c: quoted_for(kind, c)
    picked = ", ".join(f"NULL AS {q(c)}" if binary else f"{text.format(q(c), cell + 1)} AS {q(c)}" for c, binary in columns)
    order = " ORDER BY " + ", ".join(map(q, key)) if key else ""
    n = options.table_sample_rows + 1
    if options.full_scan:
        return f"SELECT {picked} FROM {'.'.join(map(q, table.split('.')))}"
    top, limit = (f"TOP ({n}) ", "") if kind == "mssql" else ("", f" LIMIT {n}")
    return f"SELECT {top}{picked} FROM {'.'.join(map(q, table.split('.')))}{order}{limit}"


def jdbc_table(spark: SparkSession, kind: str, config: dict[str, Any], query: str, options: Options) -> DataFrame:
    """A query's rows, read only and within its time limits. For a full scan of a large table, give `partition_column`,
    `lower`, `upper` and `partitions`: executors then read ranges of their own."""
    url = URLS[kind].format(**{"port": PORTS.get(kind, 0), **config})
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", options.batch_size).option("queryTimeout", max(1, options.statement_timeout_ms // 1000))
    if kind in INIT:
        reader = reader.option("sessionInitStatement", INIT[kind].format(statement=options.statement_timeout_ms, lock=options.lock_timeout_ms))
    for name in ("user", "password"):
        if config.get(name):
            reader = reader.option(name, config[name])
    if options.full_scan and config.get("partition_column"):
        reader = reader.option("dbtable", f"({query}) t").option("partitionColumn", config["partition_column"]).option("lowerBound", config["lower"]).option("upperBound", config["upper"]).option("numPartitions", config["partitions"])
        return reader.load()
    return reader.option("query", query).load()


def inventory(tables: list[tuple[str, str]], limit: int = 1_000) -> list[tuple[str, str, str | None, str | None]]:
    """(name, type, status, reason) of discovered tables: views aren't scanned, and what is past the limit is told."""
    out = [(n, t, *(("excluded", "database_views_not_scanned") if t.upper() == "VIEW" else (None, None))) for n, t in tables[:limit]]
    return out + ([("[coverage]", "", "partial", "database_table_inventory_limit")] if len(tables) > limit else [])


def entities(table: DataFrame, partition: str = "PartitionKey", row: str = "RowKey") -> DataFrame:
    """Each entity is an object: its properties are the columns of a table with one row."""
    keys = F.to_json(F.array(F.col(partition).cast("string"), F.col(row).cast("string")))
    names = [c for c in table.columns]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("property"), F.col(quoted(c)).cast("string").alias("value")) for c in names]))
    return table.select(F.sha2(keys, 256).alias("entity"), each.alias("p")).select("entity", "p.property", "p.value", F.concat(F.lit("property:"), F.col("p.property")).alias("segment"))
