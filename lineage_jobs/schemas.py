"""Schemas, fixed values and ranks that the modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Engines in the order in which they are tried.
ENGINE_ORDER = ["datax", "sqllineage", "sqlglot", "druid", "ai"]
ENGINE_RANK = {name: k for k, name in enumerate(ENGINE_ORDER, 1)}



def engine_ranks(further: dict[str, str]) -> dict[str, int]:
    """The ranks of all engines where each of ``further`` is tried right before the engine that it names."""
    order = list(ENGINE_ORDER)
    for name, before in further.items():
        if name in order:
            raise ValueError(f"there is an engine {name} already")
        order.insert(order.index(before), name)
    return {name: k for k, name in enumerate(order, 1)}


ROLES = ["source", "target", "intermediate"]

#: Columns listed for a table, and characters of a script in a prompt.
MAX_COLUMNS, MAX_PROMPT_CHARS = 80, 8000

# Dialects with the names that the engines have for them.
DIALECT_COLUMNS = ["key", "label", "sqllineage", "sqlglot", "formatter", "druid"]
DIALECTS = [
    ("mysql", "MySQL", "mysql", "mysql", "mysql", "mysql"),
    ("postgresql", "PostgreSQL", "postgres", "postgres", "postgresql", "postgresql"),
    ("oracle", "Oracle", "oracle", "oracle", "plsql", "oracle"),
    ("sqlserver", "SQL Server", "tsql", "tsql", "transactsql", "sqlserver"),
    ("hive", "Hive", "hive", "hive", "hive", "hive"),
    ("spark", "Spark SQL", "sparksql", "spark", "spark", "hive"),
    ("clickhouse", "ClickHouse", "clickhouse", "clickhouse", "clickhouse", "clickhouse"),
    ("sqlite", "SQLite", "sqlite", "sqlite", "sqlite", "sqlite"),
    ("mariadb", "MariaDB", "mariadb", "mariadb", "mariadb", "mysql"),
    ("trino", "Trino/Presto", "trino", "trino", "trino", "presto"),
    ("duckdb", "DuckDB", "duckdb", "duckdb", "duckdb", "postgresql"),
    ("bigquery", "BigQuery", "bigquery", "bigquery", "bigquery", "mysql"),
    ("db2", "DB2", "ansi", "db2", "db2", "db2"),
    ("ansi", "ANSI (通用)", "ansi", None, "sql", "mysql"),
]
DEFAULT_DIALECT = "mysql"

#: How dialects quote. In the first a backslash escapes and double quotes hold text too; in the second a backslash escapes and double quotes hold
#: names; in the third a backslash is a character like others and double quotes hold names.
QUOTED_TEXT_DIALECTS = ["mysql", "mariadb", "hive", "spark", "bigquery"]
BACKSLASH_DIALECTS = ["clickhouse"]
STANDARD_DIALECTS = ["postgresql", "oracle", "sqlserver", "sqlite", "trino", "duckdb", "db2", "ansi"]

#: A graph as one JSON document.
GRAPH_SCHEMA = (
    "error string, tables array<struct<id:string,name:string,role:string,columns:array<string>>>, "
    "table_edges array<struct<source:string,target:string>>, "
    "column_edges array<struct<source_table:string,source_column:string,target_table:string,target_column:string>>, "
    "warnings array<string>"
)
EDGE_PARTS = ["source_table", "source_column", "target_table", "target_column"]


def dialect_table(spark: SparkSession) -> DataFrame:
    """The dialects as a table of 14 rows."""
    return spark.createDataFrame(DIALECTS, ", ".join(f"`{c}` string" for c in DIALECT_COLUMNS))
