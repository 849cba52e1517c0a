"""The normaliser: roles, edge deduplication, column catalogue, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineage_jobs.runtime import strip
from lineage_jobs.schemas import EDGE_PARTS, MAX_COLUMNS


def role_merge(role_events: DataFrame, strict: bool = False) -> DataFrame:
    """``(script_id, id, role)`` from rows ``(script_id, tbl, role, seq)``; blank names are dropped.

    By default the order of the events doesn't matter: a table is ``intermediate`` if declared so or if seen as both
    source and target. With ``strict`` the events are folded in the order of ``seq``: source and target make
    ``intermediate``, a later ``target`` replaces any other role, every other role leaves what is there.
    """
    events = role_events.withColumn("id", strip(F.col("tbl"))).where("id <> ''")
    if not strict:
        seen = lambda role: F.bool_or(F.col("role") == role)
        role = F.when(seen("intermediate") | (seen("source") & seen("target")), "intermediate").when(seen("target"), "target").otherwise("source")
        return events.groupBy("script_id", "id").agg(role.alias("role"))
    roles = F.transform(F.sort_array(F.collect_list(F.struct("seq", "role"))), lambda x: x["role"])

    def fold(old, new):
        both = (old.isin("source", "target") & new.isin("source", "target")) & (old != new)
        return F.when(old == "", new).when(old == new, old).when(both, "intermediate").when(new == "target", "target").otherwise(old)

    return events.groupBy("script_id", "id").agg(F.aggregate(roles, F.lit(""), fold).alias("role"))


def role_last_write(role_events: DataFrame) -> DataFrame:
    """``(script_id, id, role)``: the role written last to each table."""
    return role_events.groupBy("script_id", F.col("tbl").alias("id")).agg(F.max_by("role", "seq").alias("role"))


def table_edge_dedup(table_edges: DataFrame) -> DataFrame:
    """``(script_id, source, target, seq)``: stripped edges, once each, without blank ends and self edges.

    Case counts; ``seq`` is that of the first occurrence.
    """
    return (
        table_edges.select("script_id", "seq", strip(F.col("source")).alias("source"), strip(F.col("target")).alias("target"))
        .where("source <> '' and target <> '' and source <> target")
        .groupBy("script_id", "source", "target")
        .agg(F.min("seq").alias("seq"))
    )


def column_edge_dedup(column_edges: DataFrame) -> DataFrame:
    """``(script_id, source_table, source_column, target_table, target_column, seq)``: edges, once each.

    Case doesn't count, the first spelling stays; rows with a blank part go, self edges stay.
    """
    stripped = column_edges.select("script_id", "seq", *[strip(F.col(c)).alias(c) for c in EDGE_PARTS])
    kept = stripped.where(" and ".join(f"{c} <> ''" for c in EDGE_PARTS))
    keys = [F.lower(c).alias(f"k{n}") for n, c in enumerate(EDGE_PARTS)]
    first = kept.groupBy("script_id", *keys).agg(F.min(F.struct("seq", *EDGE_PARTS)).alias("x"))
    return first.select("script_id", *[f"x.{c}" for c in EDGE_PARTS], "x.seq")


def table_columns(declared: DataFrame, column_edges: DataFrame) -> DataFrame:
    """``(script_id, tbl, col, seq)``: the declared columns and both ends of column edges, once each, case counting.

    ``declared(script_id, tbl, col, seq)``; declared columns come before those of edges.
    """
    ends = column_edges.select(
        "script_id",
        "seq",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("end"), F.col("source_table").alias("tbl"), F.col("source_column").alias("col")),
                F.struct(F.lit(1).alias("end"), F.col("target_table").alias("tbl"), F.col("target_column").alias("col")),
            )
        ).alias("x"),
    ).select("script_id", "x.tbl", "x.col", F.struct(F.lit(1).alias("phase"), F.col("seq").cast("long").alias("row"), "x.end").alias("seq"))
    stated = declared.select("script_id", "tbl", "col", F.struct(F.lit(0).alias("phase"), F.col("seq").cast("long").alias("row"), F.lit(0).alias("end")).alias("seq"))
    return (
        stated.unionByName(ends)
        .withColumn("tbl", strip(F.col("tbl")))
        .withColumn("col", strip(F.col("col")))
        .where("tbl <> '' and col <> ''")
        .groupBy("script_id", "tbl", "col")
        .agg(F.min("seq").alias("seq"))
    )


def column_order(columns: DataFrame) -> DataFrame:
    """``columns`` with ``ord`` from 1 within each table: ``*`` last, the others by lower-cased name, then ``seq``."""
    order = Window.partitionBy("script_id", "tbl").orderBy(F.col("col") == "*", F.lower("col"), "seq", "col")
    return columns.withColumn("ord", F.row_number().over(order))


def column_cap(ordered: DataFrame, most: int = MAX_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` columns of each table, and ``(script_id, tbl, n_columns)`` of the tables that lost some."""
    cut = ordered.groupBy("script_id", "tbl").agg(F.count(F.lit(1)).alias("n_columns")).where(F.col("n_columns") > most)
    return ordered.where(F.col("ord") <= most), cut


def table_order(tables: DataFrame) -> DataFrame:
    """``tables`` with ``ord`` from 1 within each script: target, intermediate, source; then lower-cased id, then id."""
    rank = F.when(F.col("role") == "target", 0).when(F.col("role") == "intermediate", 1).otherwise(2)
    return tables.withColumn("ord", F.row_number().over(Window.partitionBy("script_id").orderBy(rank, F.lower("id"), "id")))


def role_events(declared: DataFrame, table_edges: DataFrame, column_edges: DataFrame) -> DataFrame:
    """``(script_id, tbl, role, seq)`` in the order that the fold needs: declared tables, table edges, column edges."""
    at = lambda phase, end: F.struct(F.lit(phase).alias("phase"), F.col("seq").cast("long").alias("row"), F.lit(end).alias("end")).alias("seq")
    out = declared.select("script_id", F.col("id").alias("tbl"), F.coalesce("role", F.lit("source")).alias("role"), at(0, 0))
    for phase, edges, ends in ((1, table_edges, ("source", "target")), (2, column_edges, ("source_table", "target_table"))):
        for end, (name, role) in enumerate(zip(ends, ("source", "target"), strict=True)):
            out = out.unionByName(edges.select("script_id", F.col(name).alias("tbl"), F.lit(role).alias("role"), at(phase, end)))
    return out


def normalize_graph(declared: DataFrame, table_edges: DataFrame, column_edges: DataFrame, strict: bool = False) -> dict[str, DataFrame]:
    """The normalised graph tables of all scripts: tables, table_columns, table_edges, column_edges, cut.

    ``declared(script_id, id, role, columns, seq)`` may list columns. Every grouping has the script first, so the
    rows are dealt once for each of the inputs.
    """
    tables_once = table_edge_dedup(table_edges)
    columns_once = column_edge_dedup(column_edges)
    roles = role_merge(role_events(declared, tables_once, columns_once), strict)
    listed = declared.select("script_id", F.col("id").alias("tbl"), F.explode("columns").alias("col"), F.col("seq").cast("long").alias("seq"))
    kept, cut = column_cap(column_order(table_columns(listed, columns_once)))
    return {
        "tables": table_order(roles),
        "table_columns": kept.select("script_id", "tbl", "col", "ord"),
        "table_edges": tables_once,
        "column_edges": columns_once,
        "cut": cut,
    }
