"""Counts of graphs, by script and by engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_stats(tables: DataFrame, table_edges: DataFrame, column_edges: DataFrame, picks: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """``(script_id, n_tables, n_table_edges, n_column_edges[, n_needs_parser][, engine])``, a row for each script that has any.

    With ``warnings(script_id, code, ...)`` the statements that were left out as ``needs_parser`` are counted too.
    """
    counted = [(tables, "n_tables"), (table_edges, "n_table_edges"), (column_edges, "n_column_edges")]
    if warnings is not None:
        counted.append((warnings.where("code = 'needs_parser'"), "n_needs_parser"))
    parts = [df.groupBy("script_id").agg(F.count(F.lit(1)).alias(name)) for df, name in counted]
    out = reduce(lambda a, b: a.join(b, "script_id", "full"), parts).fillna(0, [name for _, name in counted])
    return out if picks is None else out.join(picks.select("script_id", "engine"), "script_id", "left")


def engine_stats(stats: DataFrame) -> DataFrame:
    """Totals of :func:`graph_stats` for each engine."""
    return stats.groupBy("engine").agg(
        F.count(F.lit(1)).alias("n_scripts"),
        *[F.sum(c).alias(c) for c in ("n_tables", "n_table_edges", "n_column_edges")],
    )
