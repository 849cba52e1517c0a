"""Reachability over lineage graphs: closures, reach with depth, components, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lineage_jobs.components import connected_components
from lineage_jobs.runtime import broadcast_if_small, materialize
from lineage_jobs.schemas import EDGE_PARTS


#: Scripts with up to so many edges, copies counted, are closed in one row each; larger ones by steps over all their edges at once.
SMALL_SCRIPT = 200


def _component_of_seeds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The nodes that undirected paths join to a seed. ``edges(src, dst)``, ``seeds(node)``; nodes are structs."""
    large = materialize(edges.groupBy("src.script_id").count().where(F.col("count") > SMALL_SCRIPT).select("script_id"))
    n = large.count()
    if not n:
        return _closed_by_row(edges, seeds)
    few = broadcast_if_small(large.withColumn("large", F.lit(True)), n)
    parted = lambda rows, node: rows.withColumn("script_id", F.col(node)["script_id"]).join(few, "script_id", "left").drop("script_id")
    part = lambda rows, node, which: parted(rows, node).where(which).drop("large")
    return _closed_by_row(part(edges, "src", "large is null"), part(seeds, "node", "large is null")).unionByName(
        _closed_by_steps(part(edges, "src", "large"), part(seeds, "node", "large"))
    )


def _closed_by_row(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """:func:`_component_of_seeds` of scripts of few edges: each edge joins the components that it touches."""
    kind = seeds.schema["node"].dataType
    graphs = edges.groupBy(F.col("src.script_id").alias("script_id")).agg(F.collect_set(F.struct("src", "dst")).alias("links"))
    wanted = seeds.groupBy(F.col("node.script_id").alias("script_id")).agg(F.collect_set("node").alias("seeds"))
    touched = lambda c, e: F.array_contains(c, e["src"]) | F.array_contains(c, e["dst"])

    def joined(parts, e):
        met = F.flatten(F.filter(parts, lambda c: touched(c, e)))
        return F.concat(F.filter(parts, lambda c: ~touched(c, e)), F.array(F.array_distinct(F.concat(met, F.array(e["src"], e["dst"])))))

    parts = F.aggregate("links", F.array().cast(ArrayType(ArrayType(kind))), joined)
    reached = F.flatten(F.filter(parts, lambda c: F.arrays_overlap(c, F.col("seeds"))))
    every = F.when(F.col("links").isNull(), F.col("seeds")).otherwise(F.array_union(reached, F.col("seeds")))
    return wanted.join(graphs, "script_id", "left").select(F.explode(every).alias("node"))


def _closed_by_steps(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """:func:`_component_of_seeds` by joins, for scripts of any size."""
    scripts = materialize(seeds.select("node.script_id").distinct())  # scripts are graphs of their own
    few = broadcast_if_small(scripts, scripts.count())
    near = materialize(edges.withColumn("script_id", F.col("src.script_id")).join(few, "script_id", "left_semi").select("src", "dst").distinct())
    # components are found over numbers, whose minima are hashed and not sorted; the written table keeps the numbers as they are
    every = near.select(F.col("src").alias("node")).unionByName(near.select(F.col("dst").alias("node"))).distinct()
    numbered = materialize(every.withColumn("number", F.monotonically_increasing_id()))
    end = lambda c: numbered.select(F.col("node").alias(c), F.col("number").alias(f"{c}_number"))
    links = near.join(end("src"), "src").join(end("dst"), "dst").select("src_number", "dst_number")
    parts = materialize(connected_components(links, "src_number", "dst_number"))
    met = seeds.distinct().join(numbered, "node").select(F.col("number").alias("node"))
    chosen = parts.join(met, "node", "left_semi").select("component").distinct()
    reached = parts.join(chosen, "component", "left_semi").select(F.col("node").alias("number")).join(numbered, "number").select("node")
    return reached.unionByName(seeds.select("node")).distinct()


def table_closure(table_edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes(script_id, id)`` and ``edges(script_id, source, target)`` joined to the seeds, directions ignored.

    ``seeds(script_id, id)``. The closure of a node is its connected component, so that the number of rounds grows with the
    logarithm of its width. A seed without edges stands alone.
    """
    node = lambda c: F.struct("script_id", F.col(c).alias("id"))
    nodes = _component_of_seeds(
        table_edges.select(node("source").alias("src"), node("target").alias("dst")), seeds.select(node("id").alias("node"))
    ).select("node.script_id", "node.id")
    ends = nodes.withColumnRenamed("id", "source")
    return nodes, table_edges.select("script_id", "source", "target").distinct().join(ends, ["script_id", "source"], "left_semi")


def column_closure(column_edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``keys(script_id, tbl, col)``, ``tables(script_id, tbl)`` and ``edges`` joined to the seed columns.

    ``seeds(script_id, tbl, col)``. Case counts in table names but not in column names.
    """
    node = lambda t, c: F.struct("script_id", F.col(t).alias("tbl"), F.lower(c).alias("col"))
    keys = _component_of_seeds(
        column_edges.select(node("source_table", "source_column").alias("src"), node("target_table", "target_column").alias("dst")),
        seeds.select(node("tbl", "col").alias("node")),
    ).select("node.script_id", "node.tbl", "node.col")
    source = keys.select("script_id", F.col("tbl").alias("source_table"), F.col("col").alias("k"))
    edges = column_edges.withColumn("k", F.lower("source_column")).join(source, ["script_id", "source_table", "k"], "left_semi").drop("k")
    return keys, keys.select("script_id", "tbl").distinct(), edges


def lineage_reach(edges: DataFrame, seeds: DataFrame, direction: str = "downstream", max_rounds: int = 1000) -> DataFrame:
    """``(script_id, id, depth)``: what can be reached along the edges (``downstream``) or against them (``upstream``).

    ``edges(script_id, source, target)``, ``seeds(script_id, id)``; the depth is the length of the shortest path.
    One round for each depth joins the new nodes with the edges; the loop ends when a round finds none.
    """
    here, there = ("source", "target") if direction == "downstream" else ("target", "source")
    steps = edges.select("script_id", F.col(here).alias("id"), F.col(there).alias("next")).distinct()
    front = materialize(seeds.select("script_id", "id").distinct().withColumn("depth", F.lit(0)))
    seen = front
    for depth in range(1, max_rounds + 1):
        found = (
            steps.join(front, ["script_id", "id"])
            .select("script_id", F.col("next").alias("id"))
            .distinct()
            .join(seen, ["script_id", "id"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        front = materialize(found)
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError(f"there is more to reach after {max_rounds} rounds")


def closure_components(table_edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every table of the corpus that has an edge to another; component = its least name."""
    return connected_components(table_edges, "source", "target").withColumnRenamed("node", "id")


def table_column_edges(column_edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The column edges that start or end at the seed tables, and ``(script_id, id)`` of their two ends.

    ``seeds(script_id, id)``; distinct edges.
    """
    edges = column_edges.select("script_id", *EDGE_PARTS).distinct()
    at = lambda c: seeds.select("script_id", F.col("id").alias(c)).distinct()
    touched = (
        edges.join(at("source_table"), ["script_id", "source_table"], "left_semi")
        .unionByName(edges.join(at("target_table"), ["script_id", "target_table"], "left_semi"))
        .distinct()
    )
    ends = touched.select("script_id", F.explode(F.array("source_table", "target_table")).alias("id")).distinct()
    return touched, ends


def edge_focus(edges: DataFrame, chosen: DataFrame, grain: str = "table") -> tuple[DataFrame, DataFrame]:
    """Edges and tables to show for chosen edges, one or more a script.

    At the ``table`` grain these are the chosen edges and their ends; at the ``column`` grain the closure of the
    chosen edges' source columns.
    """
    if grain == "table":
        kept = edges.select("script_id", "source", "target").distinct().join(chosen, ["script_id", "source", "target"], "left_semi")
        return kept, kept.select("script_id", F.explode(F.array("source", "target")).alias("id")).distinct()
    seeds = chosen.select("script_id", F.col("source_table").alias("tbl"), F.col("source_column").alias("col"))
    _, tables, kept = column_closure(edges, seeds)
    return kept, tables.withColumnRenamed("tbl", "id")


def closure_flag(edges: DataFrame, selection: DataFrame, keys: list[str]) -> DataFrame:
    """``edges`` with ``selected``: whether ``selection`` has a row of the same ``keys``."""
    marks = selection.select(*keys).distinct().withColumn("mark", F.lit(True))
    return edges.join(marks, keys, "left").withColumn("selected", F.col("mark").isNotNull()).drop("mark")


def graph_at_grain(table_edges: DataFrame, column_edges: DataFrame, mode: str = "table") -> DataFrame:
    """``(script_id, source, target, source_column, target_column)``: a row for each table edge, or each column edge."""
    if mode == "table":
        none = F.lit(None).cast("string")
        return table_edges.select("script_id", "source", "target", none.alias("source_column"), none.alias("target_column"))
    return column_edges.select("script_id", F.col("source_table").alias("source"), F.col("target_table").alias("target"), "source_column", "target_column")


def edge_column_ordinals(column_edges: DataFrame, table_columns: DataFrame) -> DataFrame:
    """``column_edges`` with ``src_ord`` and ``tgt_ord``, the positions of their columns in the tables' lists.

    Case doesn't count in column names; the first match stands; null where the list lacks the column.
    """
    first = table_columns.groupBy("script_id", "tbl", F.lower("col").alias("k")).agg(F.min("ord").alias("ord"))
    side = lambda t, out: first.select("script_id", F.col("tbl").alias(t), F.col("k").alias(f"{t}_k"), F.col("ord").alias(out))
    return (
        column_edges.withColumn("source_table_k", F.lower("source_column"))
        .withColumn("target_table_k", F.lower("target_column"))
        .join(side("source_table", "src_ord"), ["script_id", "source_table", "source_table_k"], "left")
        .join(side("target_table", "tgt_ord"), ["script_id", "target_table", "target_table_k"], "left")
        .drop("source_table_k", "target_table_k")
    )
