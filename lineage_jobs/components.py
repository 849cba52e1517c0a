"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineage_jobs.runtime import broadcast_if_small, materialize, release

#: Rows of node and least neighbour up to which they are broadcast; nodes may be structs with names.
MAX_BROADCAST = 200_000


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).head()
    return row["n"], row["h"]


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of its neighbourhood; ``n`` edges."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = broadcast_if_small(least, 2 * n, MAX_BROADCAST)  # at most a row for each end
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them; ``n`` edges at most."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(broadcast_if_small(least, n, MAX_BROADCAST), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(
    edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60
) -> DataFrame:
    """``(node, component)`` for each node that has an edge to another node; component = its smallest node.

    Edges are undirected; rows with a null end, self edges and repeated edges count for nothing. The nodes may
    be of any type with an order. Each step is a map-side combined minimum and an equi-join, so a hub's
    neighbours are never gathered; the number of rounds grows with the logarithm of the longest path.
    Every round is written to the shared folder (see :mod:`lineage_jobs.runtime`). An edge table without
    usable rows gives an empty result.
    """
    a, b = F.col(src), F.col(dst)
    now = materialize(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        following = materialize(_small_star(_large_star(now, state[0]), 2 * state[0]))
        after = _state(following)
        release(now)
        now = following
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
