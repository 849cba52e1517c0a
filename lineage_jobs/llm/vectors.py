"""Embedding tables on an integer grid, which the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineage_jobs.runtime import materialize

#: Steps of the grid for one unit of a component.
GRID = 1024


def usable(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the finite vectors of ``width`` components, and these vectors."""
    right = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == width
    flat = column.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False)
    values = np.asarray(flat, np.float64).reshape(-1, width)
    finite = np.isfinite(values).all(axis=1)
    return np.flatnonzero(right)[finite], values[finite]


def on_grid(values: np.ndarray, limit: int) -> np.ndarray:
    """``floor(1024 * value)``; beyond ``limit`` in size the grid ends, and its last step is taken."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(GRID * values), -limit, limit).astype(np.int64)


def vector_width(embeddings: DataFrame, vec_id: str, embedding: str) -> int | None:
    """The number of components of the usable vector with the least id (nulls last, then the longest); None if there is none."""
    vector = F.col(embedding).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = embeddings.where((F.size(vector) > 0) & ~F.exists(vector, bad))
    row = good.select(F.col(vec_id).cast("long").alias("vec_id"), F.size(embedding).alias("width")).orderBy(F.asc_nulls_last("vec_id"), F.desc("width")).head()
    return None if row is None else row["width"]


def grid_table(embeddings: DataFrame, width: int, limit: int, vec_id: str = "vec_id", embedding: str = "embedding", keep: dict[str, str] | None = None) -> DataFrame:
    """``(vec_id, x, ...)``: every usable vector of ``width`` components as little-endian 32-bit integers, written once.

    ``keep`` names further columns as ``{new name: column}``. Rows whose vector is null, has a null or non-finite component or
    another number of components are dropped.
    """
    keep = keep or {}
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("x"), *[F.col(c).alias(new) for new, c in keep.items()])
    schema = ", ".join(["vec_id long", *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "x binary"])

    def run(batches):
        for batch in batches:
            at, values = usable(batch.column("x"), width)
            x = on_grid(values, limit).astype("<i4")
            took = batch.select(["vec_id", *keep]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", *keep, "x"])

    return materialize(rows.mapInArrow(run, schema))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """The rows of an ``x`` column of :func:`grid_table`."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)
