"""Whitened embeddings from an exact covariance by polarisation: variances of all dimensions and of all their pairwise sums."""

from __future__ import annotations

import decimal
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineage_jobs.llm.vectors import grid_table, integers, vector_width
from lineage_jobs.runtime import release

#: Added to every grid component.
SHIFT = 100_000
#: Components of the result.
COMPONENTS = 8
#: Where the grid ends: components of a million, so that all integers have 32 bits.
LIMIT = 1 << 30
#: Rows whose squares are summed together, and the size up to which their sums surely fit into longs as they are.
BLOCK, SMALL = 8_192, 1 << 23
LONGEST = (1 << 63) - 1


def _blocks(batches, width: int):
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(start, BLOCK)
            if piece.num_rows:
                yield piece, integers(piece.column("x"), width)


def squared_sums(values: np.ndarray) -> list[int]:
    """The exact sum of squares of each column of whole numbers below 2**33 in size, of up to :data:`BLOCK` rows."""
    if not values.size:
        return [0] * values.shape[1]
    if np.abs(values).max() <= SMALL:
        return np.einsum("ij,ij->j", values, values).tolist()
    high, low = values >> 17, values & 0x1FFFF
    parts = [np.einsum("ij,ij->j", a, b).tolist() for a, b in ((high, high), (high, low), (low, low))]
    return [(a << 34) + (b << 18) + c for a, b, c in zip(*parts, strict=True)]


def exact_sums(table: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows of a grid table and the sum of each dimension, with :data:`SHIFT`."""

    def run(batches):
        n, total = 0, [0] * width
        for _, x in _blocks(batches, width):
            n += len(x)
            total = [a + b for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)]
        if n:
            values = [decimal.Decimal(v) for v in [n, *total]]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["dim", "total"])

    found = {r["dim"]: int(r["total"]) for r in table.select("x").mapInArrow(run, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total")).collect()}
    n = found.get(-1, 0)
    return n, [found.get(k, 0) + SHIFT * n for k in range(width)]


def pair_squares(table: DataFrame, centre: list[int], width: int) -> dict[tuple[int, int], int]:
    """The exact sums over all rows of ``y_i ** 2``, at ``(i, i)``, and of ``(y_i + y_j) ** 2``, at ``(i, j)`` with ``i < j``, where ``y`` is the
    grid vector less ``centre``; one row for each pair and task is shuffled."""
    middle = np.array(centre, np.int64)

    def run(batches):
        total = None
        for _, x in _blocks(batches, width):
            y = x - middle
            found = []
            for i in range(width):
                sums = y[:, i:] + y[:, i : i + 1]
                sums[:, 0] = y[:, i]
                found += squared_sums(sums)
            total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        if total is not None:
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([decimal.Decimal(v) for v in total], pa.decimal128(38, 0))], names=["i", "j", "q"]
            )

    rows = table.select("x").mapInArrow(run, "i int, j int, q decimal(38,0)").groupBy("i", "j").agg(F.sum("q").alias("q"))
    return {(r["i"], r["j"]): int(r["q"]) for r in rows.collect()}  # width * (width + 1) / 2 rows


def polarised(squares: dict[tuple[int, int], int], rest: list[int], n: int) -> np.ndarray:
    """The covariance, divisor ``n``, from :func:`pair_squares` of values whose sums are ``rest``.

    ``n * sum(y ** 2) - sum(y) ** 2`` is n² times a variance, in whole numbers; that of a sum less those of its terms
    is twice their covariance. Only the last division rounds.
    """
    width = len(rest)
    alone = [n * squares[i, i] - rest[i] ** 2 for i in range(width)]
    out = np.zeros((width, width))
    for i in range(width):
        out[i, i] = alone[i] / (n * n)
        for j in range(i + 1, width):
            out[i, j] = out[j, i] = (n * squares[i, j] - (rest[i] + rest[j]) ** 2 - alone[i] - alone[j]) / (2 * n * n)
    return out


@dataclass
class Whitening:
    """What whitens a grid vector: the integers next to the means, what the sums have beyond them, and the scaled components."""

    n: int
    centre: list[int]
    rest: list[int]
    values: np.ndarray
    explained: list[float | None]
    scaled: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.centre, np.int64)).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.scaled

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """``sum((n * x - S) ** 2)`` of each row, null where a long can't hold it."""
        y = x - np.array(self.centre, np.int64)
        most = int(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.rest))
        if most**2 * x.shape[1] <= LONGEST:
            y = y * self.n - np.array(self.rest, np.int64)
            return np.einsum("ij,ij->i", y, y).tolist()
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in y.tolist()]
        return [v if v <= LONGEST else None for v in exact]


def fit_whitening(table: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of a grid table by the ``components`` largest eigenvalues of its covariance, over all its rows.

    Components are numbered by falling eigenvalue. One whose eigenvalue isn't above the rounding of the largest one spans nothing: it
    has nulls for whitened values.
    """
    n, sums = exact_sums(table, width)
    # x - middle is a grid integer plus SHIFT less the integer next to the mean of x
    nearest = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, nearest, strict=True)]
    centre = [m - SHIFT for m in nearest]
    matrix = polarised(pair_squares(table, centre, width), rest, n)
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    k, trace = min(components, width), float(np.trace(matrix))
    real = values[:k] > max(float(values[0]), 0.0) * width * np.finfo(float).eps
    scaled = np.where(real, vectors[:, :k] / np.sqrt(np.where(real, values[:k], 1.0)), np.nan)
    return Whitening(n, centre, rest, values[:k], [float(v) / trace if trace > 0 else None for v in values[:k]], scaled)


def identity_error(table: DataFrame, fit: Whitening, width: int) -> float | None:
    """The largest absolute entry of the whitened rows' covariance less the identity, as computed from all rows."""
    real = np.flatnonzero(~np.isnan(fit.scaled).any(axis=0))
    if not len(real):
        return None
    k = len(real)

    def run(batches):
        total = np.zeros(k * k)
        for _, x in _blocks(batches, width):
            z = fit.whitened(x)[:, real]
            total += (z.T @ z).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total)], names=["cell", "total"])

    # the values are centred by the exact means already
    cells = table.select("x").mapInArrow(run, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    found = np.zeros(k * k)
    for r in cells:
        found[r["cell"]] = r["total"] / fit.n
    return float(np.abs(found.reshape(k, k) - np.eye(k)).max())


def whitened_embeddings(embeddings: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: for each usable row of ``embeddings`` a row for each component.

    A vector's component c counts as ``floor(1024 * c) + 100000``. Rows whose vector is null, empty, of another length than that of the
    first usable one by id, or that holds a null or non-finite component, are dropped; components beyond a million in size count
    as a million. Null and repeated ids are rows like others. ``deviation`` is null where a long can't hold it; ``whitened`` is
    null for components without variance, ``explained`` where nothing varies. An empty table gives an empty one.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = vector_width(embeddings, vec_id, embedding)
    if width is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    table = grid_table(embeddings, width, LIMIT, vec_id, embedding)
    fit = fit_whitening(table, width, components)
    error, k = identity_error(table, fit, width), len(fit.explained)

    def run(batches):
        for piece, x in _blocks(batches, width):
            m, each = len(x), np.repeat(np.arange(len(x)), k)
            white = fit.whitened(x).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, fit.n)),
                    pa.array(fit.deviation(x), pa.int64()).take(pa.array(each)),
                    pa.array(white, mask=np.isnan(white)),
                    pa.array(fit.explained * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return table.mapInArrow(run, schema)
