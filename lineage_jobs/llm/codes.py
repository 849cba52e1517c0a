"""Vector codes: each vector becomes the numbers of its parts' nearest codebook entries, found by equal-average search."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineage_jobs.llm.vectors import grid_table, integers, vector_width
from lineage_jobs.runtime import MAX_BROADCAST_ROWS, materialize, release, spread_join

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Rows that are searched together.
BLOCK = 16_384


class Book:
    """The entries of one part's codebook, ready for the equal-average search."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, np.int64)
        sums = self.entries.sum(axis=1)
        self.order = np.lexsort((np.arange(len(sums)), sums))
        self.sums, self.sorted = sums[self.order], self.entries[self.order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of ``parts`` the nearest entry, of equally near ones the lower, and its squared distance.

        Entries stand by the sum of their components. From each part's own sum the search goes outward, up and down in turn.
        A difference ``g`` of the sums puts an entry at least ``g * g / dimension`` away, so a side ends where that is strictly
        more than the best distance found: what is equally far may still win by its number.
        """
        n, size = parts.shape
        own = parts.sum(axis=1)
        best = np.full(n, np.iinfo(np.int64).max, np.int64)
        found = np.full(n, -1, np.int64)
        up = np.searchsorted(self.sums, own)
        sides = [(np.arange(n), up.copy(), 1), (np.arange(n), up - 1, -1)]
        while any(len(rows) for rows, _, _ in sides):
            going = []
            for rows, at, step in sides:
                inside = (at >= 0) & (at < len(self.sums))
                rows, at = rows[inside], at[inside]
                gap = self.sums[at] - own[rows]
                near = gap * gap <= _times(best[rows], size)
                rows, at = rows[near], at[near]
                apart = parts[rows] - self.sorted[at]
                far = np.einsum("ij,ij->i", apart, apart)
                number = self.order[at]
                wins = (far < best[rows]) | ((far == best[rows]) & (number < found[rows]))
                best[rows[wins]], found[rows[wins]] = far[wins], number[wins]
                going.append((rows, at + step, step))
            sides = going
        return found, best


def _times(best: np.ndarray, size: int) -> np.ndarray:
    """``best * size``, held at the largest long."""
    most = np.iinfo(np.int64).max
    return np.where(best > most // size, most, best * size)


@dataclass
class Codebooks:
    """A codebook for each part, and where the parts begin."""

    books: list[np.ndarray]
    cuts: list[int]

    def searchers(self) -> list[tuple[slice, Book]]:
        return [(slice(a, b), Book(book)) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)]

    def sha256(self) -> str:
        """The checksum of all entries' components by part, entry and position."""
        return hashlib.sha256(",".join(str(v) for book in self.books for row in book.tolist() for v in row).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The grid vector that a code stands for."""
        return [v for k, book in enumerate(self.books) for v in book[int(code[2 * k : 2 * k + 2], 16)].tolist()]


def grid_limit(width: int, parts: int = PARTS) -> int:
    """How far the grid goes: so far that the square of a part's sums and of its distances stays a long."""
    return (1 << 30) // max(1, -(-width // parts))


def _blocks(batches, width: int):
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(start, BLOCK)
            yield piece, integers(piece.column("x"), width)


def _means(table: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round: the floored means of the parts that are nearest to each entry, unused entries as they were."""
    width, spark = books.cuts[-1], table.sparkSession
    longest = max(b - a for a, b in zip(books.cuts, books.cuts[1:], strict=False))
    names = [f"s{j}" for j in range(longest)]
    shared = spark.sparkContext.broadcast(books)  # PARTS * ENTRIES entries

    def run(batches):
        searchers = shared.value.searchers()
        sums = [np.zeros((len(book.entries), longest + 1), np.int64) for _, book in searchers]
        for _, x in _blocks(batches, width):
            for (part, book), total in zip(searchers, sums, strict=True):
                found, _ = book.nearest(x[:, part])
                order = np.argsort(found, kind="stable")
                used, first = np.unique(found[order], return_index=True)
                if len(used):
                    total[used, 0] += np.diff(np.append(first, len(order)))
                    total[used, 1 : part.stop - part.start + 1] += np.add.reduceat(x[order, part], first, axis=0)
        for k, total in enumerate(sums):
            used = np.flatnonzero(total[:, 0])
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), *(pa.array(c) for c in total[used].T.copy())], names=["part", "entry", "n", *names]
                )

    schema = "part int, entry int, n long, " + ", ".join(f"{c} long" for c in names)
    found = table.select("x").mapInArrow(run, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).collect()
    moved = [book.copy() for book in books.books]
    for r in found:
        size = moved[r["part"]].shape[1]
        moved[r["part"]][r["entry"]] = [r[c] // r["n"] for c in names[:size]]
    return Codebooks(moved, books.cuts)


def fit_codebooks(table: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of a :func:`~lineage_jobs.llm.vectors.grid_table`: the parts of its first vectors by id (nulls last, then by their bytes), moved to
    their floored means ``rounds`` times, by all vectors. Fewer vectors than ``entries`` give as many entries as there are vectors."""
    cuts = [k * width // parts for k in range(parts + 1)]
    first = table.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    x = np.array([np.frombuffer(r["x"], "<i4") for r in first], np.int64).reshape(-1, width)
    books = Codebooks([x[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)], cuts)
    for _ in range(rounds):
        books = _means(table, books)
    return books


def encode(table: DataFrame, books: Codebooks) -> DataFrame:
    """``(vec_id, code, error, ...)`` of a grid table: two hex digits for each part, and the squared distances summed over the parts."""
    width, rest = books.cuts[-1], [c for c in table.columns if c not in ("vec_id", "x")]
    shared = table.sparkSession.sparkContext.broadcast(books)  # PARTS * ENTRIES entries

    def run(batches):
        searchers = shared.value.searchers()
        digits = [f"{k:02x}" for k in range(256)]
        for piece, x in _blocks(batches, width):
            error, codes = np.zeros(len(x), np.int64), []
            for part, book in searchers:
                found, far = book.nearest(x[:, part])
                error += far
                codes.append([digits[k] for k in found.tolist()])
            code = ["".join(c) for c in zip(*codes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("vec_id"), *(piece.column(c) for c in rest), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", *rest, "code", "error"]
            )

    schema = ", ".join(["vec_id long", *(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in rest), "code string", "error long"])
    return table.mapInArrow(run, schema)


def vector_codes(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``, a row for each usable row of ``embeddings``.

    Vectors are floored onto a grid of 1/1024 and cut into ``parts`` equal parts (as equal as may be, where their length
    isn't a multiple). Rows whose vector is null, empty, of another length than that of the first usable one by id, or that
    holds a null or non-finite component, are dropped; components beyond the grid (2**30 over a part's length, that is 65,536 for
    64 components) take its last step. Null and repeated ids are rows like others, null ids last among the first vectors.
    ``label_error`` sums the errors of the rows with an equal label, nulls together. An empty table gives an empty one. At most
    256 ``entries``, as codes have two digits a part.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark = embeddings.sparkSession
    width = vector_width(embeddings, vec_id, embedding)
    if width is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    table = grid_table(embeddings, width, grid_limit(width, parts), vec_id, embedding, {"label": label})
    books = fit_codebooks(table, width, parts, entries, rounds)
    key = F.when(F.col("label").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("label").cast("string"))).alias("label_key")
    coded = materialize(encode(table, books).select("vec_id", "code", "error", key))
    release(table)
    sums = materialize(coded.groupBy("label_key").agg(F.sum("error").alias("label_error")))
    labels = sums.count()
    out = coded.join(F.broadcast(sums), "label_key") if labels <= MAX_BROADCAST_ROWS else spread_join(coded, sums, "label_key", by=["vec_id", "code"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
