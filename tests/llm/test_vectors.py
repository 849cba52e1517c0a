"""Vector codes and whitening against plain versions."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SMALL, same_rows
from lineage_jobs.llm import codes, queries, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def odd_rows(width=6, n=40):
    """Nulls in every column, non-finite and short vectors, ties, repeated rows and ids."""
    drawn = random.Random(3)
    rows = [(k // 2, [round(drawn.uniform(-1, 1), 1) for _ in range(width)], [None, 1, 2][k % 3]) for k in range(n)]
    rows += rows[:5] + [(None, rows[3][1], 1), (None, rows[4][1], None), (500, rows[0][1], None)]
    bad = [(7, None, 1), (8, [None] * width, 1), (9, [0.5] * (width - 1) + [float("nan")], 1), (10, [float("inf")] + [0.0] * (width - 1), 2), (11, [], 1), (900, [1.0], 1)]
    return rows + bad, [r for r in rows]


def plain_codes(rows, parts, entries, rounds):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, np.array([math.floor(1024 * v) for v in np.float32(r[1])], "<i4").tobytes()))
    grid = [[math.floor(1024 * float(v)) for v in np.float32(r[1])] for r in rows]
    width = len(grid[0])
    cuts = [k * width // parts for k in range(parts + 1)]
    split = lambda v: [v[a:b] for a, b in zip(cuts, cuts[1:])]
    books = [[split(v)[p] for v in grid[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            found = [near(split(v)[p], books[p])[1] for v in grid]
            for e in range(len(books[p])):
                mine = [split(v)[p] for v, k in zip(grid, found) if k == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for r, v in zip(rows, grid):
        found = [near(x, books[p]) for p, x in enumerate(split(v))]
        out.append((r[0], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), r[2]))
    sums = {label: sum(x[2] for x in out if x[3] == label) for label in {x[3] for x in out}}
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[lab], digest) for i, c, e, lab in out), key=str)


@pytest.mark.parametrize("entries", [256, 7])
def test_codes_of_odd_rows(spark, entries):
    rows, kept = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("x", "code", "label_key", "part", "entry", "n")})
    got = sorted((tuple(r) for r in codes.vector_codes(df.repartition(3), entries=entries).collect()), key=str)
    assert got == plain_codes(kept, 4, entries, 4)
    assert codes.vector_codes(df.limit(0)).count() == 0
    assert codes.vector_codes(df.where("vec_id = 7 and embedding is null")).count() == 0


def test_codes_equal_sql(spark, duck):
    same_rows(queries.op12_vector_codes(spark, SMALL), duck.execute(queries.OP12_SQL).df())


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_equal_average_search_is_exact(data):
    size, k = data.draw(st.integers(1, 5)), data.draw(st.integers(1, 20))
    number = st.integers(-6, 6) if data.draw(st.booleans()) else st.integers(-codes.grid_limit(4 * size), codes.grid_limit(4 * size))
    entries = np.array(data.draw(st.lists(st.lists(number, min_size=size, max_size=size), min_size=k, max_size=k)), np.int64)
    parts = np.array(data.draw(st.lists(st.lists(number, min_size=size, max_size=size), min_size=1, max_size=12)), np.int64)
    found, best = codes.Book(entries).nearest(parts)
    far = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert found.tolist() == far.argmin(axis=1).tolist()
    assert best.tolist() == far.min(axis=1).tolist()


def test_search_leaves_entries_out():
    """Entries whose sums lie too far away are never compared."""
    drawn = np.random.default_rng(1)
    book = codes.Book(drawn.integers(-1000, 1000, (256, 16)) + np.arange(256)[:, None] * 50)
    seen, plain = [], np.einsum
    try:
        np.einsum = lambda *a: seen.append(len(a[1])) or plain(*a)
        book.nearest(book.entries + drawn.integers(-20, 20, (256, 16)))
    finally:
        np.einsum = plain
    assert sum(seen) < 256 * 256 / 4


def test_decode():
    books = codes.Codebooks([np.array([[1, 2], [3, 4]]), np.array([[5], [6]])], [0, 2, 3])
    assert books.decode("0100") == [3, 4, 5]
    assert books.sha256() == hashlib.sha256(b"1,2,3,4,5,6").hexdigest()


def plain_whitening(rows, k):
    x = [[math.floor(1024 * float(v)) + 100000 for v in np.float32(r[1])] for r in rows]
    n, width = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(width)]
    cov = np.array([[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3)) for j in range(width)] for i in range(width)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    centred = np.array([[float(Fraction(n * r[d] - sums[d], n)) for d in range(width)] for r in x])
    return n, [sum((n * r[d] - sums[d]) ** 2 for d in range(width)) for r in x], centred @ v[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(cov), cov


def test_whitening_of_odd_rows(spark):
    rows, kept = odd_rows(width=9)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("x", "n", "i", "j", "q", "dim", "component")})
    got = whitening.whitened_embeddings(df.repartition(3)).collect()
    n, deviation, white, explained, _ = plain_whitening(kept, 8)
    assert len(got) == 8 * len(kept) and {r["n"] for r in got} == {n}
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation)
    for c in range(8):
        mine = sorted((r for r in got if r["component"] == c + 1), key=lambda r: (r["deviation"], abs(r["whitened"])))
        want = sorted(zip(deviation, np.abs(white[:, c]).tolist()))
        assert np.allclose([abs(r["whitened"]) for r in mine], [w for _, w in want], rtol=1e-9, atol=1e-12)
        assert math.isclose(mine[0]["explained"], explained[c], rel_tol=1e-9)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    assert whitening.whitened_embeddings(df.limit(0)).count() == 0


def test_one_sign_for_all_rows(spark):
    rows, kept = odd_rows(width=9)
    got = {}
    for r in whitening.whitened_embeddings(spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(kept)], SCHEMA)).collect():
        got.setdefault(r["component"], {})[r["vec_id"]] = r["whitened"]
    _, _, white, _, _ = plain_whitening(kept, 8)
    for c, mine in got.items():
        mine = np.array([mine[k] for k in range(len(kept))])
        assert min(np.abs(mine - white[:, c - 1]).max(), np.abs(mine + white[:, c - 1]).max()) < 1e-9


def test_components_without_variance(spark):
    df = spark.createDataFrame([(k, [float(k), 2.0 * k, 3.0, 0.0], 1) for k in range(10)], SCHEMA)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whitened_embeddings(df).collect()}
    assert len(got) == 40 and got[0, 1]["explained"] > 0.999 and all(got[0, c]["whitened"] is None for c in (2, 3, 4))
    same = whitening.whitened_embeddings(spark.createDataFrame([(1, [1.0, 2.0], 1)] * 3, SCHEMA)).collect()
    assert len(same) == 6 and {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same} == {(None, None, None, 0)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-(1 << 32), 1 << 32), min_size=3, max_size=3), max_size=9))
def test_squared_sums_are_exact(rows):
    assert whitening.squared_sums(np.array(rows, np.int64).reshape(-1, 3)) == [sum(r[k] ** 2 for r in rows) for k in range(3)]


def test_deviation_beyond_a_long():
    fit = whitening.Whitening(10**9, [0, 0], [5, 0], np.zeros(2), [0.0, 0.0], np.zeros((2, 2)))
    assert fit.deviation(np.array([[0, 0], [1, 0], [10**6, 1]])) == [25, (10**9 - 5) ** 2, None]


def test_grid():
    assert vectors.on_grid(np.array([[-0.0001, 0.0, 1.0, 1e300]]), 5000).tolist() == [[-1, 0, 1024, 5000]]
