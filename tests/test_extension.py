"""Engines as table functions and sketches under rollup against plain versions; nulls, ties, repeated rows and empty tables."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lineage_jobs import corpus, extension, service, sketches
from lineage_jobs.schemas import ENGINE_ORDER, engine_ranks


def test_contract():
    table = {"id": "a"}
    for graph, told in (
        (None, "no mapping"), ([], "no mapping"), ({}, "tables: no list"), ({"tables": [1]}, "tables[0]: no mapping"), ({"tables": [table, {"id": None}]}, "tables[1].id: no text"),
        ({"tables": [{"id": "a", "role": 3}]}, "tables[0].role: no text"), ({"tables": [{"id": "a", "columns": [None]}]}, "tables[0].columns: no list of texts"),
        ({"tables": [table], "table_edges": {"a": "b"}}, "table_edges: no list"), ({"tables": [table], "table_edges": [{"source": "a"}]}, "table_edges[0].target: no text"),
        ({"tables": [table], "column_edges": [{"source_table": "a"}]}, "column_edges[0].source_column: no text"), ({"tables": [table], "warnings": [1]}, "warnings: no list of texts"),
    ):
        assert extension.breach(graph) == told
    assert extension.breach({"tables": [{"id": "a", "role": None, "columns": ["c"], "more": 1}], "column_edges": None, "odd": object()}) is None


def test_replies_of_odd_rows(spark):
    long = "x " * 100_000 + "-- lineage: 源.表 -> b"

    def parse(text, dialect):
        if text == "silent":
            raise KeyError
        if text == "odd":
            return {"tables": [{"id": 1}]}
        return {**extension.declared_lineage(text, dialect), "warnings": [dialect or "none"]}

    rows = [("a", long, None, 1), ("b", None, "hive", 2), ("c", " \n", "hive", 3), ("d", "silent", "x", 4), ("e", "odd", "x", 5), ("f", "-- lineage: -> b", "x", 6), (None, "--lineage:a->b", "q", 7), (None, "--lineage:a->b", "q", 7)]
    scripts = spark.createDataFrame(rows, "script_id string, text string, dialect string, json int")
    out = extension.engine_replies(scripts, parse)
    assert out.dtypes == [("script_id", "string"), ("json", "string")]
    got = sorted(((r["script_id"] or "", json.loads(r["json"])) for r in out.collect()), key=lambda r: r[0])
    assert [k for k, _ in got] == ["", "", "a", "b", "c", "d", "e", "f"] and got[0] == got[1]
    assert got[2][1]["table_edges"] == [{"source": "源.表", "target": "b"}] and got[2][1]["warnings"] == ["none"]
    assert [g["error"] for _, g in got[3:]] == ["empty", "empty", "KeyError", "contract: tables[0].id: no text", "unreadable: -> b"]
    assert extension.engine_replies(scripts.limit(0), parse).count() == 0
    numbered = extension.engine_replies(scripts.withColumn("script_id", F.lit(1).cast("decimal(20,0)")), parse)
    assert dict(numbered.dtypes)["script_id"] == "decimal(20,0)"
    with pytest.raises(Exception, match="holds no text"):
        extension.engine_replies(scripts, parse, text="json").collect()


def test_ranks():
    ranks = engine_ranks({"mine": "ai", "first": "datax"})
    assert sorted(ranks, key=ranks.get) == ["first", *ENGINE_ORDER[:-1], "mine", "ai"]
    with pytest.raises(ValueError):
        engine_ranks({"ai": "datax"})


def test_engine_in_a_corpus(spark):
    rows = [(1, "insert into o.t select a from i.s", "auto"), (2, "beyond any grammar\n-- lineage: i.x, i.y -> o.z", None), (3, "insert into o.t select a from i.s -- lineage: p -> q", "declared"), (4, "neither", "auto"), (5, "-- lineage: a -> b", "nosuch")]
    scripts = spark.createDataFrame([(k, t, "hive", p) for k, t, p in rows], "script_id long, text string, dialect string, preference string")
    found = corpus.engine_graph_json(extension.engine_replies(scripts, extension.declared_lineage))
    out = service.analyse_corpus(scripts, {"declared": found}, ranks=engine_ranks({"declared": "ai"}))
    assert {r["script_id"]: (r["ok"], r["engine"]) for r in out["picks"].collect()} == {1: (True, "sqlglot"), 2: (True, "declared"), 3: (True, "declared"), 4: (False, None), 5: (False, None)}
    docs = {r["script_id"]: r["graph"] for r in out["documents"].collect()}
    edges = lambda k: [(e["source"], e["target"]) for e in docs[k]["table_edges"]]
    assert edges(1) == [("i.s", "o.t")] and edges(2) == [("i.x", "o.z"), ("i.y", "o.z")] and edges(3) == [("p", "q")]
    assert {r["detail"] for r in out["picks"].where("script_id = 5").collect()} == {"nosuch: no such parser"}


def test_buckets_of_any_long(spark):
    rng = random.Random(7)
    values = sorted({0, 1, -1, 127, 128, 129, 255, 256, -128, -129, 2**63 - 1, -(2**63), *[rng.choice([-1, 1]) * rng.getrandbits(rng.randrange(1, 63)) for _ in range(3000)]})
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", sketches.bucket(F.col("v")).alias("b")).withColumn("m", sketches.bucket_value(F.col("b")))
    rows = sorted(df.collect())
    assert all(x["b"] <= y["b"] for x, y in zip(rows, rows[1:], strict=False))
    assert all(abs(r["m"] - r["v"]) * 128 <= abs(r["v"]) for r in rows)
    assert {r["m"] for r in df.select(sketches.bucket(F.col("m")).alias("c"), "b", "m").where("b <> c").collect()} == set()


def test_rollups_against_all_facts(spark):
    rng = random.Random(8)
    names = [None, *[f"t{k}" for k in range(9000)]]
    facts = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["e", "f", None]), rng.choice(["d", None]), rng.choice(names), rng.choice([None, 0, -5, 5, rng.randrange(10**9)])) for _ in range(40_000)]
    facts += facts[:500] + [(9, "blank", "d", None, None)] * 3
    df = spark.createDataFrame(facts, "s long, a string, b string, t string, v long")
    stored = sketches.distinct_sketches(df, "s", ["a", "b"], "t")
    buckets = sketches.quantile_sketches(df, "s", ["a", "b"], "v")
    groups = {}
    for s, a, b, t, v in facts:
        for key in ((a, b, 0), (a, None, 1), (None, None, 2)):
            groups.setdefault(key, []).append((t, v))
    distinct = {(r["a"], r["b"], r["level"]): (r["n"], r["items"]) for r in sketches.rollup_distinct(stored, ["a", "b"]).collect()}
    assert set(distinct) == set(groups)
    for key, rows in groups.items():
        n, items = distinct[key]
        exact = len({t for t, _ in rows if t is not None})
        assert n == len(rows) and abs(items - exact) <= 5 * 1.04 / 64 * exact
    asked = [0, 1, 500, 999, 1000]
    got = {(r["a"], r["b"], r["level"], r["permille"]): (r["n"], r["value"]) for r in sketches.rollup_quantiles(buckets, ["a", "b"], asked).collect()}
    want = 0
    for key, rows in groups.items():
        values = sorted(v for _, v in rows if v is not None)
        for p in asked if values else []:
            exact = values[max(1, math.ceil(len(values) * p / 1000)) - 1]
            n, value = got[(*key, p)]
            assert n == len(values) and abs(value - exact) * 128 <= abs(exact)
            want += 1
    assert len(got) == want
    none = df.limit(0)
    assert sketches.rollup_quantiles(sketches.quantile_sketches(none, "s", ["a", "b"], "v"), ["a", "b"], asked).where("level < 2").count() == 0
    assert sketches.distinct_sketches(none, "s", ["a", "b"], "t").count() == 0
    with pytest.raises(ValueError, match="rename"):
        sketches.quantile_sketches(df.withColumnRenamed("a", "Bucket"), "s", ["Bucket"], "v")
