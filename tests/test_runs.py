"""Joins over time, sessions, differences and streams against plain versions; nulls, ties, repeated rows and empty tables."""

import random

from pyspark.sql import functions as F

from lineage_jobs import resolve, runs, streaming


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=str)


def test_as_of_against_a_loop(spark):
    rng = random.Random(4)
    left = [(k, rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, 5, 5, 5, *range(0, 60)])) for k in range(600)] + [(1, "hot", 5)] * 3
    right = [(rng.choice(["hot", "a", None]), rng.choice([None, *range(-3, 70, 3)]), rng.choice([None, *range(9)])) for _ in range(120)]
    a, b = spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, since long, v long")

    def plain(k, t):
        found = [(s, -1 if v is None else v) for q, s, v in right if k is not None and q == k and t is not None and s is not None and s <= t]
        v = max(found)[1] if found else None
        return None if v == -1 else v

    want = sorted(((i, k, t, plain(k, t)) for i, k, t in left), key=str)
    for bins, least in ((64, 1000), (4, 20), (1, 5)):
        assert rows(runs.as_of(a, b, "k", "t", "since", ["v"], bins, least)) == want
    assert runs.as_of(a.limit(0), b, "k", "t", "since", ["v"]).count() == 0
    assert rows(runs.as_of(a, b.limit(0), "k", "t", "since", ["v"]), "v") == [(None,)] * len(left)


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(5)
    spans = []
    for k in range(300):
        s = rng.randrange(-40, 200)
        spans.append((k, rng.choice("xxxy"), s, s + rng.choice([0, 0, 1, 2, 7, 30, 100_000])))
    odd = [(900, None, 1, 5), (901, "x", None, 5), (902, "x", 5, None), (903, "x", 9, 8), (None, "x", 1, 2)]
    df = spark.createDataFrame(spans + odd, "id long, k string, s long, e long")
    want = []
    for i, k, s, e in spans:
        for j, q, t, f in spans:
            if k == q and (s, i) < (t, j) and t <= e:
                want.append((k, i, j))
    assert rows(runs.overlapping_runs(df, "id", "k", "s", "e")) == sorted(want, key=str)
    assert runs.overlapping_runs(df.limit(0), "id", "k", "s", "e").count() == 0
    assert rows(runs.overlapping_runs(df.where("id in (0)"), "id", "k", "s", "e")) == []


def test_sessions_and_their_ends(spark):
    times = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:29:59"), ("a", "2024-01-01 00:59:59"), ("a", "2024-01-01 01:30:00"), ("a", "2024-01-01 01:30:00"), ("b", "2024-01-01 00:00:00"), (None, "2024-01-01 00:00:00"), ("b", None)]
    df = spark.createDataFrame(times, "k string, t string").withColumn("at", F.col("t").cast("timestamp"))
    got = rows(runs.run_sessions(df, "k", "at").select("key", F.col("session_start").cast("string"), F.col("last_at").cast("string"), "n"))
    assert got == [("a", "2024-01-01 00:00:00", "2024-01-01 00:59:59", 3), ("a", "2024-01-01 01:30:00", "2024-01-01 01:30:00", 2), ("b", "2024-01-01 00:00:00", "2024-01-01 00:00:00", 1)]


def test_differences(spark):
    old = [(1, "a", "t"), (1, "b", "t"), (1, "k", "t"), (1, "k", "t"), (2, None, "u"), (2, "x", None), (3, "p", "q"), (3, "p", "q")]
    new = [(1, "c", "t"), (1, "k", "t"), (1, "k", "t"), (2, None, "u"), (2, "y", None), (2, "z", None), (3, "p", "q"), (None, "n", "n")]
    make = lambda x: spark.createDataFrame(x, "script_id long, source string, target string")
    assert rows(runs.graph_difference(make(old), make(new))) == sorted([
        (1, "t", "moved", "a", "c", 1, 1), (1, "t", "dropped", "b", None, 1, 0), (2, None, "moved", "x", "y", 1, 1), (2, None, "added", None, "z", 0, 1),
        (3, "q", "recounted", "p", "p", 2, 1), (None, "n", "added", None, "n", 0, 1),
    ], key=str)
    assert runs.graph_difference(make(old), make(old)).count() == 0
    assert rows(runs.graph_difference(make([]), make(old[:1]))) == [(1, "t", "added", None, "a", 0, 1)]


def test_streams_equal_batches_after_a_restart(spark, tmp_path):
    scripts = [(k, f"insert into o.t{k} select a.x from i.s{k} a, (select y from i.r{k}) b; update o.u{k} set c = d.e from i.q{k} d") for k in range(8)]
    make = lambda part: spark.createDataFrame(part, "script_id long, text string").coalesce(1)
    folder, sink, sink2 = f"{tmp_path}/in", f"{tmp_path}/graphs", f"{tmp_path}/targets"
    stream = lambda: spark.readStream.schema("script_id long, text string").parquet(folder)
    for part in (scripts[:5], scripts[5:]):  # the second start goes on behind the first
        make(part).write.mode("append").parquet(folder)
        streaming.stream_lineage(stream(), sink, f"{tmp_path}/state").awaitTermination()
        streaming.stream_targets(stream(), sink2, f"{tmp_path}/state2").awaitTermination()
    want = resolve.sql_lineage(make(scripts))
    for name in ("table_edges", "column_edges"):
        assert rows(streaming.read_lineage(spark, sink, name).select(sorted(want[name].columns))) == rows(want[name].select(sorted(want[name].columns)))
    assert rows(spark.read.parquet(sink2), "script_id", "table_name") == sorted([(k, f"o.{c}{k}") for k in range(8) for c in "tu"], key=str)
    # a batch that is repeated counts once
    import shutil

    shutil.rmtree(f"{tmp_path}/state/commits")
    streaming.stream_lineage(stream(), sink, f"{tmp_path}/state").awaitTermination()
    assert streaming.read_lineage(spark, sink, "table_edges").count() == want["table_edges"].count()


def test_late_rows_are_counted_apart(spark, tmp_path):
    make = lambda times: spark.createDataFrame([(t, "x") for t in times], "t string, by string").select(F.col("t").cast("timestamp").alias("at"), "by").coalesce(1)
    folder, sink, state = f"{tmp_path}/in", f"{tmp_path}/sink", f"{tmp_path}/state"
    late = 0
    for times in (["2024-01-01 00:10:00", "2024-01-01 05:00:00"], ["2024-01-01 06:00:00"], ["2024-01-01 00:20:00", "2024-01-01 05:30:00"]):
        make(times).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("at timestamp, by string").parquet(folder)
        query = streaming.stream_windows(stream, sink, state, "at", "by", "1 hour", "2 hours")
        query.awaitTermination()
        late += streaming.late_rows(query)
    got = rows(streaming.read_windows(spark, sink).select(F.col("window_start").cast("string"), "n"))
    assert got == [("2024-01-01 00:00:00", 1), ("2024-01-01 05:00:00", 2), ("2024-01-01 06:00:00", 1)] and late == 1
