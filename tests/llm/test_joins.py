"""Operators that bring rows together: near-duplicates, lines, shards, mixing, toxicity, the pipeline."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, same_rows
from lineage_jobs.llm import lines, mixing, neardup, queries, shards, toxicity

ODD = [(None, "a b c d e f"), (None, None), (9100, None), (9101, ""), (9102, " \n "), (9103, "one two"), (9104, "One  TWO"), (9105, "x " * 20000), (9106, "x " * 20001), (9107, "a b c d e f")]


def components(ids, linked):
    parent = {x: x for x in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in ids}


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def near_rows():
    """Documents with groups of copies: a hot group of near copies, a chain, and outsiders just below the threshold."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    out = []
    for k in range(60):  # the words changed decide the likeness: from nearly equal to just too far
        words = list(base)
        for _ in range(rng.choice([1, 1, 1, 2, 3, 4, 5, 6])):
            words[rng.randrange(120)] = f"v{rng.randrange(9999)}"
        out.append((1000 + k, " ".join(words)))
    chain = [f"c{k}" for k in range(100)]
    for k in range(8):
        out.append((2000 + k, " ".join(chain)))
        chain = [*chain[5:], *(f"n{k}{j}" for j in range(5))]
    return out


def test_near_duplicates_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + near_rows() + ODD[2:]
    df = spark.createDataFrame(docs + ODD[:2], "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("component", F.lit(2))
    sets = {d: shingles(t, 4) for d, t in docs}
    want = components(sorted(sets), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = neardup.near_duplicates(df, words=4).collect()
    assert len(got) == len(docs) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert len({want[d] for d in range(1000, 1060)}) > 1
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_with_repeated_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "z y x w v u"), (2, "z y x w v u"), (3, "a b c d e f g"), (4, None), (4, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df, words=4).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (4, 3)]


def test_signature_distance_counts_lanes(spark):
    from lineage_jobs.llm.lanes import lanes_apart

    rng = random.Random(3)
    rows = []
    for bits in (8, 16):
        for _ in range(40):
            x = [rng.randrange(1 << bits) for _ in range(64 // bits)]
            y = [rng.choice([v, v, rng.randrange(1 << bits)]) for v in x]
            whole = lambda z: (lambda n: n - (1 << 64) if n >> 63 else n)(sum(v << (bits * k) for k, v in enumerate(z)))  # noqa: E731, B023
            rows.append((bits, whole(x), whole(y), sum(a != b for a, b in zip(x, y))))
    df = spark.createDataFrame(rows, "bits int, x long, y long, want int")
    for bits in (8, 16):
        assert df.where(F.col("bits") == bits).where(lanes_apart(F.col("x"), F.col("y"), bits) != F.col("want")).count() == 0


def test_lines_against_brute_force(spark):
    rng = random.Random(9)
    base = " ".join(f"word{rng.randrange(999)}" for _ in range(40))
    near = [base.replace(f"{rng.choice(base.split())}", "other", 1) for _ in range(12)]
    docs = [(1, f"{base}\nshort\n\nunique line of text here"), (2, "\n".join(near)), (3, f"  {base.upper()}  \nshort\nSHORT"), (4, None), (5, ""), (6, "x" * 5000), (7, "x" * 5000 + "\n " + "y" * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("line", F.lit("clash")).withColumn("key", F.lit(1))
    have = [(d, k, line) for d, t in docs if t is not None for k, line in enumerate(t.split("\n"))]
    bare = {(d, k): " ".join(line.lower().split()) for d, k, line in have}
    grams = {b: ({b[i : i + 10] for i in range(len(b) - 9)} or {b}) for b in set(bare.values()) if b}
    classes = components(sorted(grams), lambda a, b: 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]))
    got = {(r["doc_id"], r["line_no"]): r for r in lines.line_duplicates(df).collect()}
    assert len(got) == len(have)
    first = {}
    for d, k, _ in have:
        if bare[d, k]:
            first.setdefault(classes[bare[d, k]], (d, k))
    for d, k, _ in have:
        assert got[d, k]["kept"] == (not bare[d, k] or first[classes[bare[d, k]]] == (d, k)), (d, k)
    texts = {r["doc_id"]: r["text"] for r in lines.without_duplicate_lines(df).collect()}
    assert texts[3] == "" and texts[4] is None and texts[1] == docs[0][1]
    assert lines.line_duplicates(df.limit(0)).count() == 0


def test_shards(spark):
    docs = [(k, "é" * (k * 37 % 200)) for k in range(500)] + ODD + [(7, "twin"), (7, "twin")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("size", F.lit(1))
    got = shards.assign_shards(df, 8).collect()
    assert len(got) == len(docs)
    size = lambda t: len((t or "").encode()) + 1
    rows = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32((x[1] or "").encode()), size(x[1])))
    total, before, want, count = sum(size(t) for _, t in docs), 0, [], {}
    for d, t in rows:
        shard = min(7, (2 * before + size(t)) * 8 // (2 * total))
        want.append((d or -1, size(t), zlib.crc32((t or "").encode()), shard, count.get(shard, 0)))
        count[shard], before = count.get(shard, 0) + 1, before + size(t)
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == sorted(want)
    assert shards.assign_shards(df.limit(0), 8).count() == 0


def test_mixing_against_sql(spark, duck):
    same_rows(queries.op8_source_mix(spark, SMALL), duck.execute(queries.OP8_SQL).df())


def test_mixing_rates(spark):
    docs = [(k, "x" * 99, "big" if k % 3 else "small") for k in range(6000)] + [(None, None, None), (1, "", "none")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("copy", F.lit("clash"))
    rates = {r["source"]: r for r in mixing.source_rates(df, {"small": 3, "big": 1}, budget=2.0).collect()}
    assert rates["none"]["rate"] == 0 and abs(rates["small"]["weight"] - 0.75) < 1e-9
    mixed = mixing.mix_sources(df, {"small": 3, "big": 1}, budget=2.0)
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(counts["small"] - 9000) < 500 and abs(counts["big"] - 3000) < 300 and set(counts) == {"small", "big"}
    assert mixed.count() == mixing.shuffled(mixed).count() and mixing.mix_sources(df.limit(0)).count() == 0


def test_mixing_of_odd_rows(spark):
    docs = [(None, f"text {k}", "s") for k in range(400)] + [(7, "twin", "s"), (7, "twin", "s"), (8, None, "s"), (9, "", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("mix_source", F.lit("clash")).withColumn("mix_n", F.lit(1))
    got = mixing.mix_sources(df, budget=1.0)
    assert got.columns == ["doc_id", "text", "source", "mix_source", "mix_n", "copy", "place"]
    rows = got.collect()
    assert 300 < sum(r["doc_id"] is None for r in rows) < 500 and len({r["text"] for r in rows}) > 200  # null ids are drawn one by one
    assert sum(r["doc_id"] == 7 for r in rows) % 2 == 0


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(5)
    vocab = [f"word{k}" for k in range(300)]
    docs, marks = [], []
    for k in range(1200):
        words = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        bad = k % 8 == 0
        for _ in range(bad * 4):
            words.insert(rng.randrange(len(words)), rng.choice(["vileone", "vilest", "scumbag"]))
        docs.append((k, " ".join(words)))
        if k % 2 == 0:
            marks.append((k, int(bad)))
    return docs, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark, toxic):
    docs, df, labels = toxic
    model = toxicity.fit_toxicity(df, labels)
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(df.unionByName(odd.where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10_000)).withColumn("score", F.lit("clash")), model).collect()}
    for k, _ in docs:
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and got[k]["predicted"] == int(got[k]["score"] >= 0.3)
    held = [k for k, _ in docs if got[k]["held_out"]]
    assert sum(got[k]["predicted"] == (k % 8 == 0) for k in held) > 0.99 * len(held)
    assert got[19_100]["score"] == got[19_101]["score"] and got[19_100]["predicted"] == 0


def test_held_out_labels_are_not_learnt(spark, toxic):
    docs, df, labels = toxic
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit_toxicity(df, labels), toxicity.fit_toxicity(df, wrong)
    assert a.weights == b.weights and a.bias == b.bias


def test_toxicity_without_examples(spark, toxic):
    _, df, labels = toxic
    for few in (labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.fit_toxicity(df, few)
        assert {r["predicted"] for r in toxicity.toxicity_scores(df.limit(5), model).collect()} == {0}
    assert toxicity.toxicity_scores(df.limit(0), model).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    left = p.not_toxic(spark, docs, SMALL).cache()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in left.collect()}
    assert left.columns == p.COLUMNS and 0 < len(gone) and not any(labels.get(d) == 0 for d in gone)
    one = p.one_of_each_group(spark, left, SMALL).cache()
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in left.collect()}
    want = components(sorted(sets), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert {r["doc_id"] for r in one.collect()} == {d for d in want if want[d] == d}
    clean = p.not_in_benchmark(spark, one, SMALL).cache()
    bench = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    whole = {r["doc_id"]: " ".join(re.findall(r"\w+", r["text"].lower())) for r in one.collect()}
    assert {r["doc_id"] for r in clean.collect()} == {d for d, t in whole.items() if not any(f" {b} " in f" {t} " for b in bench)}
    mixed = p.mixed(spark, clean, SMALL).cache()
    assert mixed.columns == p.COLUMNS and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clean.collect()}
    out = p.sharded(spark, mixed, SMALL)
    rows = out.collect()
    assert len(rows) == mixed.count() and sorted((r["shard"], r["slot"]) for r in rows) == sorted({(r["shard"], r["slot"]) for r in rows})


def test_lines_without_words_against_brute_force(spark):
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    path = "".join(rng.choice(letters) for _ in range(180))
    rows = [f"https://example.org/{path}", f"http://example.org/{path}", "ab" * 40, "ab" * 300, "z" * 3000, "z" * 30, "漢字" * 9, "漢字" * 70]
    for _ in range(60):  # tokens of 40 to 120 characters with a changed one: likenesses on both sides of the threshold
        one = [rng.choice(letters) for _ in range(rng.randrange(40, 200))]
        other = list(one)
        other[rng.choice([0, 1, 2, 3, 5, 8, len(one) // 2])] = "_"
        rows += ["".join(one), "".join(other)]
    long = "".join(rng.choice(letters) for _ in range(150_000))
    rows += [long, long[:70_000] + "_" + long[70_001:]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")
    grams = {k: ({t[i : i + 10] for i in range(len(t) - 9)} or {t}) for k, t in enumerate(rows)}
    want = components(sorted(grams), lambda a, b: 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]))
    assert want[1] == 0 and want[3] == 2 and want[5] == 4
    assert {r["doc_id"] for r in lines.line_duplicates(df).where("kept").collect()} == {k for k in want if want[k] == k}


def test_recall_of_line_bands(spark):
    """Pairs of likeness 0.8 to 0.85 on full sets, with and without spaces, long and short: how many share a band."""
    rng = random.Random(4)
    rows = []
    for k in range(6000):
        letters = rng.choice(["abcdefghijklmnopqrstuvwxyz    ", "".join(map(chr, range(0x4E00, 0x4F00))), "ab", "0123456789abcdef"])
        one = "x" + "".join(rng.choice(letters) for _ in range(rng.choice([60, 80, 105, 210, 520]))) + "x"
        n = max(1, len(one) // 100)
        other = list(one)
        for _ in range(n):
            other[rng.choice([0, 3, rng.randrange(len(one))])] = "_"
        pair = [" ".join(t.split()) for t in (one, "".join(other))]
        a, b = ({t[i : i + 10] for i in range(len(t) - 9)} for t in pair)
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            rows += [(k, t) for t in pair]
    df = spark.createDataFrame(rows, "k long, line string").withColumn("line_id", F.xxhash64("line"))
    signed = lines.line_signatures(df.select("line_id", F.col("line").alias("bare")), ["line_id"])
    keys = df.join(signed, "line_id").select("k", "line_id", F.explode(F.array(*[f"k{b}" for b in range(len(lines.BANDS))])).alias("key"))
    met = keys.groupBy("k", "key").agg(F.countDistinct("line_id").alias("n")).groupBy("k").agg(F.max("n").alias("n")).collect()
    assert len(met) > 300 and sum(r["n"] == 2 for r in met) > 0.98 * len(met)


def test_crowds_of_lines_lose_no_link(spark, monkeypatch):
    """Lines of one pattern, most just too unlike, some linked: by rarest shingles the same classes as by all pairs of a bucket."""
    rng = random.Random(12)
    base = [rng.choice("abcdefghij") for _ in range(300)]
    rows = []
    for k in range(160):
        line = list(base)
        for place in rng.sample(range(5, 290), 5):
            line[place] = chr(0x4E00 + rng.randrange(5000))
        rows.append("".join(line))
        if k % 8 == 0:  # a line of its own that is linked to it alone
            line[rng.randrange(5, 290)] = "#"
            rows.append("".join(line))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")
    found = {}
    for crowd in (3, 10**9):
        monkeypatch.setattr(lines, "CROWD", crowd)
        found[crowd] = {r["doc_id"]: r["class_id"] for r in lines.line_duplicates(df).collect()}
    assert found[3] == found[10**9] and 20 < len(set(found[3].values())) < len(rows)
    grams = [{t[i : i + 10] for i in range(len(t) - 9)} for t in rows]
    want = components(list(range(len(rows))), lambda a, b: 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]))
    firsts = {}
    assert all(firsts.setdefault(found[3][k], want[k]) == want[k] for k in want)


def test_short_documents_of_just_the_threshold(spark):
    rng = random.Random(31)
    docs, word = [], iter(range(10**9))
    for _ in range(500):  # one of 5 shingles, or 2 of 10, is not in common: a likeness of exactly 0.8
        n = rng.choice([4, 8])
        shared = [f"w{next(word)}" for _ in range(n + 3)]
        for k in range(2 if n == 8 else 1):
            docs.append((len(docs), " ".join([f"x{next(word)}", *shared])))
        if n == 4:
            docs.append((len(docs), " ".join(shared)))
    sets = {d: shingles(t, 4) for d, t in docs}
    want = {d: d - 1 if d % 2 else d for d in sets}
    assert all(100 * len(sets[d] & sets[d + 1]) == 80 * len(sets[d] | sets[d + 1]) for d in range(0, len(docs), 2))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, words=4).collect()} == want


def test_signature_lanes_are_independent():
    import numpy as np

    rng, apart = np.random.default_rng(5), []
    for _ in range(4000):
        h = rng.integers(0, 1 << 64, 10, dtype=np.uint64)
        (a, x), (b, y) = (neardup.signature(s) for s in (h[:9], h[1:]))
        apart.append((a.view("<u2") != b.view("<u2")).sum() + (x.view("u1") != y.view("u1")).sum())
    assert abs(np.mean(apart) - 25.6) < 0.5 and 18 < np.var(apart) < 23  # binomial: 20.5
    assert np.mean(np.array(apart) > neardup.MAX_APART) < 1e-3


def test_mixing_with_very_large_rates(spark):
    import hashlib
    import math

    docs = [(k, "x", "tiny") for k in range(4)] + [(9, "x" * 200_000, "big"), (None, "z" * 8, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(df, {"tiny": 1, "big": 1}).collect()}
    assert rates["tiny"] > mixing.MOST_RATE
    got = mixing.mix_sources(df, {"tiny": 1, "big": 1}, columns=["doc_id", "source"])
    seen = {r["doc_id"]: r for r in got.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.max("copy").alias("last")).collect()}
    for k in range(4):
        u, total, n, rate = int(hashlib.md5(f"0:{k}".encode()).hexdigest()[:13], 16) / 2**52, 0.0, -1, rates["tiny"]
        while total <= u:
            n += 1
            total += math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
        assert seen[k]["n"] == seen[k]["d"] == seen[k]["last"] and abs(seen[k]["n"] - n) <= 1
    assert None not in seen


def test_bitmaps_lose_no_link(spark):
    rng = random.Random(33)
    rows = ["ab" * 50, "z" * 400, "short", "漢字" * 40]
    for _ in range(25):  # a line and one with as many changed places as keep it near the threshold, of 40 to 3,000 characters
        line = [rng.choice("abcdefghij ") for _ in range(rng.choice([40, 90, 200, 700, 3000]))]
        near = list(line)
        for _ in range(max(1, len(line) // rng.choice([90, 120, 150, 200]))):
            near[rng.randrange(len(near))] = "#"
        rows += ["".join(line), "".join(near)]
    bare = sorted({" ".join(r.split()) for r in rows})
    grams = {b: ({b[i : i + 10] for i in range(len(b) - 9)} or {b}) for b in bare}
    df = spark.createDataFrame([(b,) for b in bare], "line string")
    ids = df.select(F.xxhash64("line").alias("line_id"), "line")
    _, bitmaps = lines.lines_named(ids.select("line_id", F.col("line").alias("bare")))
    assert {r["line"]: r["n"] for r in ids.join(bitmaps, "line_id").collect()} == {b: len(g) for b, g in grams.items()}
    named = ids.join(bitmaps, "line_id")
    sides = [named.select(*[F.col(c).alias(f"{side}{c}") for c in named.columns]) for side in ("a_", "b_")]
    passed = {(r["a_line"], r["b_line"]) for r in sides[0].join(sides[1], F.col("a_line") < F.col("b_line")).where(lines.alike("a_", "b_", 80)).select("a_line", "b_line").collect()}
    want = {(a, b) for a in bare for b in bare if a < b and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])}
    assert len(want) > 5 and want <= passed and len(passed) < 3 * len(want)


def test_lines_are_cut_once_and_only_shared_buckets_are_kept(spark, monkeypatch):
    """Texts are read for their lines in one pass; of the keys only those of several lines stay; lanes are minima over every shingle."""
    passes, cut = [], lines.bare_lines
    monkeypatch.setattr(lines, "bare_lines", lambda df: passes.append(1) or cut(df))
    docs = [(2, "one line of some text\n\nTWO"), (1, "two\none  line of some text"), (3, None), (None, "two")]
    got = lines.line_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(passes) == 1
    assert {(r["doc_id"], r["line_no"]) for r in got if r["kept"]} == {(1, 0), (1, 1), (2, 1)}
    assert len({r["class_id"] for r in got}) == 3 and all((r["line_id"] is None) == (r["class_id"] is None) for r in got)
    keys = spark.createDataFrame([(1, 5), (1, 4), (2, 6), (3, 7), (3, 8), (3, 9)], "key long, id long")
    assert sorted(tuple(r) for r in lines.members_of(keys).collect()) == [(1, 4, 4), (1, 5, 4), (3, 7, 7), (3, 8, 7), (3, 9, 7)]
    texts = ["".join(random.Random(n).choices("abcdefgh", k=n)) for n in range(1, 60)]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts) for _ in range(1 + n % 3)], "line_id long, bare string")
    least = {r["line_id"]: r for r in lines.lane_minima(df, 1, ["line_id"]).collect()}
    each = df.distinct().select("line_id", F.explode(F.expr("transform(sequence(1, greatest(1, length(bare) - 9)), i -> substring(bare, i, 10))")).alias("s"))
    want = each.groupBy("line_id").agg(F.min(F.xxhash64(F.xxhash64(F.encode("s", "UTF-32")), F.lit(0))).alias("l0")).collect()
    assert {r["line_id"]: r["l0"] for r in want} == {k: r["l0"] for k, r in least.items()}
    assert all(r["copies"] == 1 + k % 3 for k, r in least.items())
