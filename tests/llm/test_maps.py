"""Operators that look at one row at a time: tokens, urls, decontamination, licences, fingerprints."""

import hashlib
import math
import random

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineage_jobs.llm import decontamination, fingerprints, licenses, tokens, urls

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [(1, None, 9), (2, "", 9), (3, "  \n\t ", 9), (4, "a  b\nc <s> ▁x\tq é", 9), (4, "a  b\nc <s> ▁x\tq é", 9), (None, "word " * 9000, 9), (5, "x" * 30000, 9)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated and very long texts, a null id, columns with clashing names."""
    names = "size rank part shard score copy place key id n hashes rest line words sketch".split()
    df = spark.createDataFrame(ODD, "doc_id long, text string, source long")
    return df.select("doc_id", "text", F.lit("src0").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), *[F.lit(7).alias(n) for n in names])


@pytest.fixture(scope="module")
def table():
    return tokens.Lengths(MODEL, {" the": 1})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁ab<s>é\t\r\x00"), st.characters(exclude_categories=["Cs"]))))
def test_token_counts_equal_the_library(text):
    table = tokens.Lengths(MODEL, {" the": 1})
    assert table.count(text) == len(table.model.encode(text))


def test_tokens_of_odd_rows(spark, odd):
    model = tokens.load_model(MODEL)
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(odd, MODEL).collect())
    want = sorted((d or 0, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for d, t, _ in ODD)
    assert got == want
    assert tokens.token_counts(odd.limit(0), MODEL).count() == 0


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def test_urls(spark):
    pages = [
        (1, "http://A.Example.NET/en/x?q#f", ""), (2, "https://x.net", ""), (3, "notnet/", ""), (4, None, None), (5, "http://badnet/", ""), (6, "http://example.com/de/1", ""),
        (7, "http://good.example/a", '<LINK href="http://spam.net/b" rel="canonical">'), (8, "http://site.org/fr/z", ""), (9, "https://other.example/c#t", "<meta http-equiv=refresh content=\"0; url=http://good.example/a\">"),
        (10, "http://mixed.example/", "<link rel=canonical href='http://spam.net/q'><link rel='canonical' href='http://w.org/fr/ok'>"), (1, "http://A.Example.NET/en/x?q#f", ""), (11, "x://u.NET?a", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit("clash")).withColumn("node", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.url_verdicts(df, RULES).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("x.net", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("badnet", "/", None, "allow"), 6: ("example.com", "/de/1", "example.com/de/", "block"), 7: ("good.example", "/a", None, "block"),
        8: ("site.org", "/fr/z", "org/fr/", "allow"), 9: ("other.example", "/c", None, "block"), 10: ("mixed.example", "/", None, "allow"), 11: ("u.net", "", None, "allow"),
    }
    assert urls.url_verdicts(df, RULES).count() == len(pages)
    assert urls.url_verdicts(df.limit(0), RULES).count() == 0


def test_relative_links_and_many_rules(spark):
    pages = [
        (1, "https://a.test/x/y", "<link rel=canonical href='//spam.net/z'>"), (2, "https://b.test/x/y", "<link rel='canonical' href=\"other\">"),
        (3, "https://b.test/x/other", '<meta http-equiv="refresh" content="0; url=/bad/1">'), (4, "https://c.test", '<link rel="canonical" href="mailto:x@spam.net">'),
        (5, "https://h77.test/p9/q", ""), (6, "https://sub.h77.test/p9", ""), (7, "https://h5001.test/p9/", ""),
    ]
    rules = [(f"h{k}.test/p9/", "block") for k in range(5000)] + [("h77.test/", "allow"), ("net/", "block"), ("b.test/bad/", "block")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.url_verdicts(df, rules).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow"), 5: ("h77.test/p9/", "block"), 6: ("h77.test/", "allow"), 7: (None, "allow")}


def test_tiles_find_reordered_passages():
    words = [f"w{k}" for k in range(30)]
    item = decontamination.text_tokens(" ".join(words))
    moved = decontamination.text_tokens("x y " + " ".join(words[15:]) + " z z " + " ".join(words[:15]))
    assert decontamination.tiles(item, moved) == [(0, 19, 15), (15, 2, 15)]
    assert decontamination.tiles(item, decontamination.text_tokens(" ".join(words[:4]))) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(1, 60))
def test_running_hashes_equal_those_of_each_window(a, width):
    tokens, base = np.array(a, np.uint64), int(decontamination.BASE)
    plain = [sum(x * pow(base, k, 1 << 64) for k, x in enumerate(a[p : p + width])) % (1 << 64) for p in range(len(a) - width + 1)]
    want = [(h ^ (h >> 31)) * int(decontamination.MIX) % (1 << 64) for h in plain]
    assert decontamination.rolling(tokens, width).tolist() == want


def plain_tiling(a, b, least):
    """Greedy string tiling as it is defined: always the longest match of unmarked tokens, of several the first."""
    free_a, free_b, total = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(a)):
            for t in range(len(b)):
                n = 0
                while p + n < len(a) and t + n < len(b) and a[p + n] == b[t + n] and free_a[p + n] and free_b[t + n]:
                    n += 1
                best = max(best, (n, -p, -t))
        n, p, t = best[0], -best[1], -best[2]
        if n < least:
            return total
        free_a[p : p + n], free_b[t : t + n] = [False] * n, [False] * n
        total += n


@settings(max_examples=100, deadline=None)
@given(st.permutations(range(5)), st.integers(0, 3))
def test_coverage_equals_plain_greedy_tiling(order, lost):
    item = list(range(50))  # without repeats the longest match is the only one
    text = [x for k in order for x in [*item[k * 10 + lost : k * 10 + 10], 99]]
    found = decontamination.tiles(np.array(item, np.uint64), np.array(text, np.uint64), 5)
    assert sum(n for _, _, n in found) == plain_tiling(item, text, 5)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=60))
def test_tiles_are_valid_and_leave_nothing(a, b):
    item, text = np.array(a, np.uint64), np.array(b, np.uint64)
    found = decontamination.tiles(item, text, 3)
    free_a, free_b = [True] * len(a), [True] * len(b)
    for p, t, n in found:
        assert n >= 3 and a[p : p + n] == b[t : t + n] and all(free_a[p : p + n]) and all(free_b[t : t + n])
        free_a[p : p + n] = [False] * n
        free_b[t : t + n] = [False] * n
    for p in range(len(a) - 2):  # nothing of the least length is left
        for t in range(len(b) - 2):
            assert not (a[p : p + 3] == b[t : t + 3] and all(free_a[p : p + 3]) and all(free_b[t : t + 3]))


def test_contamination(spark, odd):
    rng = random.Random(2)
    words = [f"b{rng.randrange(10**6)}" for _ in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "too short"), (1, " ".join(words)), (4, "")], "item_id long, text string")
    half, less = " ".join(words[:20]), " ".join(words[:19])
    docs = spark.createDataFrame([(10, f"Pre. {half.upper()}! post"), (11, less), (12, " ".join(words[20:] + ["q"] * 3000 + words[:20])), (13, None)], "doc_id long, text string")
    for most in (1 << 20, 10):
        got = decontamination.contamination(docs, bench, most_bytes=most)
        assert sorted((r["doc_id"], r["item_id"], r["tiled_words"]) for r in got.collect()) == [(10, 1, 20), (12, 1, 40)]
        assert sorted(r["doc_id"] for r in decontamination.drop_contaminated(docs, bench, most_bytes=most).collect()) == [11, 13]
    words = spark.createDataFrame([(7, "Too SHORT!")], "item_id long, text string")
    said = spark.createDataFrame([(1, "it is too short."), (2, "short too"), (3, "too short too short")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_words"]) for r in decontamination.contamination(said, words).collect()) == [(1, 2), (3, 2)]
    for most in (1 << 20, 10):
        assert decontamination.contamination(odd, bench, most_bytes=most).count() == 0
        assert decontamination.drop_contaminated(odd, bench, most_bytes=most).count() == len(ODD)
    assert decontamination.contamination(docs, bench.limit(0)).count() == 0


def test_joined_seeds_equal_broadcast_ones(spark):
    """Few words, so that many items share seeds; items of all lengths, repeated and null rows; both ways give the same rows."""
    rng = random.Random(5)
    items = [(k, " ".join(rng.choice("abcd") for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 20, 60])))) for k in range(60)]
    items += [items[0], (1, items[2][1]), (None, items[7][1]), (99, None), (98, ". ,")]
    texts = []
    for k in range(80):
        words = [rng.choice("abcdefgh") for _ in range(rng.choice([0, 3, 5, 40, 150]))]
        for _ in range(rng.randrange(3)):
            own = items[rng.randrange(60)][1].split()
            at = rng.randrange(len(words) + 1)
            words[at:at] = own[rng.randrange(max(1, len(own) // 2)) :]
        texts.append((k, " ".join(words)))
    texts += [texts[3], (3, texts[4][1]), (None, items[6][1]), (None, None), (90, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for coverage in (0.5, 0.8):
        rows = [sorted(map(str, decontamination.contamination(docs, bench, coverage, most_bytes=most).collect())) for most in (1 << 20, 10)]
        assert rows[0] == rows[1] and len(rows[0]) > 50
        kept = [sorted(map(str, decontamination.drop_contaminated(docs, bench, coverage, most_bytes=most).collect())) for most in (1 << 20, 10)]
        assert kept[0] == kept[1]


def test_seeds_of_a_bitmap_pass():
    keys = np.arange(1, 50_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bitmap = np.zeros(1 << 8, np.uint64)
    for k in keys[:300].tolist():
        bitmap[k >> 56] |= np.uint64(1 << (k >> 50 & 63))
    got = set(decontamination._passing(keys.view(np.int64), bitmap).tolist())
    assert set(keys[:300].view(np.int64).tolist()) <= got and len(got) < 3000


def test_licences(spark):
    files = [
        (1, "a/LICENSE", "The MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
        (2, "a/b/c.py", "print(1)\n"), (3, "a/b/d.py", "# Licensed under the Apache License, Version 2.0.\nx = 1\n" + "word " * 200), (4, "z.py", "print(2)"),
        (5, "a/b/COPYING", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
        (6, "a/b/e/f.py", None), (7, None, "x"), (8, "a/q.py", ""), (8, "a/q.py", ""),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("licence", F.lit("clash"))
    got = {r["doc_id"]: (r["licence"], r["how"], r["from_folder"]) for r in licenses.license_scan(df).collect()}
    assert got == {
        1: ("MIT", "file", None), 2: ("GPL-3.0", "inherited", "a/b"), 3: ("Apache-2.0", "header", None), 4: (None, "none", None), 5: ("GPL-3.0", "file", None),
        6: ("GPL-3.0", "inherited", "a/b"), 7: (None, "none", None), 8: ("MIT", "inherited", "a"),
    }
    assert licenses.license_scan(df).count() == len(files)
    assert licenses.license_scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("mark, width", [("# ", 72), ("// ", 60), (" * ", 79), ("", 4000)])
def test_wrapped_headers_above_code(mark, width):
    import textwrap

    scan = licenses.Scanner(licenses.TEMPLATES, {}, 1)
    code = "\n".join(f"value_{k} = compute(value_{k - 1}, {k})" for k in range(1, 200))
    for name, template in licenses.TEMPLATES:
        if len(template) > 150:
            wrapped = "\n".join(mark + x for x in textwrap.wrap("Copyright 2020 Some One. " + template, width))
            cosine, found = scan.header(f"{wrapped}\n\n{code}")
            assert cosine >= licenses.HEADER_COSINE and (found == name or {found, name} == {"BSD-2-Clause", "BSD-3-Clause"} or {found, name} <= {"GPL-3.0", "AGPL-3.0", "LGPL-3.0", "GPL-2.0"} and cosine < 0.9), (name, found, cosine)
    assert scan.header(code)[0] < 0.3


def test_cosine_against_brute_force():
    texts = [t for _, t in licenses.TEMPLATES] + ["you may use this software under the MIT license", "no such words"]
    lines = [x for t in texts for x in t.split(". ")]
    counts = {w: sum(w in licenses.terms_of(x) for x in lines) for t in texts for w in licenses.terms_of(t)}
    scan = licenses.Scanner(licenses.TEMPLATES, counts, len(lines))
    idf = lambda w: math.log((len(lines) + 1) / (counts.get(w, 0) + 1)) + 1

    def vector(text):
        terms = licenses.terms_of(text)
        return {w: (1 + math.log(terms.count(w))) * (idf(w) if w in scan.idf else scan.most) for w in set(terms)}

    def cosine(a, b):
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        return sum(x * b.get(w, 0) for w, x in a.items()) / (norm(a) * norm(b)) if a and b else 0.0

    for text in texts:
        want = max(cosine(vector(text), vector(t)) for _, t in licenses.TEMPLATES)
        assert math.isclose(scan.cosine(licenses.terms_of(text))[0], min(1.0, want), abs_tol=1e-9)


def test_edit_likeness_against_brute_force(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id is null or doc_id > 3").withColumn("doc_id", F.col("doc_id") + 100_000))
    have = [(r["doc_id"], r["text"] or "") for r in docs.distinct().collect()]
    rows = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in fingerprints.edit_likeness(docs).collect()}
    order = sorted(have, key=lambda x: (x[0] is None, -(x[0] or 0)))
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(docs).collect()}
    for (d, text), (_, after) in zip(order, order[1:] + order[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        row = rows[d, len(text), hashlib.sha256(edited.encode()).hexdigest()]
        assert row["fingerprint"] == prints[d]
        a, b = ({x for x in row[c].split(",") if x} for c in ("fingerprint", "edited_fingerprint"))
        least = min(len(a), len(b))
        assert math.isclose(row["near_edited"], len(a & b) / least if least else float(len(a) == len(b)))
        assert 0 <= row["near_next"] <= 1
    one = fingerprints.edit_likeness(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).head()
    assert one["edited_sha256"] == hashlib.sha256(b"a b c da b").hexdigest()[:0] + hashlib.sha256(("a b c d e f"[:8] + "a b").encode()).hexdigest() and one["near_next"] == 1
    assert fingerprints.edit_likeness(docs.limit(0)).count() == 0


def test_sketches_merge(spark):
    rng = random.Random(4)
    a, b = (" ".join(f"w{rng.randrange(500)}" for _ in range(400)) for _ in range(2))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    out = fingerprints.with_sketch(fingerprints.with_sketch(df, "a", "sa"), "b", "sb").select(fingerprints.merge_sketches(F.col("sa"), F.col("sb")).alias("m"), "sa", "sb").head()
    assert sorted(set(out["sa"]) | set(out["sb"])) == out["m"]
    assert all(h < fingerprints.threshold() for h in out["m"]) and 60 < len(out["m"]) < 140
