"""Quality scores against plain versions and held-out labels."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from conftest import SMALL
from lineage_jobs.llm import quality

ODD = [(1, None), (2, ""), (3, " \n "), (4, "a  b\nc <s> ▁x\tq é"), (4, "a  b\nc <s> ▁x\tq é"), (None, "word one " * 9000), (5, "x" * 30000), (6, "!!! ??"), (7, "a b a b a a")]


def plain_contexts(texts):
    places, signs = quality.index_vectors()
    sums, counts = np.zeros((quality.BUCKETS, quality.WIDTH)), np.zeros(quality.BUCKETS, np.int64)
    for text in texts:
        words = [zlib.crc32(w.encode()) % quality.BUCKETS for w in quality.WORD.findall(text or "")]
        for i, w in enumerate(words):
            counts[w] += 1
            for j in range(max(0, i - quality.WINDOW), min(len(words), i + quality.WINDOW + 1)):
                if j != i:
                    for k in range(quality.NONZERO):
                        sums[w, places[words[j], k]] += signs[words[j], k]
    return sums, counts


def plain_pool(text, sums, counts):
    """The features by the definition, word by word."""
    words = [zlib.crc32(w.encode()) % quality.BUCKETS for w in quality.WORD.findall(text or "")]
    if not words:
        return np.zeros(2 * quality.WIDTH + 1)
    weight = lambda w: quality.COMMON / (quality.COMMON + counts[w] / counts.sum())
    own = np.array([sums[w] / max(np.linalg.norm(sums[w]), 1) for w in words])
    share = np.array([weight(w) for w in words])
    mean = np.average(own, axis=0, weights=share)
    return np.concatenate([mean, np.sqrt(np.maximum(np.average(own**2, axis=0, weights=share) - mean**2, 0)), [np.log1p(len(words))]])


def test_contexts_and_pools_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 500)  # texts in many pieces
    texts = [t for _, t in ODD]
    contexts, buckets = quality.Contexts(), quality.Buckets()
    for n, text in enumerate(texts):
        for k, piece in enumerate(quality.word_pieces(text, buckets)):
            contexts.add(piece, k > 0)
        if n % 3 == 2:
            contexts.flush()
    contexts.flush()
    sums, counts = plain_contexts(texts)
    assert (contexts.counts == counts).all() and (contexts.sums.reshape(sums.shape) == sums).all()
    found = quality.context_sums(spark.createDataFrame(ODD, "doc_id long, text string").repartition(4)).collect()
    assert {r["bucket"]: r["n"] for r in found} == {int(b): int(counts[b]) for b in np.flatnonzero(counts)}
    assert all([r[f"v{k}"] for k in range(quality.WIDTH)] == sums[r["bucket"]].tolist() for r in found)
    vectors, weights = quality.word_vectors(spark.createDataFrame(found))
    for text in texts:
        assert np.allclose(quality.pool(quality.word_pieces(text, buckets), vectors, weights), plain_pool(text, sums, counts), atol=2e-4)


def test_gradients_and_temperature():
    drawn = np.random.default_rng(5)
    x, y = drawn.normal(size=(20, 6)), (drawn.random(20) < 0.4).astype(float)
    layers = [drawn.normal(size=(6, 4)), drawn.normal(size=4), drawn.normal(size=4), np.array(0.3)]

    def loss(ws):
        z = np.maximum(x @ ws[0] + ws[1], 0) @ ws[2] + ws[3]
        p = 1 / (1 + np.exp(-z))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + quality.DECAY / 2 * ((ws[0] ** 2).sum() + (ws[2] ** 2).sum())

    for k, g in enumerate(quality.gradients(layers, x, y)):
        for at in np.ndindex(layers[k].shape):
            moved = [[w.copy() for w in layers] for _ in range(2)]
            moved[0][k][at] += 1e-6
            moved[1][k][at] -= 1e-6
            assert abs((loss(moved[0]) - loss(moved[1])) / 2e-6 - g[at]) < 1e-6
    z = drawn.normal(size=500) * 6
    y = (drawn.random(500) < 1 / (1 + np.exp(-z / 3))).astype(float)
    plain = min(np.exp(np.linspace(-3, 3, 2001)), key=lambda t: quality.risk(z / t, y))
    assert abs(quality.best_temperature(z, y) / plain - 1) < 0.01


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("held_out", "pooled", "score", "n", "bucket", "v0", "quality")})
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (5, 0), (5, 1), (6, None), (None, 0), (7, 0), (99, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.quality_scores(docs, labels.where("doc_id in (1, 4)")).collect()} <= {0.5, 2 / 3, 3 / 4}


def test_held_out_labels_teach_nothing_and_are_met(spark):
    folder = SMALL.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scores = quality.quality_scores(docs, labels)
    met = scores.join(labels.select("doc_id", "quality"), "doc_id").where("held_out and quality is not null").toPandas()
    assert (met.predicted == met.quality).mean() > 0.97
    assert (met[met.quality == 1].predicted == 1).mean() > 0.98
    # chances are calibrated: the mean score is the share of good documents
    assert abs(met.score.mean() - met.quality.mean()) < 0.03
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.quality_scores(docs.limit(2000), turned).toPandas().sort_values("doc_id")
    before = quality.quality_scores(docs.limit(2000), labels).toPandas().sort_values("doc_id")
    assert np.allclose(again.score.values, before.score.values)
