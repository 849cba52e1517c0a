"""Toxicity scores from confirmed toxic examples and unlabelled text by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineage_jobs.runtime import materialize, release

#: Bounds of the sample that the classifier is fitted on: toxic texts, and unlabelled texts.
POSITIVES, UNLABELLED = 4_000, 16_000
#: Features of the model, toxic texts that a feature must occur in, and how far its rate must stand out.
FEATURES, LEAST_TEXTS, TELLING = 20_000, 3, 6.0
#: Least chance that a text with a feature is toxic.
LEAST_CHANCE = 0.5
#: Starts of words that count as features beside the words themselves.
STARTS = (4, 5, 6)
#: Entries of a worker's cache of word features; longer words aren't kept.
CACHED, KEPT_CHARS = 100_000, 48

WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    """A word and its starts; a start is written with a ``*``."""
    return [word, *(word[:n] + "*" for n in STARTS if len(word) >= n)]


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Model:
    """A logistic model over features that a text has or hasn't."""

    weights: dict[str, float]
    bias: float
    prior: float
    cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.weights, self.bias, self.prior

    def __setstate__(self, state):
        self.weights, self.bias, self.prior = state
        self.cache = {}

    def known(self, word: str) -> tuple:
        """The features of a word that have a weight."""
        found = self.cache.get(word)
        if found is None:
            found = tuple(f for f in word_features(word) if f in self.weights)
            if len(word) <= KEPT_CHARS:
                if len(self.cache) >= CACHED:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def score(self, text: str | None) -> float:
        have = set()
        for word in text_words(text):
            if found := self.known(word):
                have.update(found)
        z = self.bias + sum(self.weights[f] for f in have)
        return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))


def fit_pu(rows: list[np.ndarray], positive: np.ndarray, width: int, prior: float, rounds: int = 600, rate: float = 0.05, l2: float = 1e-6):
    """Weights and bias of the non-negative PU risk, by Adam on the whole sample.

    With the sigmoid loss ``loss(z) = 1 / (1 + exp(z))`` the risk is
    ``prior * E_p[loss(f)] + max(0, E_u[loss(-f)] - prior * E_p[loss(-f)])``; where the second part falls below zero,
    its gradient is turned round, so that the model cannot fit the unlabelled texts as all negative. The loss is
    bounded, so a prior that is a little off cannot pull the bias up without end.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    w, b = np.full(width, 0.5), float(np.log(prior / (1 - prior)))
    unlabelled = ~positive
    n_p, n_u = max(1, positive.sum()), max(1, unlabelled.sum())
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(at, w[cols], minlength=len(rows)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        slope = p * (1 - p)
        rest = p[unlabelled].sum() / n_u - prior * p[positive].sum() / n_p
        of_positive = np.where(positive, -prior * slope / n_p, 0.0)
        of_rest = np.where(positive, -prior * slope / n_p, slope / n_u)
        g = of_positive + of_rest if rest >= 0 else -of_rest
        grad = np.append(np.bincount(cols, g[at], minlength=width) + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = np.maximum(w - step[:-1], 0.0), b - step[-1]  # only signs of toxicity are features
    return w, b


def blank_model(prior: float) -> Model:
    """A model without features, which gives every text the prior."""
    return Model({}, float(np.log(prior / (1 - prior))), prior)


def held_out(doc_id):
    """Rows that no label may be learnt from: the remainder of the id's checksum by 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(documents: DataFrame, ids: DataFrame, most: int, positive: bool) -> DataFrame:
    """``(doc_id, text, positive)`` of up to ``most`` of ``ids``, those with the least hashes."""
    chosen = ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))  # at most ``most`` ids
    return texts.select("doc_id", "text", F.lit(positive).alias("positive"))


def telling_features(sample: DataFrame, positives: int, unlabelled: int, prior: float) -> list[str]:
    """The features that occur oftener in toxic texts than in all: at most :data:`FEATURES`, the most telling first.

    A feature's rate among the toxic texts must lie :data:`TELLING` standard errors above its rate in the unlabelled ones, and
    a text that has it must be toxic with a chance of :data:`LEAST_CHANCE` or more, by the class prior.
    """

    def run(batches):
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, positive in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for f in {f for w in text_words(text.as_py()) for f in word_features(w)}:
                    seen.setdefault(f, [0, 0])[not positive] += 1
            counts = np.array(list(seen.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(counts[:, 0]), pa.array(counts[:, 1])], names=["feature", "p", "u"])

    counts = (
        sample.select("text", "positive")
        .mapInArrow(run, "feature string, p long, u long")
        .groupBy("feature")
        .agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    )
    base = (F.col("u") + 1) / F.lit(float(unlabelled + 2))
    told = (F.col("p") - positives * base) / F.sqrt(positives * base * (1 - base) + 1e-9)
    chance = F.lit(prior / positives) * F.col("p") / ((F.col("u") + 1) / F.lit(float(unlabelled + 1)))
    best = (
        counts.where(F.col("p") >= LEAST_TEXTS)
        .withColumn("told", told)
        .where((F.col("told") > TELLING) & (chance > LEAST_CHANCE))
    )
    return [r["feature"] for r in best.orderBy(F.col("told").desc(), "feature").limit(FEATURES).select("feature").collect()]


def _rows(sample: DataFrame, features: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The numbers of each sampled text's features, and which texts are toxic."""
    shared = sample.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(features)})  # at most FEATURES

    def run(batches):
        number = shared.value
        for batch in batches:
            got = [
                np.array(sorted({number[f] for w in text_words(t.as_py()) for f in word_features(w) if f in number}), "<i4").tobytes()
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.binary())], names=["doc_id", "positive", "has"])

    rows = sample.mapInArrow(run, "doc_id long, positive boolean, has binary").orderBy("positive", "doc_id").collect()
    return [np.frombuffer(r["has"], "<i4").astype(np.int64) for r in rows], np.array([r["positive"] for r in rows], dtype=bool)


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic"
) -> Model:
    """A model learnt from the rows that aren't held out.

    Confirmed toxic rows (``toxic = 1``) are the positives; rows of ``documents``, whatever their label, are the
    unlabelled texts; the class prior is the share of toxic rows among all labelled ones that aren't held out.
    Both samples are bounded (:data:`POSITIVES`, :data:`UNLABELLED`: the ids of the least hashes) and take whole texts
    of any length. Rows with a null id, text or label aren't learnt from; of rows with the same id the greatest text counts,
    and an id is toxic if any of its labels says so. Without toxic rows every text gets the prior.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(
        F.col("doc_id").isNotNull() & ~held_out("doc_id") & F.col("text").isNotNull()
    )
    marks = (
        labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(toxic).alias("toxic"))
        .where(F.col("doc_id").isNotNull() & ~held_out("doc_id") & F.col("toxic").isNotNull())
    )
    prior = marks.agg(F.avg((F.col("toxic") == 1).cast("double"))).head()[0] or 0.0
    prior = min(max(prior, 1e-4), 0.9)
    sample = materialize(
        _sample(docs, marks.where("toxic = 1"), POSITIVES, True).unionByName(_sample(docs, docs, UNLABELLED, False))
    )
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    features = telling_features(sample, sizes.get(True, 0), sizes.get(False, 0), prior) if sizes.get(True) else []
    if not features:
        return blank_model(prior)
    rows, positive = _rows(sample, features)
    release(sample)
    w, b = fit_pu(rows, positive, len(features), prior)
    return Model({f: float(x) for f, x in zip(features, w, strict=True) if abs(x) > 1e-6}, float(b), prior)


def toxicity_scores(documents: DataFrame, model: Model, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` and the columns of ``keep``, one row for each document.

    The score is that of the whole text: which features it has decides. Null and empty texts get the score of a text without
    features. Ids, sources and languages are no inputs. Repeated rows stay.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights
    kept = [c for c in keep or [] if c not in ("doc_id", "held_out", "score", "predicted")]

    def run(batches):
        model = shared.value
        for batch in batches:
            scores = [model.score(x.as_py()) for x in batch.column("tox_text")]
            columns = [batch.column(c) for c in ("doc_id", "held_out", *kept)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=["doc_id", "held_out", *kept, "score", "predicted"],
            )

    rows = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), *kept, F.col(text).alias("tox_text")
    )
    schema = ", ".join(["doc_id long", "held_out boolean", *(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept), "score double", "predicted int"])
    return rows.mapInArrow(run, schema)
