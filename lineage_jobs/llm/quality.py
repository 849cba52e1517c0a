"""Quality scores: random-indexing word vectors of the whole corpus, pooled per document, under a small calibrated network."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineage_jobs.runtime import materialize, release

#: A word is named by its checksum in so many buckets; a vector has so many components. They bound the table of vectors: 16 MB.
BUCKETS, WIDTH = 1 << 16, 64
#: Words on either side that make up a context, and components that are not zero in the index vector of a word.
WINDOW, NONZERO = 2, 2
#: Share of all words at which a word counts half in a document's pool.
COMMON = 1e-3
#: Labelled documents that the network is fitted on, those with the least hashes; every CALIBRATION-th is kept for the temperature.
LABELLED, CALIBRATION = 12_000, 5
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4
#: Words that are counted together, characters that are cut into words together, and entries of a worker's table of words.
TOGETHER, PIECE, CACHED, KEPT_CHARS = 300_000, 1 << 20, 200_000, 48

WORD, SPACE = re.compile(r"\w+|[^\w\s]+"), re.compile(r"\s")


class Buckets(dict):
    """The bucket of each word, as it is met."""

    def __missing__(self, word: str) -> int:
        bucket = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        if len(word) <= KEPT_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[word] = bucket
        return bucket


def word_pieces(text: str | None, buckets: Buckets):
    """The buckets of a text's words in order, a piece of the text at a time; pieces are cut at white space."""
    text, start = text or "", 0
    while start < len(text):
        space = SPACE.search(text, start + PIECE)
        end = space.start() if space else len(text)
        words = WORD.findall(text, start, end)
        if words:
            yield np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
        start = end


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of the components of each bucket's index vector that are not zero."""
    drawn = np.random.default_rng(11)
    return drawn.integers(0, WIDTH, (BUCKETS, NONZERO)), drawn.choice([-1.0, 1.0], (BUCKETS, NONZERO))


class Contexts:
    """Sums of the index vectors of the words round each word."""

    def __init__(self):
        self.sums, self.counts = np.zeros(BUCKETS * WIDTH), np.zeros(BUCKETS, np.int64)
        self.places, self.signs = index_vectors()
        self.waiting, self.held, self.last = [], 0, np.zeros(0, np.int64)

    def add(self, words: np.ndarray, goes_on: bool) -> None:
        """Take a piece; ``goes_on`` says whether it follows the last one in the same text."""
        before = self.last if goes_on else self.last[:0]
        piece = np.concatenate([before, words])
        self.waiting.append((piece, len(before)))
        self.held, self.last = self.held + len(piece), piece[-WINDOW:]
        if self.held >= TOGETHER:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        words = np.concatenate([w for w, _ in self.waiting])
        text = np.repeat(np.arange(len(self.waiting)), [len(w) for w, _ in self.waiting])
        new = np.concatenate([np.arange(len(w)) >= known for w, known in self.waiting])
        self.counts += np.bincount(words[new], minlength=BUCKETS)
        cells, values = [], []
        for apart in range(1, WINDOW + 1):
            pair = (text[apart:] == text[:-apart]) & new[apart:]
            left, right = words[:-apart][pair], words[apart:][pair]
            for word, other in ((left, right), (right, left)):
                for k in range(NONZERO):
                    cells.append(word * WIDTH + self.places[other, k])
                    values.append(self.signs[other, k])
        self.sums += np.bincount(np.concatenate(cells), np.concatenate(values), minlength=BUCKETS * WIDTH)
        self.waiting, self.held = [], 0


def context_sums(documents: DataFrame, text: str = "text") -> DataFrame:
    """``(bucket, n, v0.., )``: how often the words of each bucket occur in all texts, and their summed contexts.

    Each task sums its own texts and gives a row for each bucket at most; these are summed by bucket.
    """
    names = [f"v{k}" for k in range(WIDTH)]

    def run(batches):
        contexts, buckets = Contexts(), Buckets()
        for batch in batches:
            for value in batch.column(0):
                for k, piece in enumerate(word_pieces(value.as_py(), buckets)):
                    contexts.add(piece, k > 0)
        contexts.flush()
        sums = contexts.sums.reshape(BUCKETS, WIDTH)
        used = np.flatnonzero(contexts.counts)
        for start in range(0, len(used), 8_192):
            rows = used[start : start + 8_192]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows.astype(np.int32)), pa.array(contexts.counts[rows]), *(pa.array(c.astype(np.int64)) for c in sums[rows].T)], names=["bucket", "n", *names]
            )

    schema = "bucket int, n long, " + ", ".join(f"{c} long" for c in names)
    rows = documents.select(F.col(text)).where(F.col(text).isNotNull()).mapInArrow(run, schema)
    return rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ["n", *names]])


def word_vectors(sums: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of all buckets, of length 1, and their weights in a pool; unused buckets have zeros."""
    found = sums.toArrow()  # BUCKETS rows at most
    at = found.column("bucket").to_numpy()
    vectors, weights = np.zeros((BUCKETS, WIDTH), np.float32), np.zeros(BUCKETS, np.float32)
    if len(at):
        raw = np.stack([found.column(f"v{k}").to_numpy() for k in range(WIDTH)], axis=1).astype(np.float64)
        vectors[at] = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1.0)
        n = found.column("n").to_numpy().astype(np.float64)
        weights[at] = COMMON / (COMMON + n / n.sum())
    return vectors, weights


def pool(pieces, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A document's features: weighted mean and deviation of its words' vectors, and the logarithm of its number of words."""
    pieces = list(pieces)
    out = np.zeros(2 * WIDTH + 1, np.float32)
    if pieces:
        words, counts = np.unique(np.concatenate(pieces), return_counts=True)
        share = counts * weights[words].astype(np.float64)
        share /= max(share.sum(), 1e-30)
        own = vectors[words]
        mean = share @ own
        out[:WIDTH], out[WIDTH:-1] = mean, np.sqrt(np.maximum(share @ (own * own) - mean * mean, 0.0))
        out[-1] = np.log1p(counts.sum())
    return out


@dataclass
class Network:
    """Two layers over standardised features; ``temperature`` divides what they say."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.layers[0] + self.layers[1], 0.0)
        return hidden @ self.layers[2] + self.layers[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40.0, 40.0)))


def risk(z: np.ndarray, y: np.ndarray) -> float:
    """The mean logarithmic loss of logits."""
    return float(np.mean(np.logaddexp(0.0, z) - y * z))


def gradients(layers: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The gradients of ``risk + DECAY / 2 * (squared weights)`` of both layers on standardised features."""
    hidden = np.maximum(x @ layers[0] + layers[1], 0.0)
    g = (sigmoid(hidden @ layers[2] + layers[3]) - y) / len(x)
    back = np.outer(g, layers[2]) * (hidden > 0)
    return [x.T @ back + DECAY * layers[0], back.sum(axis=0), hidden.T @ g + DECAY * layers[2], np.array(g.sum())]


def fit_network(x: np.ndarray, y: np.ndarray) -> Network:
    """A network fitted by Adam in batches; the order and the first weights are fixed."""
    drawn, width = np.random.default_rng(11), x.shape[1]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / scale
    layers = [drawn.normal(0, np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN), drawn.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.array(0.0)]
    first, second, t = [0 * w for w in layers], [0 * w for w in layers], 0
    for _ in range(EPOCHS):
        order = drawn.permutation(len(x))
        for start in range(0, len(x), BATCH):
            rows = order[start : start + BATCH]
            t += 1
            for k, g in enumerate(gradients(layers, x[rows], y[rows])):
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
                layers[k] = layers[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Network(mean, scale, layers)


def best_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature from 1/20 to 20 whose logits have the least risk, by golden section of its logarithm."""
    low, high, ratio = -np.log(20.0), np.log(20.0), (np.sqrt(5) - 1) / 2
    loss = lambda t: risk(z / np.exp(t), y)
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    at_a, at_b = loss(a), loss(b)
    for _ in range(60):
        if at_a <= at_b:
            high, b, at_b = b, a, at_a
            a = high - ratio * (high - low)
            at_a = loss(a)
        else:
            low, a, at_a = a, b, at_b
            b = low + ratio * (high - low)
            at_b = loss(b)
    return float(np.exp((low + high) / 2))


def held_out(doc_id):
    """Rows that no label may be learnt from: the remainder of the id's checksum by 3 is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def pooled_documents(documents: DataFrame, vectors: np.ndarray, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, pooled)``: the features of every document as 32-bit floats; null texts count as empty."""
    shared = documents.sparkSession.sparkContext.broadcast((vectors, weights))  # BUCKETS * (WIDTH + 1) floats

    def run(batches):
        (vectors, weights), buckets = shared.value, Buckets()
        for batch in batches:
            made = [pool(word_pieces(v.as_py(), buckets), vectors, weights).tobytes() for v in batch.column("quality_text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(made, pa.binary())], names=["doc_id", "held_out", "pooled"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("quality_text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, pooled binary")


def features_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, 2 * WIDTH + 1).astype(np.float64)


def fit_quality(pooled: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> Network | float:
    """A network learnt from the labelled rows that aren't held out, at most :data:`LABELLED` of them, or the share of good ones where all are alike.

    Ids with both labels teach nothing, nor do null ids and labels; of rows with the same id the greatest features count.
    """
    marks = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(quality).alias("quality")).where(
        F.col("doc_id").isNotNull() & ~held_out("doc_id") & F.col("quality").isNotNull()
    )
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("y")).where("least = y").select("doc_id", "y")
    known = marks.join(pooled.select("doc_id").where("not held_out").distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    rows = pooled.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.max("pooled").alias("pooled"))
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    if not found.num_rows:
        return 0.5
    x, y = features_of(found.column("pooled")), (found.column("y").to_numpy() == 1).astype(np.float64)
    if y.min() == y.max():
        return float((y.sum() + 1) / (len(y) + 2))
    kept = np.arange(len(y)) % CALIBRATION == 0
    network = fit_network(x[~kept], y[~kept])
    network.temperature = best_temperature(network.logits(x[kept]), y[kept])
    return network


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row for each document.

    Word vectors are summed over all texts of ``documents``; the network over a document's pooled vectors learns from the
    labels of rows that aren't held out. Null, empty and wordless texts have zeros for features and a score from them; very long
    texts are read whole, a piece at a time. Null ids are scored and teach nothing; repeated rows stay, and count for each row
    in the word vectors. Without labels of both kinds every document gets the share of good labels (0.5 without any). An
    empty table gives an empty one. Ids, sources and languages are no inputs.
    """
    sums = materialize(context_sums(documents, text))
    vectors, weights = word_vectors(sums)
    pooled = materialize(pooled_documents(documents, vectors, weights, doc_id, text))
    release(sums)
    model = fit_quality(pooled, labels, doc_id, quality)

    def run(batches):
        for batch in batches:
            x = features_of(batch.column("pooled"))
            score = model.scores(x) if isinstance(model, Network) else np.full(len(x), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return pooled.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
