"""Token counts by a map-side two-tier lookup of pre-token lengths."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sentencepiece sign for a space.
SPACE = "▁"
#: Runs of spaces with the word after them, words without a space before them, line feeds.
PRETOKEN = re.compile(r" +[^ \n]*|[^ \n]+|\n")
#: Texts and their longest length from which the frequent pre-tokens are taken. They decide speed, never results.
SAMPLE_TEXTS, SAMPLE_CHARS = 1000, 16384
#: Entries of the broadcast table and of each half of a worker's cache; longer pre-tokens are not kept.
FREQUENT, CACHED, KEPT_CHARS = 65_536, 200_000, 48

_MODELS: dict = {}


def load_model(path: str):
    """The sentencepiece model at ``path``, once a process."""
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def splits_exactly(model) -> bool:
    """Whether texts can be cut at :data:`PRETOKEN` without changing the count.

    It holds if texts are taken as they are, with a space put before them, and no piece runs over a cut: none has
    a line feed in it, and none a space after another sign. A merge only ever makes pieces of the vocabulary.
    """
    probe = "a  b　ﬁ \n é"
    if model.normalize(probe) != SPACE + probe.replace(" ", SPACE) or len(model.encode("\n")) != 2:
        return False
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
    return not any("\n" in p or SPACE in p.lstrip(SPACE) for p in pieces)


def encoded_length(model, pretoken: str) -> int:
    """Tokens of one pre-token inside a text."""
    if pretoken == " ":
        return 1
    if pretoken[0] == " ":
        return len(model.encode(pretoken[1:]))  # the library puts one space before what it gets
    return len(model.encode("\n" + pretoken)) - 2


class Lengths(dict):
    """Two-tier table: the broadcast frequent lengths, then a bounded cache of two generations in the worker."""

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.model, self.young, self.old = load_model(path), {}, {}

    def __missing__(self, pretoken: str) -> int:
        n = self.young.get(pretoken)
        if n is None:
            n = self.old.get(pretoken)
            if n is None:
                n = encoded_length(self.model, pretoken)
            if len(pretoken) <= KEPT_CHARS:
                if len(self.young) >= CACHED:
                    self.old, self.young = self.young, {}
                self.young[pretoken] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, PRETOKEN.findall(" " + text.replace(SPACE, " "))))


def frequent_lengths(documents: DataFrame, model_path: str, text: str = "text") -> dict[str, int]:
    """Lengths of the commonest pre-tokens of a bounded sample: at most :data:`FREQUENT` entries."""
    rows = (
        documents.select(F.col(text).alias("text"))
        .where(F.length("text").between(1, SAMPLE_CHARS))
        .limit(SAMPLE_TEXTS)
        .collect()
    )
    seen = Counter()
    for row in rows:
        seen.update(PRETOKEN.findall(" " + row["text"].replace(SPACE, " ")))
    model = load_model(model_path)
    return {p: encoded_length(model, p) for p, _ in seen.most_common(FREQUENT) if len(p) <= KEPT_CHARS}


_TABLES: dict = {}


def token_counts(
    documents: DataFrame, model_path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``documents``, by a sentencepiece model.

    Map only: a text is cut into pre-tokens where no piece can cross, their lengths come from the broadcast table,
    else from the worker's cache, else from the library. A null text counts as an empty one: 0 bytes, 0 tokens.
    Repeated rows, null ids and other columns make no difference; each row gives one row.
    A model for which :func:`splits_exactly` doesn't hold gets each text whole.
    """
    spark = documents.sparkSession
    exact = splits_exactly(load_model(model_path))
    frequent = spark.sparkContext.broadcast(frequent_lengths(documents, model_path, text) if exact else {})

    def run(batches):
        key = (model_path, frequent.id if hasattr(frequent, "id") else id(frequent))
        if key not in _TABLES:
            _TABLES.clear()
            _TABLES[key] = Lengths(model_path, frequent.value)
        table = _TABLES[key]
        for batch in batches:
            n = [
                (table.count(x) if exact else len(table.model.encode(x or "")))
                for x in (v.as_py() for v in batch.column(2))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text).alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
