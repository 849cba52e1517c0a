"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineage_jobs.runtime import broadcast_if_small, materialize

#: Mean number of copies up to which the table to invert is an array from 0; beyond, it is rows round the mean.
MOST_RATE = 10_000
#: Copies of a document that are made in one go where it may have very many.
BLOCK = 10_000


def uniform(*columns):
    """A number in [0, 1) from the MD5 of the columns, the same on every engine: its first 13 hex digits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_table(rate):
    """Cumulative Poisson probabilities of 0, 1, 2, ... as an array: as far as the tail can matter."""
    most = F.ceil(rate + 9 * F.sqrt(rate) + 20).cast("int")
    steps = F.sequence(F.lit(1), most)
    start = F.struct(F.array(F.exp(-rate)).alias("cdf"), (-rate).alias("log_p"))

    def grow(state, k):
        log_p = state["log_p"] + F.log(rate) - F.log(k.cast("double"))
        return F.struct(
            F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + F.exp(log_p))).alias("cdf"), log_p.alias("log_p")
        )

    table = F.aggregate(steps, start, grow, lambda s: s["cdf"])
    return F.when(rate > 0, table).otherwise(F.array(F.lit(1.0)))


def poisson_rows(rates: DataFrame) -> DataFrame:
    """``(mix_source, mix_low, mix_high, mix_n)``: for large rates, the count ``mix_n`` of the numbers from ``mix_low``
    to below ``mix_high``, a row for each count within nine standard deviations of the mean.

    The probabilities take Stirling's series, with the powers joined so that nothing large cancels.
    """
    spread = 9 * F.sqrt("rate")
    rows = rates.select("source", "rate", F.explode(F.sequence(F.floor(F.col("rate") - spread), F.ceil(F.col("rate") + spread))).alias("n"))
    x = (F.col("n") - F.col("rate")) / F.col("rate")
    p = F.exp(-F.col("rate") * ((1 + x) * F.log1p(x) - x) - 1 / (12.0 * F.col("n"))) / F.sqrt(2 * math.pi * F.col("n"))
    order = Window.partitionBy("source").orderBy("n")
    summed = rows.withColumn("cdf", F.sum(p).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return summed.select(
        F.col("source").alias("mix_source"),
        F.lag("cdf", 1, 0.0).over(order).alias("mix_low"),
        F.when(F.lead("n").over(order).isNull(), 2.0).otherwise(F.col("cdf")).alias("mix_high"),
        F.col("n").alias("mix_n"),
    )


def source_rates(
    documents: DataFrame,
    weights: dict[str, float] | None = None,
    power: float = 0.5,
    budget: float = 1.0,
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """``(source, n_docs, n_bytes, weight, rate)``: a row for each source, null among them.

    ``weight`` is the source's target share of the mixed bytes: its entry in ``weights`` over their sum (0 for a
    source that isn't named), or without ``weights`` its bytes to the power ``power`` over the sum of those.
    ``rate`` is the mean number of copies of each of its documents, so that the expected bytes of the mixture are
    ``budget`` times those of all documents. Sources without bytes have rate 0.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    totals = documents.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("n_bytes")
    )
    if weights is None:
        raw = F.pow(F.col("n_bytes").cast("double"), F.lit(power))
    else:
        raw = F.lit(0.0)
        for name, weight in weights.items():
            raw = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(raw)
    whole = totals.select("*", raw.alias("raw")).agg(F.sum("raw").alias("raw"), F.sum("n_bytes").alias("b")).head()
    share = raw / F.lit(float(whole["raw"] or 1))
    return totals.select(
        "source",
        "n_docs",
        "n_bytes",
        share.alias("weight"),
        F.when(F.col("n_bytes") > 0, share * F.lit(float(budget * (whole["b"] or 0))) / F.col("n_bytes"))
        .otherwise(F.lit(0.0))
        .alias("rate"),
    )


def mix_sources(
    documents: DataFrame,
    weights: dict[str, float] | None = None,
    power: float = 0.5,
    budget: float = 1.0,
    seed: int = 0,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    columns: list[str] | None = None,
) -> DataFrame:
    """The columns of ``columns`` (default: all), ``copy`` (from 1) and ``place``, a row for each copy of a document.

    The number of copies inverts the Poisson distribution of the source's rate (see :func:`source_rates`) at a
    number hashed from ``seed`` and the id (for a null id, from ``seed`` and the row's text and source): the same on
    every run, and independent of how the rows are dealt.
    ``place`` is a hash of seed, id and copy; rows in the order of ``place`` are the global shuffle
    (:func:`shuffled` deals them so). Repeated rows get equal counts each; null and empty texts count no bytes
    for their source and are mixed like others. An empty table gives an empty result. Columns of ``documents`` that are called
    ``copy`` or ``place`` give way to the new ones.
    """
    given = documents.columns
    plain = {c: c for c in given}
    if any(c.lower().startswith("mix_") for c in given):  # make room for the names used below
        plain = {c: f"given_{k}" for k, c in enumerate(given)}
        documents = documents.toDF(*plain.values())
    doc_id, source, text = plain[doc_id], plain[source], plain[text]
    rates = materialize(source_rates(documents, weights, power, budget, source, text))
    known = rates.agg(F.count(F.lit(1)).alias("n"), F.max("rate").alias("most")).head()
    usual = rates.where(F.col("rate") <= MOST_RATE)
    table = usual.select(F.col("source").alias("mix_source"), poisson_table(F.col("rate")).alias("mix_cdf"))
    small = broadcast_if_small(table, known["n"], 10_000)
    unnamed = F.concat(F.lit("-"), F.xxhash64(F.col(text), F.col(source)).cast("string"))
    key = F.coalesce(F.col(doc_id).cast("string"), unnamed)
    seeded = F.lit(str(seed))
    joined = documents.join(small, F.col(source).eqNullSafe(F.col("mix_source")))
    u = uniform(seeded, key)
    beyond = F.filter("mix_cdf", lambda p: p <= F.col("mix_u"))
    counted = joined.withColumn("mix_u", u).withColumn(
        "mix_n", F.least(F.size(beyond), F.size("mix_cdf") - 1)
    )
    kept = columns or given
    copies = counted.where("mix_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix_n"))))
    wanted = [F.col(plain[c]).alias(f"out_{k}") for k, c in enumerate(kept) if c not in ("copy", "place")]
    wanted.append(key.alias("mix_key"))
    copies = copies.select(*wanted, "copy")
    if (known["most"] or 0) > MOST_RATE:
        entries = poisson_rows(rates.where(F.col("rate") > MOST_RATE))
        found = F.col(source).eqNullSafe(F.col("mix_source")) & (F.col("mix_u") >= F.col("mix_low")) & (F.col("mix_u") < F.col("mix_high"))
        blocks = (
            documents.withColumn("mix_u", u)
            .join(entries, found)
            .withColumn("mix_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("mix_n") - 1) / BLOCK))))
            .repartition(key, "mix_block")
        )
        first = F.col("mix_block") * BLOCK + 1
        many = blocks.withColumn("copy", F.explode(F.sequence(first, F.least(first + BLOCK - 1, F.col("mix_n"))))).withColumn("copy", F.col("copy").cast("int"))
        copies = copies.unionByName(many.select(*wanted, "copy"))
    return copies.withColumn("place", F.md5(F.concat_ws(":", seeded, "mix_key", F.col("copy").cast("string")))).select(
        *[F.col(f"out_{k}").alias(c) for k, c in enumerate(kept) if c not in ("copy", "place")], "copy", "place"
    )


def shuffled(mixed: DataFrame) -> DataFrame:
    """The rows of :func:`mix_sources` dealt to the partitions by ranges of ``place`` and sorted by it."""
    return mixed.repartitionByRange("place").sortWithinPartitions("place")
