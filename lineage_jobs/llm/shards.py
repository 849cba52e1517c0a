"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineage_jobs.runtime import materialize


def byte_size(text: str = "text"):
    """UTF-8 bytes of a text (null: none) plus one for its end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def prefix_sums(sized: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``sized`` with ``rank`` and ``before`` (rows and bytes before each row in the order of ``order``), and the
    totals by part. The rows are dealt by ranges of ``order``; each part sums its own rows, and only the parts'
    totals, one row a part, are summed over all.
    """
    order = [*order, "tie"]  # so that equal rows, however many, can be dealt to several parts
    dealt = materialize(
        sized.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .withColumn("part", F.spark_partition_id())
    )
    totals = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("part_rows"), F.sum("size").alias("part_bytes"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "part",
        "part_rows",
        "part_bytes",
        F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("part_bytes").over(earlier), F.lit(0)).alias("bytes_before"),
    )
    here = Window.partitionBy("part").orderBy(*order)
    run = here.rowsBetween(Window.unboundedPreceding, -1)
    summed = (
        dealt.withColumn("rank", F.row_number().over(here) - 1)
        .withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
        .join(F.broadcast(totals), "part")  # one row a part
        .withColumn("rank", (F.col("rank") + F.col("rows_before")).cast("long"))
        .withColumn("before", (F.col("before") + F.col("bytes_before")).cast("long"))
        .drop("tie", "part", "part_rows", "part_bytes", "rows_before", "bytes_before")
    )
    return summed, totals


def assign_shards(
    documents: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` and the columns of ``keep``, one row for each document.

    The documents stand in the order of their ids (nulls first; then by checksum and size, so rows that tie are
    alike); a row goes to the shard in whose share of all bytes its middle lies. So shards are contiguous and
    differ from equal size by less than one document. ``slot`` counts the rows of a shard from 0. A null text
    has size 1 and checksum 0; an empty table gives an empty result. Texts aren't dealt out unless kept.
    """
    sized = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        byte_size(text).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        *[F.col(c).alias(f"kept_{c}") for c in keep or []],
    )
    rows, totals = prefix_sums(sized, ["doc_id", "text_crc32", "size"])
    whole = totals.agg(F.sum("part_bytes")).head()[0] or 1
    cut = rows.withColumn(
        "shard", F.least(F.lit(shards - 1), F.expr(f"(2 * before + size) * {shards}L div (2L * {whole}L)")).cast("int")
    )
    first = cut.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # at most ``shards`` rows
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("rank") - F.col("first_rank")).alias("slot"),
        *[F.col(f"kept_{c}").alias(c) for c in keep or [] if c not in ("doc_id", "size", "text_crc32")],
    )
