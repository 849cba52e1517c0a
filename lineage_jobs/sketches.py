"""Mergeable sketches by script, merged under rollup: distinct items by HyperLogLog, quantiles by a log-linear histogram.

A script's sketches are stored once and merged at any grouping of the dimensions, so that no fact is read again. Stored and
merged rows are bounded: some 4 KB for distinct items, some 7,500 buckets for the quantiles of any longs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Binary digits of a value that the histogram keeps: a bucket's value is within 1/128 of every value in the bucket.
DIGITS = 7
#: The sketch of distinct items has 2**12 registers: a relative standard error of 1.04/64, some 1.6 %.
LOG_REGISTERS = 12


def bucket(value):
    """The number of the bucket of a long; larger values never have a lesser one. Negative values mirror the others."""
    size = F.when(value < 0, F.bitwise_not(value)).otherwise(value)
    # how many low digits the bucket leaves out
    shift = F.greatest(F.length(F.bin(size)) - DIGITS, F.lit(0))
    place = (shift * 2 ** (DIGITS - 1)).cast("long") + F.call_function("shiftright", size, shift)
    return F.when(value < 0, -1 - place).otherwise(place)


def bucket_value(number):
    """The middle of a bucket."""
    place = F.when(number < 0, -1 - number).otherwise(number)
    half = 2 ** (DIGITS - 1)
    shift = F.greatest(F.floor(place / half) - 1, F.lit(0)).cast("int")
    width = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    middle = F.call_function("shiftleft", place - shift * half, shift) + F.call_function("shiftright", width, F.lit(1))
    return F.when(number < 0, F.bitwise_not(middle)).otherwise(middle)


def _free(dims: list[str], *taken: str) -> None:
    """Raise where a dimension has the name of a column of the result."""
    if clash := sorted({d.lower() for d in dims} & {"level", "n", *taken}):
        raise ValueError(f"rename the dimensions {clash}")


def distinct_sketches(facts: DataFrame, script: str, dims: list[str], item: str) -> DataFrame:
    """``(script, dims..., n, items)``: each script's facts by their dimensions, counted, and the sketch of their distinct items.

    Null items count in ``n`` only; null scripts and dimensions are values of their own; repeated facts count again in ``n``.
    An empty table gives an empty one. Scripts and dimensions must not be named like the other columns.
    """
    _free([script, *dims], "items")
    return facts.groupBy(script, *dims).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(item).cast("string"), F.lit(LOG_REGISTERS)).alias("items"))


def quantile_sketches(facts: DataFrame, script: str, dims: list[str], measure: str) -> DataFrame:
    """``(script, dims..., n, buckets)``: how many measures each script has by its dimensions, and their buckets ``(bucket, n)``.

    Null measures don't count, and groups without any give no row; otherwise as :func:`distinct_sketches`. Counts are added up
    by bucket before lists are made, so that no list grows with the facts.
    """
    _free([script, *dims], "bucket", "buckets", "permille", "value", "upto")
    number = bucket(F.col(measure).cast("long"))
    fine = facts.where(F.col(measure).isNotNull()).groupBy(script, *dims, number.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return fine.groupBy(script, *dims).agg(F.collect_list(F.struct("bucket", "n")).alias("buckets"), F.sum("n").alias("n"))


def _rolled(rows: DataFrame, dims: list[str], kept: list[str]):
    """``rows`` grouped by ``kept`` and by every prefix of the dimensions."""
    sets = [[F.col(c) for c in kept + dims[:k]] for k in range(len(dims), -1, -1)]
    return rows.groupingSets(sets, *kept, *dims)


def _level(dims: list[str]):
    """How many dimensions a row of a rollup leaves out; it tells totals from null dimensions."""
    return sum((F.grouping(d).cast("int") for d in dims), F.lit(0)).alias("level")


def rollup_distinct(sketches: DataFrame, dims: list[str]) -> DataFrame:
    """``(dims..., level, n, items)`` of :func:`distinct_sketches`: facts and estimated distinct items for every prefix of the dimensions.

    Sketches are merged at the finest grouping first, with partial merges before the shuffle; only its rows are rolled up.
    """
    finest = sketches.groupBy(*dims).agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"))
    rolled = _rolled(finest, dims, []).agg(_level(dims), F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"))
    return rolled.select(*dims, "level", "n", F.hll_sketch_estimate("items").alias("items"))


def rollup_quantiles(sketches: DataFrame, dims: list[str], permilles: list[int]) -> DataFrame:
    """``(dims..., level, permille, n, value)`` of :func:`quantile_sketches`: quantiles for every prefix of the dimensions.

    The value of rank ``ceil(n * permille / 1000)``, at least 1, told by its bucket: within 1/128 of it. ``n`` counts the measures.
    """
    cells = sketches.select(*dims, F.inline("buckets")).groupBy(*dims, "bucket").agg(F.sum("n").alias("n"))
    rolled = _rolled(cells, dims, ["bucket"]).agg(_level(dims), F.sum("n").alias("n"))
    group = Window.partitionBy(*dims, "level")
    counted = rolled.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    asked = counted.withColumn("permille", F.explode(F.array(*[F.lit(p) for p in permilles])))
    rank = F.greatest(F.lit(1), F.ceil(F.col("total") * F.col("permille") / 1000))
    found = asked.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    return found.select(*dims, "level", "permille", F.col("total").alias("n"), bucket_value(F.col("bucket")).alias("value"))
