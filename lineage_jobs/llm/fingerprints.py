"""Document fingerprints: every shingle hash below a fixed fraction of the hash range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineage_jobs.llm.shards import prefix_sums

#: Words of a shingle, and the share of the hash range that is retained: 1 / FRACTION.
WORDS, FRACTION = 5, 8
#: The spaces between words: a space and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    """The words of a text, lower-cased; an empty array for a text without any."""
    bare = F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACES))
    return F.when(bare != "", F.split(bare, r"[ \t\n\x0B\f\r]+")).otherwise(F.array().cast("array<string>"))


def shingle_hashes(words: str, length: int = WORDS):
    """64-bit hashes of the shingles of an array column; an array with fewer words is one shingle."""
    w = F.col(words)
    many = F.transform(
        F.sequence(F.lit(0), F.size(w) - length), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(length)])
    )
    return F.when(F.size(w) >= length, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(
        F.array().cast("array<bigint>")
    )


def threshold(fraction: int = FRACTION) -> int:
    """The hash below which lies the share 1 / ``fraction`` of all signed 64-bit hashes."""
    return -(1 << 63) + (1 << 64) // fraction


def retained(hashes: str, fraction: int = FRACTION):
    """The sorted distinct hashes below the threshold; where there are none, the least hash alone.

    Sketches merge by union: hashes at or above the threshold go once one lies below it, and of several only
    the least stays.
    """
    h = F.col(hashes)
    low = F.sort_array(F.array_distinct(F.filter(h, lambda x: x < threshold(fraction))))
    return F.when(F.size(h) == 0, h).otherwise(low)


def with_sketch(documents: DataFrame, text: str, out: str, length: int = WORDS, fraction: int = FRACTION) -> DataFrame:
    """``documents`` with the sketch of a text column as the array column ``out``. Null texts count as empty."""
    words, hashes, low = f"{out}_words", f"{out}_hashes", f"{out}_low"
    return (
        documents.withColumn(words, words_of(F.col(text)))
        .withColumn(hashes, shingle_hashes(words, length))
        .withColumn(low, retained(hashes, fraction))
        .withColumn(out, F.when((F.size(low) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(F.col(low)))
        .drop(words, hashes, low)
    )


def merge_sketches(a, b, fraction: int = FRACTION):
    """The sketch of two texts together from their sketches."""
    both = F.array_union(a, b)
    low = F.sort_array(F.filter(both, lambda x: x < threshold(fraction)))
    return F.when(F.size(both) == 0, both).when(F.size(low) == 0, F.array(F.array_min(both))).otherwise(low)


def containment(a, b):
    """Estimated share of the smaller text's shingles that the other has: 1 for two empty sketches, 0 for one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).when(
        F.size(a) == F.size(b), F.lit(1.0)
    ).otherwise(F.lit(0.0))


def sketch_text(sketch):
    """A sketch as text: its hashes in 16 hex digits each, with commas between."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ",")


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = WORDS, fraction: int = FRACTION) -> DataFrame:
    """``(doc_id, fingerprint)``, the fingerprint as text; see :func:`sketch_text`. Null texts count as empty."""
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return with_sketch(rows, "text", "sketch", length, fraction).select("doc_id", sketch_text("sketch").alias("fingerprint"))


def edit_likeness(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """How like each document's fingerprint is to that of an edited text and to that of the next document.

    The edited text has its last third (whole code points, rounded down) replaced by as many from the start of the
    next document's text, or all of them. The next document is the one with the next smaller id, after the smallest the largest; null
    ids come last, and equal ids go by a hash of their texts. Rows with the same id and text have the same next
    document and equal results; a table of one document has itself as the next. Returned are
    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.
    """
    docs = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    names = docs.select("doc_id", "mark", F.length("text").cast("long").alias("n_chars")).distinct()
    placed, totals = prefix_sums(
        names.select("*", F.col("doc_id").isNull().alias("last"), F.bitwise_not("doc_id").alias("down"), F.lit(0).cast("long").alias("size")),
        ["last", "down", "mark"],
    )
    count = totals.agg(F.sum("part_rows")).head()[0] or 1
    ranks = placed.select("doc_id", "mark", "n_chars", "rank")
    before = ranks.select(
        F.col("doc_id").alias("to_id"),
        F.col("mark").alias("to_mark"),
        F.floor(F.col("n_chars") / 3).cast("int").alias("take"),
        F.pmod(F.col("rank") + 1, F.lit(count)).alias("rank"),
    )
    givers = before.join(ranks, "rank").select("doc_id", "mark", "to_id", "to_mark", "take")
    same = lambda a, b, x, y: F.col(a).eqNullSafe(F.col(x)) & (F.col(b) == F.col(y))
    own = docs.select(F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark"), "text")
    given = with_sketch(
        givers.join(own, same("doc_id", "mark", "own_id", "own_mark")), "text", "next_sketch"
    ).select("to_id", "to_mark", F.expr("substring(text, 1, take)").alias("piece"), "next_sketch")
    given = given.groupBy("to_id", "to_mark").agg(F.first(F.struct("piece", "next_sketch")).alias("given"))  # rows that tie are alike
    pairs = (
        own.join(given, same("own_id", "own_mark", "to_id", "to_mark"))
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))"), "given.piece"))
    )
    both = with_sketch(with_sketch(pairs, "text", "sketch"), "edited", "edited_sketch")
    return both.select(
        F.col("own_id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch_text("sketch").alias("fingerprint"),
        sketch_text("edited_sketch").alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("given.next_sketch")).alias("near_next"),
    )
