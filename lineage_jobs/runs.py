"""What scripts met when they ran: catalogues as of a time, runs that overlapped, sessions, and differences of two graphs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineage_jobs.runtime import materialize

#: Pieces of time that a join as of a time is cut into.
BINS = 64


def _number(time, kind: str):
    """A number that never falls while a time of a type rises: seconds by the clock for dates and times without a zone."""
    if kind in ("timestamp_ntz", "date"):
        clock = 3600 * F.hour(time) + 60 * F.minute(time) + F.second(time) if kind == "timestamp_ntz" else F.lit(0)
        return (86_400 * F.unix_date(time.cast("date")).cast("long") + clock).cast("double")
    return (F.unix_micros(time) if kind == "timestamp" else time).cast("double")


def _time_bins(rows: DataFrame, at: str, bins: int):
    """A function from a time to the number of its piece; the pieces hold about equally many of ``rows``."""
    kind = rows.schema[at].dataType.simpleString()
    times = rows.select(_number(F.col(at), kind).alias("t"))
    cuts = [k / bins for k in range(1, bins)]
    bounds = sorted(set(times.agg(F.percentile_approx("t", cuts, 4 * bins).alias("b")).head()["b"] or [])) if cuts else []
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    return lambda time: F.size(F.filter(edges, lambda b: b <= _number(time, kind)))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, values: list[str], bins: int = BINS, least: int = 1000) -> DataFrame:
    """``left`` with the ``values`` of ``right`` that hold for its ``key`` at its time: the row with the latest ``since`` not after ``at``.

    Of right rows with one key and time those with the greatest values count; both times are of one type. Left rows without a match, a key or a time have nulls. Repeated
    rows stay. Both sides are laid one behind the other and the last value is carried on, so there is no join on a
    range: time is cut into ``bins`` pieces, what holds at a piece's start is carried into it, and the left rows of a piece with more of
    them than a task's fair share are dealt to several tasks, each with the piece's right rows. ``key`` and ``at`` are columns of
    ``left``, ``key`` and ``since`` of ``right``.
    """
    spark, bin_of = left.sparkSession, _time_bins(left, at, bins)
    usable = F.col(key).isNotNull() & F.col(at).isNotNull()
    rows = left.where(usable).select(F.col(key).alias("as_key"), bin_of(F.col(at)).alias("as_bin"), F.col(at).alias("as_time"), F.struct(*left.columns).alias("as_row"))
    versions = (
        right.where(F.col(key).isNotNull() & F.col(since).isNotNull())
        .groupBy(F.col(key).alias("as_key"), F.col(since).alias("as_time"))
        .agg(F.max(F.struct(*values)).alias("as_value"))
        .withColumn("as_bin", bin_of(F.col("as_time")))
    )
    cells = materialize(rows.groupBy("as_key", "as_bin").agg(F.count(F.lit(1)).alias("n")))
    share = max(least, (cells.agg(F.sum("n")).head()[0] or 0) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hot = F.broadcast(cells.where(F.col("n") > share).select("as_key", "as_bin", F.ceil(F.col("n") / share).cast("int").alias("as_parts")))  # at most four for each partition
    parts = F.coalesce("as_parts", F.lit(1))
    # what holds at the start of a piece: at most ``bins`` rows for each key
    last = versions.groupBy("as_key", "as_bin").agg(F.max_by("as_value", "as_time").alias("as_value"))
    steps = cells.select("as_key", "as_bin").withColumn("as_value", F.lit(None).cast(last.schema["as_value"].dataType)).unionByName(last)
    before = Window.partitionBy("as_key").orderBy("as_bin").rangeBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("as_value", F.last("as_value", ignorenulls=True).over(before)).where("as_value is not null").distinct()
    known = carried.withColumn("as_time", F.lit(None).cast(versions.schema["as_time"].dataType)).unionByName(versions).join(cells.select("as_key", "as_bin"), ["as_key", "as_bin"], "left_semi")
    dealt = rows.join(hot, ["as_key", "as_bin"], "left").withColumn("as_part", F.pmod(F.xxhash64("as_row"), parts).cast("int"))
    copied = known.join(hot, ["as_key", "as_bin"], "left").withColumn("as_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    cols = ["as_key", "as_bin", "as_part", "as_time", "as_row", "as_value"]
    both = dealt.withColumn("as_value", F.lit(None).cast(last.schema["as_value"].dataType)).select(*cols).unionByName(
        copied.withColumn("as_row", F.lit(None).cast(dealt.schema["as_row"].dataType)).select(*cols)
    )
    order = Window.partitionBy("as_key", "as_bin", "as_part").orderBy(F.asc_nulls_first("as_time"), F.col("as_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("as_value", F.last("as_value", ignorenulls=True).over(order)).where("as_row is not null").select("as_row.*", *[F.col(f"as_value.{v}").alias(v) for v in values])
    without = left.where(~F.coalesce(usable, F.lit(False))).select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    return met.unionByName(without)


def overlapping_runs(runs: DataFrame, run_id: str, key: str, start: str, end: str) -> DataFrame:
    """``(key, earlier, later)``: the pairs of runs with the same key that have a moment in common, both ends included.

    ``earlier`` starts first, of runs that start together the one with the lesser id. ``start`` and ``end`` are whole numbers; runs with a
    null, or that end before they start, are in no pair. A pair is found where the later run's start lies in the
    earlier run: intervals are cut into the aligned pieces of lengths 1, 2, 4, ... that fill them, at most two of each length, and a start
    lies in one piece of each length. So the join is on equal pieces, a long interval gives a number of rows that grows with the logarithm
    of its length, and no pair comes up twice.
    """
    good = runs.select(F.col(key).alias("key"), F.col(run_id).alias("id"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("key is not null and id is not null and s <= e")
    ends = good.agg(F.min("s"), F.max("e"), F.max("s")).head()
    if ends[0] is None:
        return good.select("key", F.col("id").alias("earlier"), F.col("id").alias("later"))
    # a start is never beyond the last one, so what of an interval lies beyond it needs no pieces
    placed = good.select("key", "id", (F.col("s") - ends[0]).alias("s"), (F.least("e", F.lit(ends[2])) - ends[0]).alias("e"))
    levels = F.sequence(F.lit(0), F.lit(max(1, math.ceil(math.log2(ends[2] - ends[0] + 2)))))

    def pieces(k):
        size = F.expr("1L") * F.pow(F.lit(2.0), k).cast("long")
        first, stop = F.ceil(F.col("s") / size).cast("long"), F.floor((F.col("e") + 1) / size).cast("long")
        piece = lambda at: F.struct(k.alias("level"), at.alias("at"))
        open_ = first < stop
        return F.array_compact(F.array(F.when(open_ & (first % 2 == 1), piece(first)), F.when(open_ & (stop % 2 == 1), piece(stop - 1))))

    covers = placed.select("key", "id", "s", F.explode(F.flatten(F.transform(levels, pieces))).alias("p")).select("key", "p.level", "p.at", F.col("id").alias("earlier"), F.col("s").alias("first"))
    used = [r["level"] for r in covers.select("level").distinct().collect()]  # as many as the time has binary digits
    points = placed.select("key", "id", "s", F.explode(F.array(*[F.lit(k) for k in sorted(used)])).alias("level")).select(
        "key", "level", F.floor(F.col("s") / F.pow(F.lit(2.0), F.col("level"))).cast("long").alias("at"), F.col("id").alias("later"), F.col("s").alias("second")
    )
    return covers.join(points, ["key", "level", "at"]).where("first < second or (first = second and earlier < later)").select("key", "earlier", "later")


def run_sessions(runs: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """``(key, session_start, last_at, n)``: runs of a key that follow one another within ``gap``; two exactly a gap apart are together.

    Rows with a null key or time count for nothing. Equal times are counted before the shuffle. The same aggregation holds on streams.
    """
    counted = runs.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).alias("key"), F.col(at).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    sessions = counted.groupBy("key", F.session_window("at", gap).alias("w")).agg(F.sum("n").alias("n"), F.max("at").alias("last_at"))
    return sessions.select("key", F.col("w.start").alias("session_start"), "last_at", "n")


def graph_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(script_id, target, change, old_source, new_source, old_copies, new_copies)`` of two versions' edges ``(script_id, source, target)``.

    Edges are compared as they are, nulls equal to nulls, with their multiplicity. ``added`` and ``dropped`` edges are in one
    version only, ``recounted`` ones in both but not equally often. Where a target lost sources and gained others, these are paired
    in order of their names as ``moved``. Equal edges give no row.
    """
    side = lambda df, a, b: df.select("script_id", "source", "target", F.lit(a).alias("o"), F.lit(b).alias("n"))
    counted = side(old, 1, 0).unionByName(side(new, 0, 1)).groupBy("script_id", "source", "target").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    changed = materialize(counted.where("o <> n").withColumn("change", F.when(F.col("o") == 0, "added").when(F.col("n") == 0, "dropped").otherwise("recounted")))
    order = Window.partitionBy("script_id", "target", "change").orderBy(F.asc_nulls_first("source"))
    ranked = changed.withColumn("k", F.when(F.col("change") != "recounted", F.row_number().over(order)))
    # an added and a dropped edge of one target and place meet in one group
    place = F.when(F.col("change") == "recounted", F.struct(F.lit(1).alias("kind"), F.xxhash64("source").cast("long").alias("k"), F.col("source").alias("s"))).otherwise(
        F.struct(F.lit(0).alias("kind"), F.col("k").cast("long").alias("k"), F.lit(None).cast("string").alias("s"))
    )
    of = lambda change, c: F.max(F.when(F.col("change").isin(change, "recounted"), F.struct(F.col(c).alias("v"), "source")))
    met = ranked.groupBy("script_id", "target", place.alias("place")).agg(of("dropped", "o").alias("gone"), of("added", "n").alias("came"))
    change = F.when(F.col("place.kind") == 1, "recounted").when(F.col("gone").isNull(), "added").when(F.col("came").isNull(), "dropped").otherwise("moved")
    return met.select(
        "script_id", "target", change.alias("change"), F.col("gone.source").alias("old_source"), F.col("came.source").alias("new_source"),
        F.coalesce("gone.v", F.lit(0)).cast("long").alias("old_copies"), F.coalesce("came.v", F.lit(0)).cast("long").alias("new_copies"),
    )
