"""Mining of scripts as they arrive: row-wise operators on the stream itself, whole graphs batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineage_jobs.resolve import sql_lineage
from lineage_jobs.sqltext import sql_statement_kind, sql_statements, sql_targets

#: What of a graph is kept.
KEPT = ["tables", "table_edges", "column_edges", "warnings", "attempts"]


def stream_targets(scripts: DataFrame, sink: str, checkpoint: str):
    """A started query that appends the written tables of a stream of scripts to the Parquet folder ``sink``.

    Splitting, masking, folding and reading of targets look at one row at a time, so the batch functions run on the stream as they
    are. What is there is mined, then the query ends; started again with the same checkpoint it goes on where it was.
    """
    found = sql_targets(sql_statement_kind(sql_statements(scripts)))
    return found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_lineage(scripts: DataFrame, sink: str, checkpoint: str):
    """A started query that mines the graphs of each batch of scripts into folders of ``sink`` named after the batch.

    A script is one row, so a batch holds whole graphs and the union of the batches is the graph of all. A batch that is repeated after a
    failure overwrites its own folder, so nothing counts twice.
    """

    def mine(batch: DataFrame, number: int) -> None:
        graph = sql_lineage(batch)
        for name in KEPT:
            graph[name].write.mode("overwrite").parquet(f"{sink}/{name}/batch={number}")

    return scripts.writeStream.foreachBatch(mine).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_lineage(spark: SparkSession, sink: str, name: str) -> DataFrame:
    """A table of the graphs that :func:`stream_lineage` has mined."""
    return spark.read.parquet(f"{sink}/{name}").drop("batch")


def seen_in_windows(events: DataFrame, at: str, by: str, width: str, delay: str) -> DataFrame:
    """``(window_start, by, n)``: how often each value is seen in windows of event time; on a stream rows later than ``delay`` behind the latest
    are left out, and :func:`late_rows` counts them."""
    rows = events.where(F.col(at).isNotNull())
    rows = rows.withWatermark(at, delay) if rows.isStreaming else rows
    return rows.groupBy(F.window(at, width).alias("w"), F.col(by).alias("by")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "by", "n")


def stream_windows(events: DataFrame, sink: str, checkpoint: str, at: str, by: str, width: str, delay: str):
    """A started query that keeps the latest count of each window in the Parquet folders of ``sink``, one for each batch.

    Counts are updates: of a window and value the one of the last batch holds (:func:`read_windows`). A repeated batch overwrites its folder.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    counts = seen_in_windows(events, at, by, width, delay)
    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_windows(spark: SparkSession, sink: str) -> DataFrame:
    """The counts that hold after the last batch of :func:`stream_windows`."""
    return spark.read.parquet(sink).groupBy("window_start", "by").agg(F.max_by("n", "batch").alias("n"))


def late_rows(query) -> int:
    """Groups of rows (partial counts) that a finished query of windows dropped as too late, by its progress."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
