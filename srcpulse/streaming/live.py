"""Structured Streaming forms of churn, progress, latest predictions and the style gate.

Each gives on a closed input what its batch operator gives. Sinks and checkpoints live in folders the
caller names; queries that only drain what is there use ``available_now``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from srcpulse.functions import style
from srcpulse.operators.history import latest_predictions
from srcpulse.operators.style import severity_columns, style_check, with_verdict
from srcpulse.sources import keyed
from srcpulse.sources.adapters import spread


def windowed_churn(commits: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Commits and distinct authors per file and window.

    Distinct counts are not offered on streams, so commits are first counted per (window, file, author)
    and those groups are counted again: exact, and a hot file's state is spread over its authors.
    """
    stamped = commits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    by_author = stamped.groupBy(frame, "file_path", "author").agg(F.count(F.lit(1)).alias("n"))
    return by_author.groupBy("window", "file_path").agg(
        F.sum("n").alias("change_frequency"), F.count("author").alias("authors_count")
    ).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "file_path",
        "change_frequency", "authors_count",
    )


def progress_counts(events: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Progress events per step and tumbling window; none is dropped."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return stamped.groupBy(F.window("ts", window), "step").agg(F.count(F.lit(1)).alias("events")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "step", "events"
    )


def closed(rows: DataFrame, path: str, ts: str = "ts") -> DataFrame:
    """A stream with a known end: one row far ahead of all others, so that every window of the others ends.

    That row is written to ``path``, has nulls beside its time, and its own window never ends, so it is in no result.
    """
    spark = rows.sparkSession
    last = [F.lit("2200-01-01").cast(f.dataType).alias(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
    spark.range(1).select(*last).write.mode("overwrite").parquet(path)
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(path))


def _write_batch(path: str, shape: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A batch writer that replaces its own folder, so a repeated batch after a failure changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def start_latest(predictions: DataFrame, path: str, checkpoint: str, available_now: bool = False, buckets: int = keyed.BUCKETS) -> StreamingQuery:
    """Keep the newest rows of each file in a keyed table: a batch rewrites only the buckets of its files."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        keyed.merge(batch, path, "file_path", latest_predictions, checkpoint, batch_id, buckets)

    writer = predictions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest rows over all batches so far."""
    return keyed.read(spark, path)


def start_style_gate(
    files: DataFrame, path: str, checkpoint: str, rules=style.DEFAULT_RULES, available_now: bool = False
) -> StreamingQuery:
    """Check arriving files; every batch adds its counts as one folder. A batch of fewer splits than cores goes to all cores."""

    def counts(batch: DataFrame) -> DataFrame:
        checked = style_check(spread(batch), rules).select(F.size("issues").cast("bigint").alias("issue_count"), *severity_columns())
        return checked.agg(
            F.count(F.lit(1)).alias("files_checked"),
            F.count_if(F.col("issue_count") > 0).alias("files_with_issues"),
            F.coalesce(F.sum("issue_count"), F.lit(0)).alias("total_issues"),
            *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in style.SEVERITIES],
        )

    writer = files.writeStream.foreachBatch(_write_batch(path, counts)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_gate(spark: SparkSession, path: str) -> DataFrame:
    """The gate over all files that have arrived so far."""
    counts = ("files_checked", "files_with_issues", "total_issues", *style.SEVERITIES)
    sums = spark.read.parquet(path).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    return with_verdict(sums)


def start_table(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append finished windows to a Parquet table."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
