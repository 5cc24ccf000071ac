"""Change statistics from a commit log."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from srcpulse.functions import scoring
from srcpulse.functions.numbers import round_half_even

DAY_MICROS = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def in_window(commits: DataFrame, as_of: datetime, days_back: int) -> DataFrame:
    """Rows of the closed window. Both bounds are literals of the column's own type, so they reach the scan."""
    kind = commits.schema["ts"].dataType
    start = F.lit(str(as_of - timedelta(days=days_back))).cast(kind)
    return commits.filter((F.col("ts") >= start) & (F.col("ts") <= F.lit(str(as_of)).cast(kind)))


def commit_gaps(commits: DataFrame) -> DataFrame:
    """Whole elapsed days between consecutive commits of a file, one row per file and active day.

    Two commits inside one 24-hour bucket are less than a day apart, so their gap is 0: the count, first
    and last time per (file, day) carry all that the gaps need. This aggregate combines before the
    shuffle, and the window below sees at most one row per day of the window, however hot the file is.
    """
    per_day = commits.groupBy("file_path", F.floor(micros(F.col("ts")) / DAY_MICROS).alias("day")).agg(
        F.count(F.lit(1)).alias("commits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    by_day = Window.partitionBy("file_path").orderBy("day")
    elapsed = micros(F.col("first_ts")) - micros(F.lag("last_ts").over(by_day))
    return per_day.withColumn("gap_days", F.floor(elapsed / DAY_MICROS))


def change_stats(commits: DataFrame, as_of: datetime, days_back: int = 90) -> DataFrame:
    """Per file: commits, distinct authors, mean gap in days (``days_back`` for one commit), oldest and newest change.

    One pass over the commits. They are counted per (file, author, day), which combines before the shuffle and spreads
    a hot file over its authors and days; the first day of an author carries the author's count, so that days and then
    files only add up numbers.
    """
    recent = in_window(commits, as_of, days_back)
    per_author = recent.groupBy("file_path", "author", F.floor(micros(F.col("ts")) / DAY_MICROS).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    by_author = Window.partitionBy("file_path", "author").orderBy("day")
    is_new = F.col("author").isNotNull() & (F.row_number().over(by_author) == 1)
    per_day = per_author.withColumn("new", is_new.cast("int")).groupBy("file_path", "day").agg(
        F.sum("n").alias("commits"), F.sum("new").alias("authors"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )
    by_day = Window.partitionBy("file_path").orderBy("day")
    elapsed = micros(F.col("first_ts")) - micros(F.lag("last_ts").over(by_day))
    n = F.col("change_frequency")
    mean = F.when(n > 1, round_half_even(F.col("gap_days").cast("double") / (n - 1))).otherwise(F.lit(float(days_back)))
    return (
        per_day.withColumn("gap_days", F.floor(elapsed / DAY_MICROS))
        .groupBy("file_path")
        .agg(
            F.sum("commits").alias("change_frequency"), F.sum("authors").alias("authors_count"),
            F.coalesce(F.sum("gap_days"), F.lit(0)).alias("gap_days"), F.min("first_ts").alias("last_modified"),
            F.max("last_ts").alias("latest_change"),
        )
        .select("file_path", "change_frequency", "authors_count", mean.alias("avg_days_between_changes"), "last_modified", "latest_change")
    )


def with_missing_files(stats: DataFrame, files: DataFrame, days_back: int = 90) -> DataFrame:
    """One row per file: a file without commits has 0 commits, 0 authors and a mean gap of ``days_back``."""
    return files.select("file_path").join(stats, "file_path", "left").select(
        "file_path",
        F.coalesce("change_frequency", F.lit(0)).alias("change_frequency"),
        F.coalesce("authors_count", F.lit(0)).alias("authors_count"),
        F.coalesce("avg_days_between_changes", F.lit(float(days_back))).alias("avg_days_between_changes"),
        "last_modified",
        "latest_change",
    )


def with_churn_risk(stats: DataFrame, cfg: scoring.ScoreConfig = scoring.DEFAULT) -> DataFrame:
    n, a, gap = F.col("change_frequency"), F.col("authors_count"), F.col("avg_days_between_changes")
    return stats.select(
        "*",
        scoring.churn_risk(n, a, gap, cfg).alias("churn_risk_score"),
        scoring.is_hotspot(n, cfg).alias("is_hotspot"),
        scoring.churn_warnings(n, a, cfg).alias("churn_warnings"),
    )


def recent_changed_paths(commits: DataFrame, as_of: datetime, days_back: int = 30) -> DataFrame:
    return in_window(commits, as_of, days_back).select("file_path").distinct()
