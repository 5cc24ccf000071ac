"""Append-only tables: commits in, metrics and predictions in and out.

Rows come in runs. A run is written to a folder of its own and then named in the table's list of finished runs; readers see
the rows of finished runs only. So a run that is repeated adds nothing, one that broke off leaves nothing to be seen, and doing it
again replaces what it left.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from srcpulse.schemas import COMMITS, DECAY_PREDICTIONS, FILE_METRICS
from srcpulse.session import materialize
from srcpulse.sources import folders

_DAY, _RUNS, _RAW = "ts_date", "_runs", "_raw"


def read_commits(spark: SparkSession, path: str, format: str = "parquet", below_root: bool = False, **options: str) -> DataFrame:
    """A commit log exported as Parquet, JSON or CSV, one row per file and commit.

    Paths start with the repository, as everywhere; with ``below_root`` the log has them below it, and they are completed.
    """
    commits = spark.read.schema(COMMITS).options(**options).format(format).load(path)
    return commits.withColumn("file_path", F.concat_ws("/", "repo", "file_path")) if below_root else commits


def checked_commits(spark: SparkSession, path: str, format: str = "csv", below_root: bool = False, **options: str) -> DataFrame:
    """Every line of a CSV or JSON export: the columns of a commit, ``reason`` why it is none (null for a good line), ``raw`` text.

    A line that is not of the format is ``malformed`` and has only its text; one without a path or time, or with a time that is
    none, keeps what it has. Nothing is dropped and no line fails a job.
    """
    if format not in ("csv", "json"):
        raise ValueError("text exports are csv or json")
    text = StructType([StructField(f.name, StringType()) for f in COMMITS])
    read = spark.read.schema(StructType([*text.fields, StructField(_RAW, StringType())]))
    # A reader that parses only the columns in use would not see that a line has too few.
    settings = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW, "columnPruning": "false", **options}
    lines = read.options(**settings).format(format).load(path)
    ts = F.col("ts").try_cast("timestamp")
    reason = (
        F.when(F.col(_RAW).isNotNull(), "malformed")
        .when(F.coalesce(F.trim("file_path"), F.lit("")) == "", "no_path")
        .when(F.coalesce(F.trim("ts"), F.lit("")) == "", "no_time")
        .when(ts.isNull(), "bad_time")
    )
    path_col = F.concat_ws("/", "repo", "file_path") if below_root else F.col("file_path")
    good = reason.isNull()
    columns = {"file_path": F.when(good, path_col).otherwise(F.col("file_path")), "ts": ts}
    fields = [F.when(F.col(_RAW).isNull(), columns.get(f.name, F.col(f.name))).cast(f.dataType).alias(f.name) for f in COMMITS]
    return lines.select(*fields, reason.alias("reason"), F.col(_RAW).alias("raw"))


def good_commits(checked: DataFrame) -> DataFrame:
    return checked.where("reason IS NULL").drop("reason", "raw")


def reject_counts(checked: DataFrame) -> DataFrame:
    """``reason, lines`` of a checked export; good lines are ``accepted``."""
    return checked.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("lines"))


def _conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema`` in its order; absent ones are null, an absent or null ``ts`` is now (UTC)."""
    have = set(df.columns)
    out = []
    for field in schema:
        col = F.col(field.name) if field.name in have else F.lit(None)
        col = col.cast(field.dataType)
        if field.name == "ts":
            col = F.coalesce(col, F.current_timestamp())
        out.append(col.alias(field.name))
    return df.select(*out)


def _run_name(run_id: str | None) -> str:
    run_id = run_id or uuid.uuid4().hex
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run_id):
        raise ValueError(f"a run is named by letters, digits, dots and dashes: {run_id!r}")
    return run_id


def finished_runs(spark: SparkSession, path: str) -> list[str]:
    return [n for n in folders.names(spark, f"{path}/{_RUNS}") if not n.startswith(".") and not n.endswith(".draft")]


def stage(df: DataFrame, path: str, run_id: str) -> None:
    """Write the rows of a run by day, in place of what an earlier try has left; nobody sees them yet.

    The rebalance hint gathers small days into few files and splits large ones.
    """
    dated = df.withColumn(_DAY, F.to_date("ts")).hint("rebalance", _DAY)
    dated.write.mode("overwrite").partitionBy(_DAY).parquet(f"{path}/run={run_id}")


def finish(spark: SparkSession, path: str, run_id: str) -> None:
    folders.write_text(spark, f"{path}/{_RUNS}/{run_id}", "")


def _append(df: DataFrame, path: str, run_id: str | None) -> bool:
    run_id = _run_name(run_id)
    if run_id in finished_runs(df.sparkSession, path):
        return False
    stage(df, path, run_id)
    finish(df.sparkSession, path, run_id)
    return True


def _metrics(df: DataFrame) -> DataFrame:
    return _conform(df.withColumnRenamed("metadata", "extra_data") if "metadata" in df.columns else df, FILE_METRICS)


def append_metrics(df: DataFrame, path: str, run_id: str | None = None) -> bool:
    """Append one run; False where that run is in the table already."""
    return _append(_metrics(df), path, run_id)


def append_predictions(df: DataFrame, path: str, run_id: str | None = None) -> bool:
    return _append(_conform(df, DECAY_PREDICTIONS), path, run_id)


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    finished = finished_runs(spark, path)
    stored = spark.read.schema(StructType([*schema.fields, StructField("run", StringType()), StructField(_DAY, DateType())])).parquet(path)
    return stored.where(F.col("run").isin(finished) if finished else F.lit(False)).drop("run")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, FILE_METRICS)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, DECAY_PREDICTIONS)


def persist_completed(analysed: DataFrame, metrics_path: str, predictions_path: str, run_id: str | None = None) -> DataFrame:
    """Append the completed rows to both tables, as one run; gives back the whole result.

    The result is written once to the shared folder and both appends read it from there, so the analysis runs once and the
    loss of an executor costs no second run. Both tables have their rows before either names the run: where one names it
    already, a try that broke off in between has left only names to be written.
    """
    spark, run_id = analysed.sparkSession, _run_name(run_id)
    left = [p for p in (metrics_path, predictions_path) if run_id not in finished_runs(spark, p)]
    if len(left) == 2:
        analysed = materialize(analysed, "analysis")
        done = analysed.filter("status = 'completed'")
        stage(_metrics(done), metrics_path, run_id)
        stage(_conform(done, DECAY_PREDICTIONS), predictions_path, run_id)
    for path in left:
        finish(spark, path, run_id)
    return analysed
