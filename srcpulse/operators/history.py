"""Questions to the stored measurements and predictions.

Filters ``rank <= n`` over a window let Spark cut each task's rows to n per file before the shuffle, so a
file with very many rows brings only a few of them across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from srcpulse.functions import scoring
from srcpulse.functions.numbers import bind, round_half_even


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """Newest row of each file; rows that share the newest time are all kept."""
    newest = Window.partitionBy("file_path").orderBy(F.desc("ts"))
    return predictions.withColumn("_r", F.rank().over(newest)).filter("_r = 1").drop("_r")


def latest_one(predictions: DataFrame, tie_break: Sequence[Column]) -> DataFrame:
    """Exactly one newest row of each file."""
    newest = Window.partitionBy("file_path").orderBy(F.desc("ts"), *tie_break)
    return predictions.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def last_n(metrics: DataFrame, n: int = 100, tie_break: Sequence[Column] = ()) -> DataFrame:
    """Newest ``n`` rows of each file; ``recency`` is 1 for the newest."""
    newest = Window.partitionBy("file_path").orderBy(F.desc("ts"), *tie_break)
    return metrics.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= n)


def metrics_view(history: DataFrame) -> DataFrame:
    return history.select(
        "file_path", "ts", "cyclomatic_complexity", "lines_of_code", "maintainability_index", "change_frequency"
    )


def half_trend(values: Column, rows: Column, percent: float = 10.0) -> Column:
    """Compare the mean of the first half of ``values`` with the rest; an odd middle value goes to the rest."""
    def mean(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v) / F.size(part)

    def change(series: Column) -> Column:
        size = F.size(series)
        half = F.floor(size / 2).cast("int")
        first, rest = mean(F.slice(series, F.lit(1), half)), mean(F.slice(series, half + 1, size - half))
        relative = bind(first, lambda base: (rest - base) / F.nullif(base, F.lit(0.0)) * 100.0)
        return F.when(size >= 2, relative)

    def named(pair: Column) -> Column:
        return (
            F.when((rows < 2) | (pair["size"] < 2), F.lit("insufficient_data"))
            .when(pair["change"] > percent, F.lit("increasing"))
            .when(pair["change"] < -percent, F.lit("decreasing"))
            .otherwise(F.lit("stable"))
        )

    measured = bind(values, lambda v: F.struct(F.size(v).alias("size"), change(v).alias("change")))
    return bind(measured, named)


def metric_trend(
    metrics: DataFrame, names: Sequence[str], *, order: str, n: int = 10, percent: float = 10.0,
    tie_break: Sequence[Column] = (), newest_is_current: bool = False,
) -> DataFrame:
    """Trend of each named metric over the newest ``n`` rows of each file, as ``<name>_trend``.

    ``order="reference"`` puts the newest value first, so a metric that rose over time is called
    ``decreasing``. ``order="chronological"`` puts the oldest first. Nulls are dropped after the cut to ``n``.
    With ``newest_is_current`` the newest row of a file is its measurement of now: it comes back under the
    metric's own name, and the trend is over the ``n`` rows before it. One window serves both.
    """
    if order not in ("reference", "chronological"):
        raise ValueError("order is 'reference' or 'chronological'")
    first = 2 if newest_is_current else 1
    recent = last_n(metrics, n + first - 1, tie_break)
    past = F.col("recency") >= first

    def series(name: str) -> Column:
        entry = F.when(past & F.col(name).isNotNull(), F.struct("recency", F.col(name).cast("double").alias("v")))
        return F.sort_array(F.collect_list(entry), asc=(order == "reference"))  # at most n entries

    now = [F.max(F.when(~past, F.col(m))).alias(f"_now_{m}") for m in names] if newest_is_current else []
    grouped = recent.groupBy("file_path").agg(
        F.count_if(past).alias("_rows"), *now, *[series(m).alias(f"_past_{m}") for m in names]
    )
    return grouped.select(
        "file_path",
        *[F.col(f"_now_{m}").alias(m) for m in names if newest_is_current],
        *[
            half_trend(F.transform(F.col(f"_past_{m}"), lambda e: e["v"]), F.col("_rows"), percent).alias(f"{m}_trend")
            for m in names
        ],
    )


def current_with_history(current: DataFrame, trends: DataFrame) -> DataFrame:
    """Current metrics with the trends of their stored rows; a file without history has too little data."""
    names = [c for c in trends.columns if c != "file_path"]
    return current.join(trends, "file_path", "left").select(
        *current.columns, *[F.coalesce(c, F.lit("insufficient_data")).alias(c) for c in names]
    )


def high_risk(predictions: DataFrame, threshold: float = 70.0) -> DataFrame:
    """Latest rows at or above the threshold. The threshold applies after the latest row is chosen."""
    return latest_predictions(predictions).filter(F.col("decay_score") >= threshold)


def high_risk_list(predictions: DataFrame, threshold: float = 70.0) -> DataFrame:
    return high_risk(predictions, threshold).orderBy(F.desc("decay_score"), "file_path")


def high_risk_report(predictions: DataFrame, threshold: float = 70.0) -> DataFrame:
    """One row: the threshold and how many latest rows reach it. The rows themselves: ``high_risk_list``."""
    return high_risk(predictions, threshold).agg(F.count(F.lit(1)).alias("count")).select(
        F.lit(float(threshold)).alias("threshold"), "count"
    )


def high_risk_with_count(predictions: DataFrame, threshold: float = 70.0) -> DataFrame:
    """The rows of ``high_risk_list``, each with the threshold and the number of all of them."""
    rows = high_risk(predictions, threshold)
    count = rows.agg(F.count(F.lit(1))).scalar()
    return rows.select("*", F.lit(float(threshold)).alias("threshold"), count.alias("count"))


def dashboard_cards(predictions: DataFrame, threshold: float = 60.0, keep: int = 2) -> DataFrame:
    """High-risk files as a dashboard shows them: level in capitals and the first ``keep`` recommendations."""
    return high_risk_list(predictions, threshold).select(
        "file_path", "decay_score", F.upper("risk_level").alias("risk"),
        F.slice(F.coalesce("recommendations", F.array().cast("array<string>")), 1, keep).alias("recommendations"),
    )


def _level_counts(levels: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col("risk_level") == level).alias(f"{level}_count") for level in levels]


def _mean_score() -> Column:
    total = F.sum(F.col("decay_score").cast("decimal(20,10)"))  # exact, whatever the order of the tasks
    mean = F.try_divide(total.cast("double"), F.count(F.lit(1)))
    return F.coalesce(round_half_even(mean), F.lit(0.0)).alias("average_decay_score")


def summary_reference(latest: DataFrame, threshold: float = 60.0) -> DataFrame:
    """Summary over the latest rows at or above the threshold, which are counted as all analysed files."""
    return latest.filter(F.col("decay_score") >= threshold).agg(
        F.count(F.lit(1)).alias("total_files_analyzed"), *_level_counts(("critical", "high", "medium")), _mean_score()
    )


def risk_summary(latest: DataFrame) -> DataFrame:
    """Summary over all latest rows."""
    return latest.agg(
        F.count(F.lit(1)).alias("total_files_analyzed"),
        *_level_counts(("critical", "high", "medium", "low")),
        _mean_score(),
    )


def prediction_status(requests: DataFrame, predictions: DataFrame, tie_break: Sequence[Column]) -> DataFrame:
    """Each requested path with its latest prediction, or ``not_analyzed``."""
    asked = requests.select("file_path").distinct()
    known = latest_one(predictions.join(asked, "file_path", "left_semi"), tie_break)
    return asked.join(known.select("file_path", "ts", "decay_score", "risk_level"), "file_path", "left").select(
        "file_path",
        F.when(F.col("ts").isNull(), F.lit("not_analyzed")).otherwise(F.lit("analyzed")).alias("status"),
        "decay_score", "risk_level", "ts",
    )


def top_n_risky(scored: DataFrame, n: int | None = 15, by: str = "repo") -> DataFrame:
    """The ``n`` highest scores among high and critical files of each repository, or all of them, with their rank."""
    order = Window.partitionBy(by).orderBy(F.desc(F.coalesce("decay_score", F.lit(0.0))), "file_path")
    return (
        scored.filter(scoring.is_reportable(F.col("risk_level")))
        .withColumn("risk_rank", F.row_number().over(order))
        .filter(F.lit(True) if n is None else F.col("risk_rank") <= n)
    )
