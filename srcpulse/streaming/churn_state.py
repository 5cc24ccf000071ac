"""Change statistics of sliding windows as a stream, with state.

Native windows give counts, but a mean gap needs the commits of a file in order, over all days of the window. So commits are
first reduced natively to one row per (file, day) with its distinct authors, and a stateful step keeps
per file the days of the window: count, first and last time, distinct authors. When the watermark passes the end of a window,
the statistics of that window are what the batch operator gives at that time.

A window is closed at both ends. So a day runs from just after midnight up to the next midnight, and the commits of that
midnight itself are kept apart: a window takes them at its start without the day before.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from srcpulse.functions.numbers import round_half_even
from srcpulse.operators.churn import DAY_MICROS, with_churn_risk

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY_MILLIS = DAY_MICROS // 1000
#: The days of a file are one text (JSON): a value of many nested fields costs far more to read and write.
_PARTS = "done long, parts string"
_OUT = (
    "file_path string, window_end timestamp, change_frequency long, authors_count long, gap_days long, "
    "last_modified timestamp, latest_change timestamp"
)


def by_day(commits: DataFrame, delay: str) -> DataFrame:
    """part, n, first and last time in microseconds, authors, per file and finished day. Part 2d holds the commits of the day that
    ends at midnight d, without that midnight's, which are part 2d + 1."""
    ts = F.col("ts").cast("timestamp")
    shifted = commits.select(
        "file_path", "author", F.unix_micros(ts).alias("at"), (ts - F.expr("INTERVAL 1 MICROSECOND")).alias("just_before")
    ).withWatermark("just_before", delay)
    day = F.window("just_before", "1 day")
    at_end = (F.col("at") % DAY_MICROS == 0).alias("at_end")
    # Tasks combine their commits of a day before the shuffle; the state of a day is one row with its distinct authors.
    days = shifted.groupBy(day.alias("window"), at_end, "file_path").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.array_sort(F.collect_set("author")).alias("authors")
    )
    number = F.floor(F.unix_micros("window.end") / DAY_MICROS) * 2 + F.col("at_end").cast("long")
    return days.select("file_path", number.alias("part"), "n", "first", "last", "authors", F.window_time("window").alias("seen_at"))


class SlidingWindows(StatefulProcessor):
    """Emits a row per file and window that holds a commit, once the watermark has passed the window's end."""

    def __init__(self, days_back: int, slide_days: int) -> None:
        self._back, self._slide = days_back, slide_days

    def init(self, handle) -> None:
        self._handle = handle
        self._kept = handle.getValueState("days", _PARTS)

    def _load(self) -> tuple[int, dict[int, tuple]]:
        if not self._kept.exists():
            return -(2**40), {}
        done, parts = self._kept.get()
        return done, {p[0]: tuple(p[1:]) for p in json.loads(parts)}

    def _save(self, done: int, parts: dict[int, tuple]) -> None:
        self._kept.update((done, json.dumps([(part, *values) for part, values in sorted(parts.items())])))

    def _next_end(self, done: int, oldest: int) -> int:
        """The first window end (in days) that is still to come and holds the oldest kept part."""
        return max(-(-(oldest // 2) // self._slide) * self._slide, done + self._slide)

    def _wake(self, end: int) -> None:
        for timer in self._handle.listTimers():
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(end * DAY_MILLIS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, parts = self._load()
        for days in rows:  # whole columns: a row each would cost more than all that is done with it
            numbers, *values = (days[c].tolist() for c in ("part", "n", "first", "last", "authors"))
            parts.update((part, (n, first, last, list(authors))) for part, n, first, last, authors in zip(numbers, *values, strict=True))  # a finished day comes once
        self._save(done, parts)
        self._wake(self._next_end(done, min(parts)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done, parts = self._load()
        passed = timerValues.getCurrentWatermarkInMs() // DAY_MILLIS
        out = []
        # In order of time; a window is the slice from its first day up to its end, and both only move on.
        numbers, values = sorted(parts), [parts[p] for p in sorted(parts)]
        first = stop = 0
        while first < len(numbers) and (end := self._next_end(done, numbers[first])) <= passed:
            while first < len(numbers) and numbers[first] < 2 * (end - self._back) + 1:
                first += 1
            stop = max(stop, first)
            while stop < len(numbers) and numbers[stop] <= 2 * end + 1:
                stop += 1
            if first < stop:
                out.append(self._row(key[0], end, values[first:stop]))
            done = end
            while first < len(numbers) and numbers[first] < 2 * (end + self._slide - self._back) + 1:
                first += 1
        parts = dict(zip(numbers[first:], values[first:], strict=True))
        if parts:
            self._save(done, parts)
            self._wake(self._next_end(done, min(parts)))
        else:
            self._kept.clear()
        if not out:
            return iter(())
        found = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
        return iter((found.assign(**{c: pd.to_datetime(found[c], unit="us") for c in ("window_end", "last_modified", "latest_change")}),))

    @staticmethod
    def _row(file_path: str, end: int, days: list[tuple]) -> tuple:
        """One window, with times in microseconds."""
        gaps = sum((b[1] - a[2]) // DAY_MICROS for a, b in zip(days, days[1:], strict=False))
        authors = {a for d in days for a in d[3]}
        return file_path, end * DAY_MICROS, sum(d[0] for d in days), len(authors), gaps, days[0][1], days[-1][2]


def sliding_churn(commits: DataFrame, days_back: int = 90, slide_days: int = 30, delay: str = "1 day") -> DataFrame:
    """window_end, statistics, churn risk and hotspot flag per file and window of ``days_back`` days, for a window end every
    ``slide_days`` days from 1970-01-01 on. Windows without a commit of a file have no row of it. Commits that come later than
    ``delay`` behind the newest are left out, as in any stream.

    State needs Spark's RocksDB store: start the query under ``keyed_state``.
    """
    if days_back < 1 or slide_days < 1:
        raise ValueError("days_back and slide_days must be positive")
    found = by_day(commits, delay).groupBy("file_path").transformWithStateInPandas(
        SlidingWindows(days_back, slide_days), _OUT, outputMode="Append", timeMode="eventTime"
    )
    n = F.col("change_frequency")
    mean = F.when(n > 1, round_half_even(F.col("gap_days").cast("double") / (n - 1))).otherwise(F.lit(float(days_back)))
    stats = found.select("file_path", "window_end", n, "authors_count", mean.alias("avg_days_between_changes"), "last_modified", "latest_change")
    return with_churn_risk(stats)


class keyed_state:  # noqa: N801
    """``with keyed_state(spark):`` queries started within keep their state in RocksDB; the session is as it was afterwards."""

    NAME = "spark.sql.streaming.stateStore.providerClass"
    STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark) -> None:
        self._conf = spark.conf

    def __enter__(self) -> None:
        self._before = self._conf.get(self.NAME, None)
        self._conf.set(self.NAME, self.STORE)

    def __exit__(self, *error) -> None:
        if self._before is None:
            self._conf.unset(self.NAME)
        else:
            self._conf.set(self.NAME, self._before)
