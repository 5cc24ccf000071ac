from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from srcpulse.operators import churn, history as hist

START = datetime(2024, 1, 1)
AS_OF = datetime(2024, 3, 1)


def _history(spark, series):
    """Values newest first per file."""
    rows = [
        (name, START + timedelta(days=100 - i), None if v is None else float(v)) for name, vs in series.items() for i, v in enumerate(vs)
    ]
    return spark.createDataFrame(rows, "file_path string, ts timestamp, cc double")


SERIES = {
    "one": [10], "flat": [10, 10], "up": [10, 12], "down": [12, 10], "ten": [10, 11], "zero": [0, 5], "odd": [10, 20, 20],
    "nulls": [None, 10, None], "long": list(range(1, 30)),
}
REFERENCE = {
    "one": "insufficient_data", "flat": "stable", "up": "increasing", "down": "decreasing", "ten": "stable", "zero": "stable",
    "odd": "increasing", "nulls": "insufficient_data", "long": "increasing",
}


def test_trend_reference_order(spark):
    got = hist.metric_trend(_history(spark, SERIES), ["cc"], order="reference")
    assert {r.file_path: r.cc_trend for r in got.collect()} == REFERENCE


def test_trend_chronological_is_the_mirror(spark):
    newest_ten = {k: v[:10] for k, v in SERIES.items()}
    mirrored = {k: v[::-1] for k, v in newest_ten.items()}
    a = hist.metric_trend(_history(spark, SERIES), ["cc"], order="chronological")
    b = hist.metric_trend(_history(spark, mirrored), ["cc"], order="reference")
    assert {r.file_path: r.cc_trend for r in a.collect()} == {r.file_path: r.cc_trend for r in b.collect()}
    with pytest.raises(ValueError):
        hist.metric_trend(_history(spark, SERIES), ["cc"], order="newest")


def test_newest_row_as_current(spark):
    got = hist.metric_trend(_history(spark, {"a": [99, 10, 12], "b": [5], "c": [None, 1, 1]}), ["cc"], order="reference", newest_is_current=True)
    rows = {r.file_path: (r.cc, r.cc_trend) for r in got.collect()}
    assert rows == {"a": (99.0, "increasing"), "b": (5.0, "insufficient_data"), "c": (None, "stable")}


def test_current_without_history(spark):
    current = spark.createDataFrame([("a", 3.0), ("x", 4.0)], "file_path string, now double")
    trends = hist.metric_trend(_history(spark, {"a": [10, 12]}), ["cc"], order="reference")
    got = {r.file_path: r.cc_trend for r in hist.current_with_history(current, trends).collect()}
    assert got == {"a": "increasing", "x": "insufficient_data"}


def _predictions(spark, rows):
    rows = [(p, START + timedelta(days=d), float(s), lv) for p, d, s, lv in rows]
    return spark.createDataFrame(rows, "file_path string, ts timestamp, decay_score double, risk_level string")


def test_latest_keeps_ties_and_filters_after(spark):
    df = _predictions(spark, [("a", 1, 10, "low"), ("a", 2, 90, "critical"), ("a", 2, 80, "critical"), ("b", 1, 70, "high")])
    assert [(r.file_path, r.decay_score) for r in hist.high_risk_list(df).collect()] == [("a", 90.0), ("a", 80.0), ("b", 70.0)]
    df = _predictions(spark, [("a", 1, 99, "critical"), ("a", 2, 60, "high"), ("a", 2, 80, "critical"), ("b", 1, 70, "high")])
    assert [(r.file_path, r.decay_score) for r in hist.high_risk_list(df).collect()] == [("a", 80.0), ("b", 70.0)]
    report = hist.high_risk_report(df).first()
    assert (report.threshold, report["count"]) == (70.0, 2)
    one = hist.latest_one(df, [F.desc("decay_score")]).collect()
    assert sorted((r.file_path, r.decay_score) for r in one) == [("a", 80.0), ("b", 70.0)]


def test_summaries(spark):
    df = _predictions(spark, [("a", 1, 85, "critical"), ("b", 1, 65, "high"), ("c", 1, 45, "medium"), ("d", 1, 5, "low")])
    ref = hist.summary_reference(df).first()
    assert (ref.total_files_analyzed, ref.critical_count, ref.high_count, ref.medium_count, ref.average_decay_score) == (2, 1, 1, 0, 75.0)
    full = hist.risk_summary(df).first()
    assert (full.total_files_analyzed, full.medium_count, full.low_count, full.average_decay_score) == (4, 1, 1, 50.0)
    assert hist.summary_reference(df.limit(0)).first().average_decay_score == 0.0


def test_status(spark):
    df = _predictions(spark, [("a", 1, 85, "critical")])
    req = spark.createDataFrame([("a",), ("a",), ("z",)], "file_path string")
    got = {r.file_path: r.status for r in hist.prediction_status(req, df, [F.desc("decay_score")]).collect()}
    assert got == {"a": "analyzed", "z": "not_analyzed"}


def test_latest_is_cut_before_the_shuffle(spark):
    df = _predictions(spark, [("a", 1, 85, "critical")])
    plan = hist.latest_predictions(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("WindowGroupLimit") > plan.index("Exchange") > plan.index("WindowGroupLimit")


# --- churn ---------------------------------------------------------------------------------------
def _commits(spark, rows):
    return spark.createDataFrame(rows, "file_path string, author string, ts timestamp")


def test_change_stats(spark):
    d = datetime
    rows = [
        ("one", "x", d(2024, 1, 5)),
        ("night", "x", d(2024, 1, 1, 23)), ("night", "y", d(2024, 1, 2, 1)),
        ("three", "x", d(2024, 1, 1)), ("three", "x", d(2024, 1, 4)), ("three", "y", d(2024, 1, 10)),
        ("old", "x", d(2020, 1, 1)), ("future", "x", d(2025, 1, 1)),
        ("same", "x", d(2024, 1, 7)), ("same", "x", d(2024, 1, 7)),
    ]
    stats = churn.change_stats(_commits(spark, rows), AS_OF, 90)
    files = spark.createDataFrame([(n,) for n in ("one", "night", "three", "old", "same")], "file_path string")
    got = {r.file_path: r for r in churn.with_missing_files(stats, files).collect()}

    def row(name):
        r = got[name]
        return (r.change_frequency, r.authors_count, r.avg_days_between_changes, r.last_modified)

    assert row("one") == (1, 1, 90.0, d(2024, 1, 5))
    assert row("night") == (2, 2, 0.0, d(2024, 1, 1, 23))
    assert row("three") == (3, 2, 4.5, d(2024, 1, 1)) and got["three"].latest_change == d(2024, 1, 10)
    assert row("old") == (0, 0, 90.0, None)
    assert row("same") == (2, 1, 0.0, d(2024, 1, 7))
    risk = {r.file_path: r.churn_risk_score for r in churn.with_churn_risk(stats).collect()}
    assert risk["night"] == 15.0 and risk["three"] == 25.0


def test_gaps_by_day_equal_gaps_by_commit(spark):
    """One file holds most commits; day buckets give what neighbouring commits give one by one."""
    import random

    rnd = random.Random(5)
    rows = [("hot" if i % 3 else f"f{i % 7}", f"a{rnd.randrange(9)}", START + timedelta(seconds=rnd.randrange(55 * 86400))) for i in range(900)]
    got = {r.file_path: r for r in churn.change_stats(_commits(spark, rows), AS_OF, 90).collect()}
    for name in {r[0] for r in rows}:
        times = sorted(t for p, _, t in rows if p == name)
        gaps = [(b - a).days for a, b in zip(times, times[1:])]
        assert got[name].change_frequency == len(times)
        assert got[name].avg_days_between_changes == (round(sum(gaps) / len(gaps), 2) if gaps else 90.0)
        assert got[name].authors_count == len({a for p, a, _ in rows if p == name})


def test_window_bounds_reach_the_scan(spark, sf):
    from srcpulse.sources import adapters as A

    df = A.view(A.table(spark, sf, "lineitem"), A.COMMITS_PART)
    plan = churn.change_stats(df, datetime(2001, 11, 4), 90)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan


def test_recent_paths(spark):
    rows = [("a", "x", datetime(2024, 2, 20)), ("a", "x", datetime(2024, 2, 21)), ("b", "x", datetime(2024, 1, 1))]
    assert [r.file_path for r in churn.recent_changed_paths(_commits(spark, rows), AS_OF).collect()] == ["a"]
