"""Sliding windows with state, batch by batch, against the batch operator at each window end."""

from datetime import datetime, timedelta
import random

import pytest

from srcpulse.operators import churn
from srcpulse.streaming import churn_state, live

START = datetime(2024, 1, 1)
BACK, SLIDE = 12, 5


@pytest.fixture(scope="module")
def commits():
    """Commits in the order in which they arrive: up to three days late, some at midnight, a hot file, a file that pauses."""
    rnd = random.Random(8)
    rows = []
    for _ in range(260):
        ts = START + timedelta(minutes=rnd.randrange(60 * 24 * 45))
        if rnd.random() < 0.3:
            ts = ts.replace(hour=0, minute=0)
        path = rnd.choice(["hot", "hot", "hot", "a", "b"]) if ts < START + timedelta(days=20) or rnd.random() < 0.5 else "hot"
        rows.append((path, rnd.choice(["ann", "bo", "cy", None]), ts))
    rows += [("edge", "ann", START + timedelta(days=d)) for d in (5, 17, 17, 29)]  # 12 days apart: on both ends of a window
    rows += [("micro", "bo", START + timedelta(days=6, microseconds=m)) for m in (0, 1, 2)]
    rows.sort(key=lambda r: r[2] + timedelta(days=rnd.random() * 3))
    return rows


def run(spark, batches, tmp_path, delay="4 days"):
    source = f"{tmp_path}/in"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "file_path string, author string, ts timestamp").coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/staged-{i}")
    # One file per batch, in the order of their names' times.
    import os
    import shutil

    os.makedirs(source)
    for i in range(len(batches)):
        part = next(f for f in os.listdir(f"{tmp_path}/staged-{i}") if f.endswith(".parquet"))
        shutil.copy(f"{tmp_path}/staged-{i}/{part}", f"{source}/{i:03}.parquet")
        os.utime(f"{source}/{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("file_path string, author string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    rows = churn_state.sliding_churn(stream, BACK, SLIDE, delay)
    with churn_state.keyed_state(spark):
        live.start_table(rows, f"{tmp_path}/out", f"{tmp_path}/checkpoint", available_now=True).awaitTermination()
    return rows, source


def as_rows(frame):
    columns = ["file_path", "change_frequency", "authors_count", "avg_days_between_changes", "last_modified", "latest_change", "churn_risk_score", "is_hotspot"]
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_every_window_is_what_the_batch_gives(spark, commits, tmp_path):
    before = spark.conf.get(churn_state.keyed_state.NAME, None)
    n = len(commits) // 4 + 1
    batches = [commits[i : i + n] for i in range(0, len(commits), n)]
    newest = max(r[2] for r in commits)
    too_late = [("hot", "zed", START + timedelta(days=1)), ("late", "zed", START + timedelta(days=1))]
    last = [("end", None, newest + timedelta(days=200))]
    run(spark, [*batches, too_late, last, [("end", None, newest + timedelta(days=201))]], tmp_path)
    assert spark.conf.get(churn_state.keyed_state.NAME, None) == before
    found = spark.read.parquet(f"{tmp_path}/out").cache()
    table = spark.createDataFrame(commits, "file_path string, author string, ts timestamp").cache()
    first = (START - datetime(1970, 1, 1)).days // SLIDE * SLIDE
    seen = 0
    for day in range(first, first + 65, SLIDE):
        end = datetime(1970, 1, 1) + timedelta(days=day)
        want = as_rows(churn.with_churn_risk(churn.change_stats(table, end, BACK)))
        assert as_rows(found.where(f"window_end = TIMESTAMP '{end}'")) == want, end
        seen += len(want)
    assert seen == found.where("file_path <> 'end'").count() and seen > 30
    assert found.where("is_hotspot").count() and found.where("file_path = 'edge' AND change_frequency = 3").count()


def test_a_stopped_query_goes_on_from_its_state(spark, commits, tmp_path):
    half = len(commits) // 2
    rows, source = run(spark, [commits[:half]], tmp_path)
    spark.createDataFrame([*commits[half:], ("end", None, START + timedelta(days=300))], "file_path string, author string, ts timestamp").coalesce(1).write.mode(
        "append"
    ).parquet(source)
    with churn_state.keyed_state(spark):
        live.start_table(rows, f"{tmp_path}/out", f"{tmp_path}/checkpoint", available_now=True).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    table = spark.createDataFrame(commits, "file_path string, author string, ts timestamp")
    assert found.count() == found.dropDuplicates(["file_path", "window_end"]).count()
    for end in [r.window_end for r in found.select("window_end").distinct().orderBy("window_end").collect()][2:7:2]:
        assert as_rows(found.where(f"window_end = TIMESTAMP '{end}'")) == as_rows(churn.with_churn_risk(churn.change_stats(table, end, BACK)))


def test_settings_are_checked(spark, tmp_path):
    stream = spark.readStream.schema("file_path string, author string, ts timestamp").parquet(str(tmp_path))
    with pytest.raises(ValueError, match="positive"):
        churn_state.sliding_churn(stream, 90, 0)


def test_commits_of_a_day_have_one_level_of_state(spark, tmp_path):
    schema = "file_path string, author string, ts timestamp"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    days = churn_state.by_day(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "1 day")
    assert days._jdf.queryExecution().analyzed().toString().count("Aggregate [") == 1
