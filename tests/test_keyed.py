"""The keyed table: repeated, broken-off and late batches, folders that do not add up."""

import random
from datetime import datetime, timedelta

import pytest

from srcpulse.operators.history import latest_predictions
from srcpulse.sources import folders, keyed

START = datetime(2024, 1, 1)
DDL = "prediction_id int, file_path string, ts timestamp, key_bucket_note string"


def batches(n):
    rnd = random.Random(n)
    rows = [(i, rnd.choice(["hot", "hot", *(f"f{k}" for k in range(30)), None]), START + timedelta(hours=rnd.randrange(40)), None) for i in range(n * 25)]
    return [rows[25 * i : 25 * i + 25] for i in range(n)]


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def opened(spark, path):
    """Folders that a reader opens."""
    return {f.rsplit("/", 1)[0] for f in keyed.read(spark, path).inputFiles()}


def test_batches_repeats_and_broken_off_batches(spark, tmp_path, monkeypatch):
    path, parts = str(tmp_path / "t"), batches(7)
    put = lambda rows, number, source="q": keyed.merge(spark.createDataFrame(rows, DDL), path, "file_path", latest_predictions, source, number, buckets=8)
    seen = []
    for number, rows in enumerate(parts):
        if number == 3:  # its data are written, its manifest is not
            with monkeypatch.context() as m:
                m.setattr(folders, "write_text", lambda *a: (_ for _ in ()).throw(OSError("gone")))
                with pytest.raises(OSError):
                    put(rows, number)
            assert as_rows(keyed.read(spark, path)) == as_rows(latest_predictions(spark.createDataFrame(seen, DDL)))
        assert put(rows, number)
        seen += rows
        assert as_rows(keyed.read(spark, path)) == as_rows(latest_predictions(spark.createDataFrame(seen, DDL)))
        assert not put(rows, number) and not put(parts[0], 0)
        assert len(opened(spark, path)) <= 8
        stored = sum(len([b for b in folders.names(spark, f"{path}/{v}") if "=" in b]) for v in folders.names(spark, path) if v.startswith("version="))
        assert stored <= 16 and len(folders.names(spark, f"{path}/_manifest")) <= 2
    before = opened(spark, path)
    assert put([(999, "f1", START + timedelta(days=9), None)], 7)
    assert len(opened(spark, path) - before) == 1  # one key, one bucket
    assert put([], 8) and put([(998, "f1", START, None)], 0, "another source")
    assert keyed.read(spark, path).where("file_path = 'f1'").select("prediction_id").collect() == [(999,)]


def test_other_columns_and_no_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        keyed.read(spark, str(tmp_path / "none"))
    path = str(tmp_path / "t")
    keyed.merge(spark.createDataFrame(batches(1)[0], DDL), path, "file_path", latest_predictions, "q", 0)
    with pytest.raises(ValueError, match="columns differ"):
        keyed.merge(spark.createDataFrame([("a", START)], "file_path string, ts timestamp"), path, "file_path", latest_predictions, "q", 1)
