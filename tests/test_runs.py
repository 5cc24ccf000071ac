"""Runs of the append-only tables: repeated, broken off between the tables, broken off while writing."""

from datetime import datetime

import pytest

from srcpulse.sources import folders, store

AS_OF = datetime(2024, 3, 1)


@pytest.fixture
def analysed(spark):
    rows = [(f"f{i}.py", AS_OF, float(i), "low", "completed" if i else "unsupported_file") for i in range(6)]
    return spark.createDataFrame(rows, "file_path string, ts timestamp, decay_score double, risk_level string, status string")


def paths_of(df):
    return sorted(r.file_path for r in df.collect())


def test_a_run_is_stored_once(spark, analysed, tmp_path, monkeypatch):
    m, p = str(tmp_path / "m"), str(tmp_path / "p")
    done = [f"f{i}.py" for i in range(1, 6)]
    assert store.persist_completed(analysed, m, p, "one").count() == 6
    assert store.persist_completed(analysed, m, p, "one").count() == 6
    assert paths_of(store.read_metrics(spark, m)) == paths_of(store.read_predictions(spark, p)) == done

    finish = store.finish
    with monkeypatch.context() as patched:  # the second table's name is never written
        patched.setattr(store, "finish", lambda s, path, run: finish(s, path, run) if path == m else (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            store.persist_completed(analysed, m, p, "two")
    assert len(paths_of(store.read_metrics(spark, m))) == 10 and len(paths_of(store.read_predictions(spark, p))) == 5
    with monkeypatch.context() as patched:  # what is written stays, only the name is added
        patched.setattr(store, "stage", lambda *a: pytest.fail("rows are there already"))
        store.persist_completed(analysed.limit(1), m, p, "two")
    assert paths_of(store.read_metrics(spark, m)) == paths_of(store.read_predictions(spark, p)) == sorted(2 * done)

    store.stage(store._metrics(analysed), m, "three")  # breaks off before either table names it
    assert len(paths_of(store.read_metrics(spark, m))) == 10
    store.persist_completed(analysed, m, p, "three")
    assert paths_of(store.read_metrics(spark, m)) == paths_of(store.read_predictions(spark, p)) == sorted(3 * done)
    assert set(store.finished_runs(spark, m)) == {"one", "two", "three"}


def test_appends_with_and_without_a_name(spark, analysed, tmp_path):
    path = str(tmp_path / "p")
    assert store.append_predictions(analysed, path, "x") and not store.append_predictions(analysed, path, "x")
    assert store.append_predictions(analysed, path) and store.append_predictions(analysed, path)
    assert store.read_predictions(spark, path).count() == 18 and "run" not in store.read_predictions(spark, path).columns
    for name in ("a/b", "..", "_x", "a b"):
        with pytest.raises(ValueError):
            store.append_predictions(analysed, path, name)
    read = store.read_predictions(spark, path)._jdf.queryExecution().toString()
    assert "Join" not in read and "ExistingRDD" not in read and "PartitionFilters: [run" in read.replace("isnotnull(", "")  # runs are folders, named without a Python worker
    folders.write_text(spark, f"{path}/_runs/later.draft", "")  # a name that is being written is none yet
    assert len(store.finished_runs(spark, path)) == 3
