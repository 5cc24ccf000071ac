"""URL reports, rejects of text exports, high-risk rows, lists without a limit, forests on unseen folds."""

import shutil
from datetime import datetime

import pytest
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from srcpulse.operators import history as hist, model, rollups
from srcpulse.plans import pipelines
from srcpulse.sources import store

AS_OF = datetime(2024, 3, 1)


def test_url_reports(spark):
    files = [("r", p, s, lv) for p, s, lv in (
        ("a.py", 10.0, "low"), ("src/b.py", 80.0, "high"), ("src/dist/c.py", 90.0, "critical"), ("src/dist/deep/d.js", 50.0, "medium"),
        ("src/.x/e.py", 5.0, "low"), ("docs/readme.md", None, None), ("srcx/f.py", 40.0, "medium"),
    )] + [("other", "src/b.py", 1.0, "low")]
    scored = spark.createDataFrame(files, "repo string, file_path string, decay_score double, risk_level string")
    targets = spark.createDataFrame(
        [(1, "r", None, False), (2, "r", "src", False), (3, "r", "src/dist/", False), (4, "r", "docs/readme.md", False), (5, "r", "src/b.py", False), (6, "r", "src/b.py", True),
         (7, "r", "absent/x", False), (8, "r", "../r", False), (9, "nowhere", "src", False), (10, "r", "docs", False), (11, "other", "src", False), (2, "r", "src", False)],
        "url_id int, repo string, path_in_repo string, is_raw_file boolean",
    )
    rows = pipelines.url_reports(targets, scored.select("repo", "file_path"), scored).collect()
    got = {r.url_id: (r.files_analyzed, r.avg_decay_score, r.high_risk_count, r.first_file) for r in rows}
    whole = (3, 43.33, 1, "a.py")  # folders that are left out count for the whole repository, not below a root within them
    assert len(rows) == 12 and got[1] == got[6] == got[7] == got[8] == whole
    assert got[2] == (1, 80.0, 1, "src/b.py") and got[3] == (2, 70.0, 1, "src/dist/c.py")
    assert got[4] == (4, 32.5, 1, "docs/readme.md") and got[5] == (3, 43.33, 1, "src/b.py")
    assert got[9] == (0, 0.0, 0, None) == got[10] and got[11] == (1, 1.0, 0, "src/b.py")


def test_url_reports_analyse_once(spark, monkeypatch):
    looked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def analysed(x):
        looked.add(1)
        return x

    files = spark.createDataFrame([("r", f"src/f{i}.py", float(i), "high") for i in range(20)], "repo string, file_path string, x double, risk_level string")
    scored = files.select("repo", "file_path", analysed("x").alias("decay_score"), "risk_level")
    targets = spark.createDataFrame([(1, "r", "src", False), (2, "r", "src/f3.py", False)], "url_id int, repo string, path_in_repo string, is_raw_file boolean")
    rows = [sorted(map(tuple, pipelines.url_reports(targets, files.select("repo", "file_path"), scored).collect()))]
    assert looked.value == 20 and [r[6:9] for r in rows[0]] == [(20, 9.5, 20)] * 2
    monkeypatch.setattr(pipelines, "BROADCAST_ROOTS", 0)
    rows.append(sorted(map(tuple, pipelines.url_reports(targets, files.select("repo", "file_path"), scored).collect())))
    assert rows[0] == rows[1]


def test_rejected_lines(spark, tmp_path):
    lines = ["r,a.py,c1,ann,2024-01-02 03:04:05", "r,b.py", "r,,c2,bo,2024-01-02 00:00:00", "r,d.py,c3,cy,", "r,e.py,c4,,soon", 'r,"f,1.py",c5,,2024-02-03']
    (tmp_path / "log.csv").write_text("\n".join(lines) + "\n")
    checked = store.checked_commits(spark, str(tmp_path / "log.csv"), below_root=True)
    counts = {r.reason: r.lines for r in store.reject_counts(checked).collect()}
    assert counts == {"accepted": 2, "malformed": 1, "no_path": 1, "no_time": 1, "bad_time": 1}
    good = {r.file_path: r for r in store.good_commits(checked).collect()}
    assert set(good) == {"r/a.py", "r/f,1.py"} and good["r/a.py"].ts == datetime(2024, 1, 2, 3, 4, 5) and good["r/f,1.py"].author is None
    assert checked.where("reason = 'malformed'").first().raw == "r,b.py"
    (tmp_path / "log.json").write_text('{"repo":"r","file_path":"a.py","ts":"2024-01-02"}\n{"repo":\n[1]\n{}\n{"file_path":"x","ts":1}\n')
    counts = {r.reason: r.lines for r in store.reject_counts(store.checked_commits(spark, str(tmp_path / "log.json"), "json")).collect()}
    assert counts["accepted"] == 1 and counts["malformed"] >= 2 and counts["no_path"] == 1 and sum(counts.values()) == 5
    with pytest.raises(ValueError):
        store.checked_commits(spark, str(tmp_path), "parquet")


def test_rows_with_their_count_and_whole_lists(spark):
    rows = [(f"f{i:03}", "r", AS_OF, 90.0 - i / 10, "critical") for i in range(40)] + [("low", "r", AS_OF, 5.0, "low")]
    df = spark.createDataFrame(rows, "file_path string, repo string, ts timestamp, decay_score double, risk_level string")
    found = hist.high_risk_with_count(df, 87.0).collect()
    assert len(found) == 31 and {r["count"] for r in found} == {31} and {r.threshold for r in found} == {87.0}
    assert hist.high_risk_with_count(df, 99.0).count() == 0
    assert rollups.top_n_risky(df, None).count() == 40 and rollups.top_n_risky(df, 15).count() == 15


def test_folds_and_saved_forests(spark, tmp_path):
    rows = spark.range(240).select(
        F.concat(F.lit("f"), "id").alias("file_path"), *[(F.rand(i) * 100).alias(c) for i, c in enumerate(model.FEATURES)]
    ).withColumn("target", F.col(model.FEATURES[0]) * 0.5 + F.col(model.FEATURES[2]) * 0.3)
    rows.write.parquet(str(tmp_path / "features"))
    features = model.with_folds(spark.read.parquet(str(tmp_path / "features")), 3)
    assert {r.fold for r in features.select("fold").distinct().collect()} == {0, 1, 2}
    out = model.out_of_fold(features, folds=3, trees=10).cache()
    assert out.select("file_path").distinct().count() == out.count() == 240
    errors = model.fold_errors(out).collect()
    assert len(errors) == 3 and sum(e.n for e in errors) == 240 and all(e.error < e.error_of_mean for e in errors)
    seen = model.train_decay_model(features.where("fold = 0"), trees=3)
    path = str(tmp_path / "forest")
    model.save_model(seen, path)
    assert model.load_or_train(path, features).getNumTrees == 3
    for damaged in (tmp_path / "forest" / "data").rglob("*.parquet"):
        damaged.write_bytes(b"")
        (damaged.parent / f".{damaged.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark makes of it, but no new forest
        model.load_or_train(path, features)


def test_large_forests_are_saved_in_parts(spark, tmp_path, monkeypatch):
    """No part holds more nodes than are to be in the driver at once; trees, order and settings stay, and no tree is lost unnoticed."""
    data = model.assemble(model.synthetic_training(spark, 200)).withColumnRenamed("features", "own")
    forest = RandomForestRegressor(featuresCol="own", labelCol="target", predictionCol="score", numTrees=7, maxDepth=5, seed=1).fit(data)
    most = 2 * max(t.numNodes for t in forest.trees)
    monkeypatch.setattr(model, "SAVED_NODES", most, raising=False)
    path = str(tmp_path / "forest")
    model.save_model(forest, path)
    parts = [RandomForestRegressionModel.load(str(p)) for p in sorted((tmp_path / "forest" / "data").iterdir())]
    assert 1 < len(parts) <= 4 and sum(p.getNumTrees for p in parts) == 7 and all(p.totalNumNodes <= most for p in parts)
    loaded = model.load_model(path)
    assert loaded.toDebugString.split("\n", 1)[1] == forest.toDebugString.split("\n", 1)[1] and loaded.uid == forest.uid
    assert loaded.numFeatures == forest.numFeatures and loaded.getPredictionCol() == "score" and loaded.getMaxDepth() == 5
    scores = lambda m: [r.score for r in m.transform(data).collect()]
    assert scores(loaded) == scores(forest)
    small = model.train_decay_model(data.drop("own"), trees=2, depth=2)
    model.save_model(small, path)
    assert model.load_model(path).getNumTrees == 2
    model.save_model(forest, path)
    shutil.rmtree(sorted((tmp_path / "forest" / "data").iterdir())[-1])
    with pytest.raises(ValueError):
        model.load_or_train(path, data)
    forest.write().overwrite().save(path)  # as forests were saved before
    assert scores(model.load_model(path)) == scores(forest)
