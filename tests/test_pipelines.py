"""Sources, stores, the whole score, reports, model and streams end to end on small folders."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from srcpulse.functions import style
from srcpulse.operators import churn, model, rollups, similarity as sim, style as so
from srcpulse.operators.history import latest_predictions
from srcpulse.plans import pipelines
from srcpulse.schemas import FILE_METRICS
from srcpulse.session import materialize
from srcpulse.sources import corpus, patterns as pat, store, tree as trees
from srcpulse.streaming import live

AS_OF = datetime(2024, 3, 1)


def scanned(spark, root, *args, **options):
    """The scan with paths below the root, which is named proj."""
    found = corpus.scan_corpus(spark, root, *args, **options)
    assert found.filter("NOT startswith(file_path, 'proj/')").isEmpty()
    return found.withColumn("file_path", F.substring("file_path", 6, 999))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    files = {
        "a.py": b"import os\n\ndef add(a, b):\n    return a + b\n", "b.js": b"import x from './y'\r\nconst z = 1\r\n", "c.txt": b"no", "bad.py": b"\xff\xfe\xfa",
        "big.py": b"x" * 3_000_000, "node_modules/m.js": b"1", "src/.cache/h.py": b"1", "src/d.py": b"# TODO\n", "dist/o.js": b"1", ".git/g.py": b"1",
        "pkg/__init__.py": b"",
    }
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(root)


def test_scan(spark, tree):
    rows = {r.file_path: r for r in scanned(spark, tree).collect()}
    assert sorted(rows) == ["a.py", "b.js", "bad.py", "dist/o.js", "pkg/__init__.py", "src/.cache/h.py", "src/d.py"]
    assert rows["b.js"].content == "import x from './y'\nconst z = 1\n" and rows["b.js"].size_bytes == 34
    assert rows["bad.py"].content is None and rows["a.py"].repo == "proj"
    repo = dict(extensions=corpus.REPOSITORY_EXTENSIONS, skip_dirs=corpus.REPOSITORY_SKIP, skip_hidden=True)
    paths = lambda **o: sorted(r.file_path for r in scanned(spark, tree, **repo, **o).collect())
    assert paths() == ["a.py", "b.js", "bad.py", "pkg/__init__.py", "src/d.py"]
    assert paths(walk_root="src") == ["src/d.py"]
    assert paths(walk_root="../elsewhere") == paths()
    assert sorted(r.file_path for r in scanned(spark, tree, [".py"], max_bytes=10).collect()) == [
        "bad.py", "pkg/__init__.py", "src/.cache/h.py", "src/d.py"
    ]


def test_focus_file_comes_whatever_its_name(spark, tree):
    focused = scanned(spark, tree, [".js"], focus_path="c.txt")
    assert sorted(r.file_path for r in focused.collect()) == ["b.js", "c.txt", "dist/o.js"]
    for path in ("big.py", "../c.txt", "none.py", "src"):
        assert scanned(spark, tree, [".js"], focus_path=path).count() == 2


def _inputs(spark):
    commits = spark.createDataFrame(
        [("a.py", f"u{i % 6}", AS_OF - timedelta(days=i)) for i in range(25)] + [("src/d.py", "u", AS_OF - timedelta(days=3))],
        "file_path string, author string, ts timestamp",
    )
    history = spark.createDataFrame(
        [("a.py", AS_OF - timedelta(days=i), 30.0 + 5 * i, 10.0) for i in range(6)],
        "file_path string, ts timestamp, cyclomatic_complexity double, maintainability_index double",
    )
    near = "array<struct<pattern_id:string,distance:double,bug_type:string,severity:string>>"
    neighbours = spark.createDataFrame(
        [("a.py", [("p", 0.0, None, None)] * 5, [("b", 0.0, "security", "critical")] * 3)],
        f"file_path string, decay_neighbours {near}, bug_neighbours {near}",
    )
    return commits, history, neighbours


def test_whole_score_by_hand(spark, tree):
    files = scanned(spark, tree)
    rows = {r.file_path: r for r in pipelines.analyze_files(files, *_inputs(spark), AS_OF, newest_is_current=True).collect()}
    a = rows["a.py"]
    # complexity 30 and rising 65, churn 30 + 20 + 25 = 75, one import without a dot 0, patterns 100
    assert (a.complexity_risk_score, a.churn_risk_score, a.dependency_risk_score, a.pattern_risk_score) == (65.0, 75.0, 0.0, 100.0)
    assert (a.status, a.decay_score, a.risk_level, a.confidence) == ("completed", 63.25, "high", 0.75)
    assert [i["type"] for i in a.predicted_issues] == ["complexity_growth", "high_churn"] + ["security"] * 3
    assert a.optimal_refactor_date == AS_OF + timedelta(days=60)
    assert a.recommendations[0] == "Very high complexity (30.0). Consider refactoring." and len(a.recommendations) == 5
    d = rows["src/d.py"]
    assert (d.change_frequency, d.avg_days_between_changes, d.churn_risk_score) == (1, 90.0, 0.0)
    assert (rows["b.js"].change_frequency, rows["b.js"].pattern_matches, rows["b.js"].decay_score) == (0, 0, 0.0)
    bad = rows["bad.py"]
    assert (bad.status, bad.reason, bad.decay_score, bad.predicted_issues) == ("unsupported_file", "unreadable", None, None)


def test_estimates_without_measurements(spark, tree):
    rows = {r.file_path: r for r in pipelines.analyze_files(scanned(spark, tree), *_inputs(spark), AS_OF).collect()}
    assert rows["a.py"].cyclomatic_complexity == 1.0 and 0 < rows["a.py"].maintainability_index <= 100
    assert rows["b.js"].cyclomatic_complexity == 0.0


def test_project_scan_stores_completed_rows(spark, tree, tmp_path):
    m, p = str(tmp_path / "m"), str(tmp_path / "p")
    result = pipelines.project_scan(spark, tree, *_inputs(spark), AS_OF, m, p)
    assert {r.reason for r in result.filter("status <> 'completed'").collect()} == {"unreadable", "oversized"}
    metrics, predictions = store.read_metrics(spark, m), store.read_predictions(spark, p)
    done = {r.file_path for r in result.filter("status = 'completed'").collect()}
    assert {r.file_path for r in metrics.collect()} == {r.file_path for r in predictions.collect()} == done
    assert predictions.filter("optimal_refactor_date IS NULL OR ts <> timestamp'2024-03-01'").count() == 0
    store.append_metrics(spark.createDataFrame([("n.py", {"k": "v"})], "file_path string, metadata map<string,string>"), m)
    new = store.read_metrics(spark, m).filter("file_path = 'n.py'").first()
    assert new.extra_data == {"k": "v"} and new.ts is not None and new.lines_of_code is None
    assert [f.name for f in FILE_METRICS] == store.read_metrics(spark, m).columns[: len(FILE_METRICS)]


def test_scans_share_signals_of_the_scanned_paths(spark, tree, tmp_path):
    names = ["a.py", "b.js", "src/d.py", "dist/o.js", "node_modules/m.js", ".git/g.py", "c.txt", "pkg/__init__.py", "x/venv/y.py", "venv.py", "a.py\n"]
    paths = spark.createDataFrame([(f"{root}/{n}",) for n in names for root in ("proj", "other", "xproj")], "file_path string")
    kept = {r.file_path for r in paths.where(trees.scanned_path(tree)).collect()}
    assert kept == {f"proj/{n}" for n in ("a.py", "b.js", "src/d.py", "dist/o.js", "pkg/__init__.py", "venv.py")}

    commits, history, neighbours = (d.withColumn("file_path", F.concat(F.lit("proj/"), "file_path")) for d in _inputs(spark))
    counted = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def author(x):
        counted.add(1)
        return x

    commits = commits.unionByName(commits.withColumn("file_path", F.lit("proj/node_modules/m.js"))).withColumn("author", author("author"))
    signals = tuple(materialize(s, "signals") for s in pipelines.stored_signals(commits.where(trees.scanned_path(tree)), history, AS_OF))
    assert counted.value == 26  # the other half lies in a folder that is left out
    m, p = str(tmp_path / "m"), str(tmp_path / "p")
    alone = pipelines.project_scan(spark, tree, commits, history, neighbours, AS_OF, m, p, run_id="alone").collect()
    counted.value = 0
    shared = [pipelines.project_scan(spark, tree, commits, history, neighbours, AS_OF, m, p, run_id=r, signals=signals).collect() for r in ("one", "two")]
    assert counted.value == 0 and all(sorted(s, key=lambda r: r.file_path) == sorted(alone, key=lambda r: r.file_path) for s in shared)
    assert {r.file_path: r.change_frequency for r in alone}["proj/a.py"] == 25 and store.read_metrics(spark, m).count() == 3 * len([r for r in alone if r.status == "completed"])


def test_files_of_one_name_in_two_repositories_stay_apart(spark, tmp_path):
    rows = [("r1", "setup.py", "c", "x", AS_OF), ("r2", "setup.py", "d", "y", AS_OF)]
    spark.createDataFrame(rows, "repo string, file_path string, commit_id string, author string, ts timestamp").write.parquet(str(tmp_path / "log"))
    stats = churn.change_stats(store.read_commits(spark, str(tmp_path / "log"), below_root=True), AS_OF).collect()
    assert sorted((r.file_path, r.change_frequency, r.authors_count) for r in stats) == [("r1/setup.py", 1, 1), ("r2/setup.py", 1, 1)]


def test_hygiene_of_a_scan(spark, tmp_path):
    for name in ("README.md", "LICENSE", "sub/.gitignore"):
        (tmp_path / "proj" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "proj" / name).write_text("x")
    listing = corpus.scan_corpus(spark, str(tmp_path / "proj"), [""])
    assert tuple(rollups.repo_hygiene(listing).first()) == ("proj", True, True, False, False, False)


def test_commit_log_formats(spark, tmp_path):
    rows = spark.createDataFrame([("r", "a.py", "c1", "x@y", AS_OF)], "repo string, file_path string, commit_id string, author string, ts timestamp")
    for kind in ("parquet", "json", "csv"):
        rows.write.format(kind).save(str(tmp_path / kind))
        assert store.read_commits(spark, str(tmp_path / kind), kind).first() == rows.first()


def test_repository_report(spark):
    texts = [("a", f"a/f{i:03d}.py", "except:\n# TODO\npassword = 'x'\n") for i in range(70)] + [("b", "b/x.py", "x = 1\n")]
    files = spark.createDataFrame(texts, "repo string, file_path string, content string")
    commits, history, near = _inputs(spark)
    boost = near.select("decay_neighbours", "bug_neighbours").crossJoin(files.filter("file_path < 'a/f020'").select("file_path"))
    busy = files.filter("file_path < 'a/f020'").select("file_path").crossJoin(commits.filter("file_path = 'a.py'").select("author", "ts"))
    past = files.filter("file_path < 'a/f020'").select("file_path").crossJoin(history.drop("file_path"))
    scored = pipelines.analyze_files(files, busy, past, boost, AS_OF, newest_is_current=True, keep=["repo"], rules=style.DEFAULT_RULES)
    listing = files.select("repo", "file_path").unionByName(spark.createDataFrame([("b", "b/README.md"), ("c", "c/LICENSE")], "repo string, file_path string"))
    got = {r.repo: r for r in pipelines.repo_report(scored, listing, max_files=60).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.files_analyzed, a.files_skipped, a.high_risk_count, len(a.highest_risk_files)) == (60, 10, 20, 15)
    assert [f["file_path"] for f in a.highest_risk_files] == [f"a/f{i:03d}.py" for i in range(15)]
    assert a.avg_decay_score == round(20 * 63.25 / 60, 2)
    assert {k["type"]: k["n"] for k in a.predicted_issue_types} == {"security": 60, "complexity_growth": 20, "high_churn": 20}
    assert [k["type"] for k in a.predicted_issue_types] == ["security", "complexity_growth", "high_churn"]
    assert (a.critical, a.high, a.low, a.total_issues) == (60, 60, 120, 240)
    assert any(s.startswith("20 file(s)") for s in a.shareability_recommendations)
    assert (b.has_readme, b.files_analyzed, b.total_issues, b.avg_decay_score) == (True, 1, 0, 0.0)
    assert (c.files_analyzed, c.avg_decay_score, c.has_license) == (0, 0.0, True)
    everything = {r.repo: r for r in pipelines.repo_report(scored, listing).collect()}
    assert (everything["a"].files_analyzed, everything["a"].files_skipped) == (70, 0)


def test_pattern_catalogue(spark, tmp_path):
    seeds = pat.seed_patterns(spark)
    assert {(r.collection, r.pattern_id) for r in seeds.collect()} == {
        (sim.DECAY, f"pattern_00{i}") for i in (1, 2, 3)
    } | {(sim.BUG, f"bug_00{i}") for i in (1, 2, 3)}
    added = spark.createDataFrame(
        [(sim.BUG, "bug_001", "again", "x", "low", None), (sim.BUG, "n1", "t", "race", "high", {"severity": "reviewed"}), (sim.BUG, "n1", "u", "race", "high", None),
         (sim.DECAY, "bug_001", "other shelf", None, None, None)],
        "collection string, pattern_id string, text string, bug_type string, severity string, meta map<string,string>",
    )
    new = {(r.collection, r.pattern_id): r for r in pat.new_patterns(seeds, added).collect()}
    assert sorted(new) == [(sim.BUG, "n1"), (sim.DECAY, "bug_001")]
    assert new[sim.BUG, "n1"].meta == {"bug_type": "race", "severity": "reviewed"} and new[sim.BUG, "n1"].text == "t"
    assert pat.with_patterns(seeds, added).count() == 8
    pat.append_patterns(seeds, str(tmp_path / "c"), seeds.limit(0))
    pat.append_patterns(seeds, str(tmp_path / "c"), spark.read.parquet(str(tmp_path / "c")))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 6


def test_forest(spark, tmp_path):
    data = model.synthetic_training(spark, 50)
    assert data.count() == 50 and len(data.columns) == 9
    assert data.select(F.min("target") >= 0, F.max("target") <= 100).first()[:2] == (True, True)
    path = str(tmp_path / "forest")
    small = model.train_decay_model(data, trees=5, depth=4)
    model.save_model(small, path)
    loaded = model.load_or_train(path, data)
    a = [r.prediction for r in model.score_decay(small, data).collect()]
    assert a == [r.prediction for r in model.score_decay(loaded, data).collect()]
    assert all(0 <= x <= 100 for x in a)
    again = model.train_decay_model(data, trees=5, depth=4)
    assert a == [r.prediction for r in model.score_decay(again, data).collect()]
    with pytest.raises(ValueError):
        model.train_decay_model(data.limit(0))
    full = model.load_or_train(str(tmp_path / "none"), data)
    assert full.getNumTrees == 100


# --- streams: the same closed input gives what the batch operator gives --------------------------
def _arrivals(spark, df, path, parts):
    """Write rows as one file per arrival, in order."""
    for i in range(parts):
        df.filter(F.col("arrival") == i).drop("arrival").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("arrival").schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_churn_equals_batch_with_late_rows(spark, sf, tmp_path):
    from srcpulse.sources import adapters as A

    events = A.view(A.table(spark, sf, "events"), (*A.COMMITS_EVENTS, ("event_id", "event_id"))).withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.datediff("ts", F.lit("2024-01-01"))
    late = F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)  # every 50th row arrives one batch later
    rows = events.withColumn("arrival", (F.floor((day + late) / 4)).cast("int")).drop("event_id")
    stream = _arrivals(spark, rows, str(tmp_path / "in"), 8)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    live.start_table(live.windowed_churn(stream, delay="2 days"), out, ck, available_now=True).awaitTermination()
    got = {(r.window_start, r.file_path): (r.change_frequency, r.authors_count) for r in spark.read.parquet(out).collect()}
    batch = rows.groupBy(F.date_trunc("day", "ts").alias("d"), "file_path").agg(F.count("*").alias("n"), F.count_distinct("author").alias("a"))
    want = {(r.d, r.file_path): (r.n, r.a) for r in batch.collect()}
    newest = max(d for d, _ in want)
    closed = {k: v for k, v in want.items() if k[0] < newest - timedelta(days=2)}
    assert closed and all(got[k] == v for k, v in closed.items())
    assert set(got) <= set(want)


def test_stream_latest_over_many_batches(spark, tmp_path):
    rows = [(i, f"f{i % 5}", AS_OF + timedelta(hours=(i * 7) % 60), float(i), "low", i // 10) for i in range(60)]
    df = spark.createDataFrame(rows, "prediction_id int, file_path string, ts timestamp, decay_score double, risk_level string, arrival int")
    stream = _arrivals(spark, df, str(tmp_path / "in"), 6)
    live.start_latest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True).awaitTermination()
    got = sorted(tuple(r) for r in live.read_latest(spark, str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in latest_predictions(df.drop("arrival")).collect())


def test_stream_gate_over_many_batches(spark, tmp_path):
    rows = [(f"f{i}.py", "except:\n" if i % 3 == 0 else "x = 1\n", i // 4) for i in range(12)]
    df = spark.createDataFrame(rows, "file_path string, content string, arrival int")
    stream = _arrivals(spark, df, str(tmp_path / "in"), 3)
    live.start_style_gate(stream, str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert live.read_gate(spark, str(tmp_path / "out")).first() == so.gate_report(so.style_check(df)).first()


def test_stream_progress(spark, tmp_path):
    rows = [(AS_OF + timedelta(minutes=5 * i), ("complexity", "velocity")[i % 2], i // 20) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, step string, arrival int")
    stream = _arrivals(spark, df, str(tmp_path / "in"), 3)
    live.start_table(live.progress_counts(stream), str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert got and all(r.events == 6 for r in got)


def test_a_batch_of_one_split_is_checked_on_all_cores(spark, tmp_path, monkeypatch):
    rows = [(f"a{i}.py", "import os\nresult = 1\n") for i in range(40)]
    spark.createDataFrame(rows, "file_path string, content string").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen, check = [], live.style_check
    monkeypatch.setattr(live, "style_check", lambda files, *more: seen.append(files.rdd.getNumPartitions()) or check(files, *more))
    stream = spark.readStream.schema("file_path string, content string").parquet(str(tmp_path / "in"))
    live.start_style_gate(stream, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination()
    assert seen == [spark.sparkContext.defaultParallelism] and live.read_gate(spark, str(tmp_path / "out")).first().files_checked == 40


def test_a_score_is_fused_only_as_far_as_the_jvm_compiles(spark, sf):
    from srcpulse.plans import catalogue

    name = "spark.sql.codegen.hugeMethodLimit"
    given = spark.conf.get(name)
    try:
        for limit, wanted in (("65535", 8000), ("4000", 4000)):
            spark.conf.set(name, limit)
            catalogue.QUERIES["repo_file_results"](spark, sf)
            assert int(spark.conf.get(name)) == wanted
    finally:
        spark.conf.set(name, given)
