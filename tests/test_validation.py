from pyspark.sql import functions as F

from srcpulse.operators import rollups, style as so, urls, validation as v
from srcpulse.plans import pipelines


def test_change_set_prefers_staged(spark):
    rows = [("a", "a/1", "staged"), ("a", "a/2", "modified"), ("b", "b/1", "modified"), ("b", "b/2", "unchanged"), ("c", "c/1", "unchanged")]
    got = v.change_set(spark.createDataFrame(rows, "repo string, file_path string, status string")).collect()
    assert sorted((r.file_path, r.status) for r in got) == [("a/1", "staged"), ("b/1", "modified")]


def _loop(requests, sizes, max_files, max_bytes):
    """The plain loop over one batch: stop at max_files valid paths, look at no more than one beyond."""
    valid, rejected = [], 0
    for repo, path in requests[: max_files + 1]:
        if len(valid) >= max_files:
            break
        if path in sizes and path.startswith(repo + "/") and sizes[path] <= max_bytes:
            valid.append(path)
        else:
            rejected += 1
    return valid, rejected


def test_paths_equal_a_plain_loop(spark):
    sizes = {f"r/{i}.py": (5000 if i % 11 == 0 else 10) for i in range(40)} | {"other/x.py": 1, "rx/y.py": 1}
    batches = {
        1: [("r", f"r/{i}.py") for i in range(40)], 2: [("r", "other/x.py"), ("r", "rx/y.py"), ("r", "r/1.py"), ("r", "r/99.py"), ("r", "")],
        3: [("r", f"r/{i % 3}.py") for i in range(9)],
    }
    req = [(b, repo, i, p) for b, paths in batches.items() for i, (repo, p) in enumerate(paths)]
    requests = spark.createDataFrame(req, "batch_id int, repo string, request_ord int, requested_path string")
    files = spark.createDataFrame(list(sizes.items()), "file_path string, size_bytes bigint")
    for cap in (4, 8, 50):
        looked = v.validate_paths(requests, files, max_files=cap, max_bytes=1000)
        got = {r.batch_id: (r.valid_paths, r.paths_rejected) for r in v.path_counts(looked).collect()}
        for b, paths in batches.items():
            valid, rejected = _loop(paths, sizes, cap, 1000)
            assert got[b] == (len(valid), rejected), (cap, b)
    status = {r.batch_id: r.batch_status for r in v.batch_status(requests, 8).collect()}
    assert status == {1: "too_many_paths", 2: "accepted", 3: "accepted"}


def test_repositories(spark):
    req = spark.createDataFrame([("r",), ("",), ("/",), ("x" * 5000,), ("nope",), (None,)], "repo_path string")
    got = [r.repo_status for r in v.validate_repos(req, spark.createDataFrame([("r",)], "repo string")).orderBy("repo_path").collect()]
    assert sorted(got) == ["invalid"] * 4 + ["not_found", "ok"]


def test_check_changes_messages_limits_and_findings(spark):
    files = [("r/a.py", "except:\n", 10), ("r/b.py", "x = 1\n", 10), ("r/c.py", "# TODO\n", 10)]
    files = spark.createDataFrame(files, "file_path string, content string, size_bytes bigint")
    req = [(1, "r", 0, "r/a.py"), (2, "r", 0, "r/b.py"), (2, "r", 1, "r/c.py"), (3, "r", 0, "r/none.py")] + [(4, "r", i, "r/b.py") for i in range(5)]
    req = spark.createDataFrame(req, "batch_id int, repo string, request_ord int, requested_path string")
    few = {r.batch_id: r for r in pipelines.check_changes(req, files, max_files=2).collect()}
    all_ = {r.batch_id: r for r in pipelines.check_changes(req, files).collect()}
    assert (all_[4].ok, all_[4].batch_status, all_[4].files_checked) == (True, "accepted", 5) and all_[2] == few[2]
    found = [(r.batch_id, r.file_path, r.type) for r in pipelines.check_changes_issues(req, files).collect()]
    assert len(found) == sum(r.total_issues for r in all_.values()) and (1, "r/a.py", "bare_except") in found
    below = files.withColumn("repo", F.lit("r")).withColumn("file_path", F.substring("file_path", 3, 9))
    short = req.withColumn("requested_path", F.substring("requested_path", 3, 9))
    assert {r.batch_id: r for r in pipelines.check_changes(short, below, below_root=True).collect()} == all_
    unread = files.withColumn("content", F.lit(None).cast("string"))
    assert all(r.total_issues == 0 and r.ok for r in pipelines.check_changes(req, unread).collect())
    assert (few[1].ok, few[1].message) == (False, so.GATE_FAILED)
    assert (few[2].ok, few[2].total_issues, few[2].files_with_issues, few[2].message) == (True, 2, 1, so.GATE_PASSED)
    assert (few[3].ok, few[3].files_checked, few[3].paths_rejected, few[3].message) == (True, 0, 1, so.NO_VALID_FILES)
    assert (few[4].ok, few[4].batch_status) == (None, "too_many_paths")


URLS = [
    ("https://github.com/octocat/Hello-World", (None, "octocat", "Hello-World", None, None, False)),
    ("https://github.com/octocat/Hello-World/blob/main/README", (None, "octocat", "Hello-World", "main", "README", False)),
    ("https://raw.githubusercontent.com/octocat/Hello-World/v1.0/README.md", (None, "octocat", "Hello-World", "v1.0", "README.md", True)),
    ("http://github.com/a/b", ("not_https",)), ("https://evil.com/a/b", ("host_not_allowed",)), ("", ("empty",)), (None, ("empty",)),
    ("https://github.com/a", ("missing_owner_or_repo",)), ("https://raw.githubusercontent.com/a/b/c", ("missing_raw_path",)),
    (" HTTPS://u:p@WWW.GitHub.com./a/b.git/tree/v1/x/y?q=1#f ", (None, "a", "b", "v1", "x/y", False)),
    ("https://github.com/a/b/tree", (None, "a", "b", None, None, False)), ("https://github.com/a/b/issues/3", (None, "a", "b", None, None, False)),
    ("https://github.com:443/a/b", ("host_not_allowed",)), ("github.com/a/b", ("not_https",)),
    ("https://github.com//a//b/blob/main", (None, "a", "b", "main", None, False)),
]


def test_source_urls(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(URLS)], "i int, url string")
    for r in urls.classify_source_urls(df).collect():
        want = URLS[r.i][1]
        got = (r.reason, r.owner, r.repo, r.ref, r.path_in_repo, r.is_raw_file)
        assert got[: len(want)] == want, r.url
        assert r.reason is None or got[1:] == (None,) * 5


def test_hygiene_looks_at_top_names_only(spark):
    rows = [("a", "a/README"), ("a", "a/sub/LICENSE"), ("b", "b/readme.rst"), ("b", "b/Copying"), ("b", "b/.gitignore"), ("b", "b/docs/x.md"),
            ("b", "b/contributing/x.md"), ("b", "b/CODE_OF_CONDUCT.md")]
    got = {r.repo: tuple(r)[1:] for r in rollups.repo_hygiene(spark.createDataFrame(rows, "repo string, file_path string")).collect()}
    assert got == {"a": (True, False, False, False, False), "b": (True, True, True, True, True)}
    below = spark.createDataFrame([(r, p.split("/", 1)[1]) for r, p in rows], "repo string, file_path string")
    assert {r.repo: tuple(r)[1:] for r in rollups.repo_hygiene(below, below_root=True).collect()} == got


def test_suggestions(spark):
    def suggest(flags, critical=0, ai=0, bug=0, risky=0, mean=0.0):
        args = [F.lit(f) for f in flags] + [F.lit(x) for x in (critical, ai, bug, risky, mean)]
        return spark.range(1).select(rollups.shareability(*args)).first()[0]

    assert suggest([True] * 4) == []
    assert suggest([False] * 4) == [rollups.ADD_README, rollups.ADD_LICENSE, rollups.ADD_GITIGNORE, rollups.ADD_CONTRIBUTING]
    full = suggest([True] * 4, 1, 5, 8, 2, 90.0)
    assert full == [rollups.FIX_CRITICAL, rollups.TIGHTEN_STYLE, "2" + rollups.HIGH_RISK_FILES, rollups.TIGHTEN_ERRORS]
    assert suggest([True] * 4, 0, 4, 7, 0, 50.0) == [rollups.ELEVATED_RISK]
    assert suggest([True] * 4, 0, 4, 7, 0, 49.9) == []


def test_bounded_choice_puts_the_focus_first(spark):
    df = spark.createDataFrame([("a", f"a/{i:02d}.py") for i in range(9)] + [("b", "b/1.py")], "repo string, file_path string")
    kept = rollups.select_bounded(df, 3, F.col("file_path") == "a/08.py")
    assert sorted(r.file_path for r in kept.collect()) == ["a/00.py", "a/01.py", "a/08.py", "b/1.py"]
    assert {r.repo: r.files_skipped for r in rollups.skipped_counts(df, 3).collect()} == {"a": 6, "b": 0}
    assert rollups.select_bounded(df, None).count() == 10
