"""The folder tree as a data source: both skip lists, reasons, pushed filters, planned partitions."""

import os

import pytest
from pyspark.sql import functions as F

from srcpulse.operators.metrics import with_support
from srcpulse.sources import corpus, tree

PUSH = "spark.sql.python.filterPushdown.enabled"
FILES = {
    "a.py": "x = 1\r\n", "src/b.py": "y", "src/__init__.py": "", "src/.hidden/c.py": "z", "src/dist/d.js": "d", "node_modules/e.js": "e",
    "src/deep/er/f.ts": "f", "src/big.py": "b" * 500, "src/notes.txt": "n", ".git/g.py": "g", "src/builder/h.rs": "h", "_under.py": "u",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory, spark):
    base = str(tmp_path_factory.mktemp("tree"))
    files = spark.createDataFrame([*FILES.items(), ("none.py", None)], "file_path string, content string")
    assert tree.write_tree(files, base) == len(FILES)
    with open(f"{base}/src/odd.py", "wb") as f:
        f.write(b"\xff\xfe")
    return base


def paths(df):
    return {r.file_path: r.reason for r in df.collect()}


def test_both_lists_and_reasons(spark, root):
    found = tree.read_tree(spark, root, max_bytes=100)
    assert paths(found) == {
        "a.py": None, "src/b.py": None, "src/__init__.py": None, "src/.hidden/c.py": None, "src/dist/d.js": None, "src/deep/er/f.ts": None,
        "src/big.py": "oversized", "src/odd.py": "unreadable", "_under.py": None,
    }
    assert found.where("content IS NULL").count() == 2 and found.where("file_path = 'src/big.py'").first().size_bytes == 500
    options = {"skip_dirs": corpus.REPOSITORY_SKIP, "skip_hidden": True, "walk_root": "src/", "focus_path": "src/notes.txt"}
    report = tree.scan_tree(spark, root, corpus.REPOSITORY_EXTENSIONS, 100, **options)
    name = os.path.basename(root)
    assert set(paths(report)) == {f"{name}/src/{x}" for x in ("b.py", "__init__.py", "deep/er/f.ts", "big.py", "odd.py", "builder/h.rs", "notes.txt")}
    assert report.where("repo <> split(file_path, '/')[0]").count() == 0
    kept = corpus.scan_corpus(spark, root, max_bytes=100)
    assert kept.count() == 8 and kept.where("file_path LIKE '%/a.py'").first().content == "x = 1\n"
    assert {r.reason for r in with_support(tree.scan_tree(spark, root, max_bytes=100)).collect()} == {None, "oversized", "unreadable"}
    assert tree.read_tree(spark, f"{root}/absent").count() == 0
    outside = tree.read_tree(spark, root, walk_root="../..", focus_path="../x.py", max_bytes=100)
    assert paths(outside) == paths(found)  # a root that leads outside is the whole tree


def test_filters_are_pushed_and_still_hold(spark, root):
    whole = tree.read_tree(spark, root)
    conditions = [
        F.col("file_path").startswith("src/d"), F.col("file_path") == "src/b.py", F.col("file_path").isin("a.py", "src/deep/er/f.ts"),
        (F.col("size_bytes") <= 1) & F.col("file_path").startswith("src/"), F.col("file_path").endswith(".ts"), F.col("size_bytes") < 1,
    ]
    want = [paths(whole.where(c)) for c in conditions]
    assert all(want)
    spark.conf.set(PUSH, "true")
    try:
        pushed = tree.read_tree(spark, root)
        for c, rows in zip(conditions, want, strict=True):
            assert paths(pushed.where(c)) == rows
    finally:
        spark.conf.unset(PUSH)


def reader(root, **options):
    return tree.FilteringTreeReader({"root": root, **options})


def test_planning_and_pruning(root):
    one = reader(root, tasks="2")
    assert list(one.pushFilters([tree.StringStartsWith(("file_path",), "src/deep/"), tree.LessThan(("size_bytes",), 3)]))  # Spark asks them again
    assert [one._may_hold(f) for f in ("", "src", "src/deep", "src/deep/er", "src/dist", "srcx")] == [True, True, True, True, False, False]
    assert one._wanted("src/deep/er/f.ts", 1) and not one._wanted("src/deep/er/f.ts", 5) and not one._wanted("a.py", 1)
    rows = [r for p in one.partitions() for b in one.read(p) for r in b.to_pylist()]
    assert [r["file_path"] for r in rows] == ["src/deep/er/f.ts"]
    none = reader(root)
    list(none.pushFilters([tree.EqualTo(("file_path",), "a.py"), tree.In(("file_path",), ("src/b.py",))]))
    assert [r for p in none.partitions() for b in none.read(p) for r in b.to_pylist()] == []


def test_a_folder_of_many_files_is_read_in_turns(root, tmp_path, monkeypatch):
    for i in range(23):
        (tmp_path / f"f{i}.py").write_text(str(i))
    monkeypatch.setattr(tree, "_TURN_FILES", 5)
    one = reader(str(tmp_path), tasks="3")
    parts = one.partitions()
    assert sum(len(p.own) for p in parts) == 5 and len(parts) == 3
    seen = [r["file_path"] for p in parts for b in one.read(p) for r in b.to_pylist()]
    assert len(seen) == len(set(seen)) == 23
