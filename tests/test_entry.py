"""The registered queries: names, coverage by SQL, and tasks that run without the package on their path."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = str(Path(__file__).resolve().parent.parent)
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from srcpulse.session import local_session
import __spark_entry__ as entry
spark = local_session(cores="2", memory="2g")
print("rows", entry.entry(spark).count())
from srcpulse.sources.corpus import scan_corpus
print("files", scan_corpus(spark, {ROOT!r} + "/srcpulse", [".py"]).filter("file_path LIKE '%__init__.py'").count())
"""


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tasks_do_not_need_the_package_on_their_path(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 200" in done.stdout and f"files {len(list(Path(ROOT, 'srcpulse').rglob('__init__.py')))}" in done.stdout, done.stderr[-2000:]
