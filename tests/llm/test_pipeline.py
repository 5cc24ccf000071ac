"""The pipeline: each stage on its own input against a plain re-statement, and the guard of the entry module."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pytest

from srcpulse.llm import toxicity
from srcpulse.llm.queries import ORACLE, QUERIES
from tests.llm.test_decontaminate import brute as hits_of
from tests.llm.test_exact import brute as groups_of
from tests.llm.test_tokens import check_pieces

ROOT = Path(__file__).resolve().parents[2]


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    sf, out = "/root/testdata/sf0.001", [spark.read.parquet("/root/testdata/sf0.001/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("steps") / name)
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_filtering_stages_keep_the_columns(steps):
    assert all(s.dtypes == steps[0].dtypes for s in steps[1:5])
    assert all(r.n_chars == len(r.text) for r in steps[4].collect())


def test_toxic_documents_go(spark, steps, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = set(rows(steps[1]))
    scored = {r.doc_id: r.score for r in toxicity.report(steps[0], labels).collect()}
    assert kept == {d for d, s in scored.items() if s < 0.5}


def test_one_of_each_group_of_copies_stays(steps):
    before = list(rows(steps[1]).items())
    assert sorted(map(str, rows(steps[2]))) == sorted({keep for _, keep, _, _ in groups_of(before)})


def test_near_copies_go_and_others_stay(steps):
    before, after = rows(steps[2]), rows(steps[3])
    sets = {d: shingles(t) for d, t in before.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    gone = set(before) - set(after)
    assert all(max(like(d, k) for k in before if k != d) > 0.6 for d in gone)
    assert not any(a < b and like(a, b) >= 0.9 for a in after for b in after)


def test_no_benchmark_passage_is_left(spark, steps, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = rows(steps[3]), rows(steps[4])
    hit = hits_of(before.items(), items, 10)
    for doc, (n, n_hit, *_) in hit.items():
        assert (doc in after) == (n_hit <= 0.8 * n)
        if not n_hit:
            assert after[doc] == before[doc]
    assert sum(h[1] for h in hits_of(after.items(), items, 10).values()) == 0


def test_what_stays_is_packed(steps):
    pieces = steps[5].collect()
    check_pieces(pieces, 1024)
    assert {r.doc_id for r in pieces} == set(rows(steps[4]))


def test_all_operators_are_registered():
    import __spark_entry__ as entry

    assert [n for n in range(1, 11) if sum(q.startswith(f"op{n}_") for q in entry.queries()) != 1] == []
    assert entry.queries()["pipeline"] is corpus_pipeline.run and set(ORACLE) <= set(QUERIES)


def test_the_entry_works_without_these_folders(tmp_path):
    script = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "srcpulse.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
assert not any(q.startswith("op") for q in entry.queries()) and "pipeline" not in entry.queries()
print("fine")
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "fine" in done.stdout, done.stderr[-2000:]
