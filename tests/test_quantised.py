"""Bounds of eight-bit codes, and what they leave open."""

import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcpulse.operators import quantised as qz, similarity as sim
from srcpulse.sources import adapters as A


@given(st.integers(0, 10**6), st.sampled_from(["l2", "cosine"]), st.sampled_from([1e-6, 1.0, 1e4]))
@settings(max_examples=80, deadline=None)
def test_true_distances_lie_within_the_bounds(seed, metric, size):
    r = np.random.default_rng(seed)
    p, q = r.normal(size=(30, 12)) * size, r.normal(size=(9, 12)) * size
    p[3], p[4], q[0] = 0.0, p[5], p[5]
    p[6, 0] *= 1e3  # one component far above the others: a coarse code
    p, q = qz.unit(p.astype(np.float32).astype(np.float64), metric), qz.unit(q, metric)
    code, scale, rest = qz.coded(p)
    assert code.dtype == np.int8 and (np.linalg.norm(p - code * scale[:, None], axis=1) <= rest).all()
    low, high = qz.bounds(q, code, scale, rest, metric)
    true = np.maximum(1 - q @ p.T, 0) if metric == "cosine" else ((q[:, None] - p[None]) ** 2).sum(axis=2)
    assert (low <= true).all() and (true <= high).all()
    k_nearest = np.argsort(true, axis=1, kind="stable")[:, :4]
    assert np.take_along_axis(qz.still_open(low, high, 4), k_nearest, axis=1).all()


def _frames(spark, n, m, dims=16):
    r = np.random.default_rng(n)
    p = r.normal(size=(n, dims)).astype(np.float32)
    p[: n // 3] = p[0]
    q = np.concatenate([p[:1], r.normal(size=(m - 1, dims)).astype(np.float32)])
    shelf = [(f"p{i:05}", v.tolist(), "bug", "high") for i, v in enumerate(p)]
    asked = [(f"q{i}", v.tolist()) for i, v in enumerate(q)]
    return (
        p, q, spark.createDataFrame(asked, "query_id string, embedding array<float>").repartition(3),
        spark.createDataFrame(shelf, "pattern_id string, embedding array<float>, bug_type string, severity string").repartition(4),
    )


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("query_bytes", [qz.QUERY_BYTES, 0])
def test_answers_are_those_of_a_plain_loop(spark, metric, query_bytes, monkeypatch):
    monkeypatch.setattr(qz, "CODE_ROWS", 50)
    monkeypatch.setattr(qz, "QUERY_ROWS", 7)
    p, q, asked, shelf = _frames(spark, 400, 20)
    found = qz.search(asked, shelf, 6, metric, None, sim._pair_distances, query_bytes=query_bytes)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.distance, r.pattern_id)
    for i, v in enumerate(q.astype(np.float64)):
        w = p.astype(np.float64)
        d = ((w - v) ** 2).sum(axis=1) if metric == "l2" else 1 - w @ v / np.linalg.norm(w, axis=1) / np.linalg.norm(v)
        want = sorted((round(max(float(x), 0.0), 6), f"p{j:05}") for j, x in enumerate(d))[:6]
        assert [(round(x, 6), pid) for _, (x, pid) in sorted(got[f"q{i}"].items())] == want


def test_a_shared_vector_brings_no_more_than_k_candidates(spark):
    _, _, asked, shelf = _frames(spark, 600, 5)
    first = qz.first_of_equals(shelf, 6).withColumn("place", F.xxhash64("pattern_id"))
    assert first.count() == 400 + 6
    near = qz.candidates(asked.withColumn("place", F.xxhash64("query_id")), first, 6, "l2")
    assert near.groupBy("query").count().agg(F.max("count")).first()[0] < 60


def test_share_of_full_vectors_on_the_shipped_table(spark):
    sf = "/root/testdata/sf0.1"
    q = A.query_vectors(spark, sf).withColumn("place", F.col("query_id"))
    shelf = A.patterns(spark, sf).where("collection = 'bug_patterns'").withColumn("place", F.col("pattern_id").cast("long"))
    near = qz.candidates(q, shelf, 3, "cosine").count()
    share = near / (q.count() * shelf.count())
    assert near >= 3 * q.count() and share < 0.02


def test_a_block_of_bounds_is_held_in_parts():
    r = np.random.default_rng(1)
    block = (np.arange(8192), *qz.coded(r.normal(size=(8192, 16))))
    q = r.normal(size=(1024, 16))
    tracemalloc.start()
    found = sum(b.num_rows for b in qz._found(np.arange(1024), q, block, 3, "l2", np.full(1024, np.inf)))
    assert found >= 3 * 1024 and tracemalloc.get_traced_memory()[1] < 100e6  # all bounds at once: 67 MB an array
    tracemalloc.stop()
