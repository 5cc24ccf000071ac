"""All ways of the search against a plain loop."""

import pickle
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from srcpulse.operators import similarity as sim

K = {"decay_patterns": 5, "bug_patterns": 3}
WAYS = [{"max_broadcast_bytes": sim.MAX_BROADCAST_BYTES}, {"max_broadcast_bytes": 0, "large": "cells"}, {"max_broadcast_bytes": 0}]


def _data(n=240, queries=60, dims=8, seed=3):
    rnd = np.random.default_rng(seed)
    vectors = rnd.normal(size=(n, dims)).astype(np.float32)
    vectors[: n // 3] = vectors[0]  # a third of the catalogue is one vector
    patterns = [
        (("decay_patterns", "bug_patterns")[i % 2], f"p{i:04d}", [float(x) for x in v], f"t{i % 4}", ("high", "critical")[i % 3 == 0])
        for i, v in enumerate(vectors)
    ]
    asked = rnd.normal(size=(queries, dims)).astype(np.float32)
    asked[: queries // 3] = vectors[0]
    return patterns, [(i, [float(x) for x in v]) for i, v in enumerate(asked)]


def _frames(spark, patterns, queries):
    return (
        spark.createDataFrame(queries, "query_id bigint, embedding array<float>"),
        spark.createDataFrame(patterns, "collection string, pattern_id string, embedding array<float>, bug_type string, severity string"),
    )


def _loop(patterns, queries, metric, max_distance=None):
    out = {}
    for qid, q in queries:
        q = np.array(q)
        for name, k in K.items():
            found = []
            for coll, pid, p, *_ in patterns:
                if coll == name:
                    p = np.array(p)
                    d = ((q - p) ** 2).sum() if metric == "l2" else 1 - q @ p / np.sqrt((q @ q) * (p @ p))
                    found.append((round(max(float(d), 0.0), 9), pid))
            near = [f for f in sorted(found)[:k] if max_distance is None or f[0] <= max_distance]
            out[qid, name] = [(pid, round(d, 6)) for d, pid in near]
    return out


def _rows(found):
    out = {}
    for r in sorted(sim.neighbour_rows(found).collect(), key=lambda r: (r.query_id, r.collection, r["rank"])):
        out.setdefault((r.query_id, r.collection), []).append((r.pattern_id, round(r.distance, 6)))
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("way", WAYS)
def test_equals_a_plain_loop(spark, metric, way, monkeypatch):
    monkeypatch.setattr(sim, "CELL_ROWS", 16)
    monkeypatch.setattr(sim, "QUERY_ROWS", 8)
    patterns, queries = _data()
    found = sim.nearest_patterns(*_frames(spark, patterns, queries), metric=metric, **way)
    assert _rows(found) == _loop(patterns, queries, metric)


@pytest.mark.parametrize("way", WAYS)
def test_max_distance(spark, way):
    patterns, queries = _data(60, 20)
    found = sim.nearest_patterns(*_frames(spark, patterns, queries), metric="l2", max_distance=4.0, **way)
    want = {key: v for key, v in _loop(patterns, queries, "l2", 4.0).items() if v}
    assert _rows(found) == want and found.count() == 20


@pytest.mark.parametrize("way", WAYS)
def test_small_and_empty_catalogues(spark, way):
    patterns, queries = _data(3, 4)
    q, p = _frames(spark, patterns, queries)
    row = sim.nearest_patterns(q, p, **way).filter("query_id = 0").first()
    assert (len(row.decay_neighbours), len(row.bug_neighbours)) == (2, 1)
    empty = sim.nearest_patterns(q, p.limit(0), **way).collect()
    assert len(empty) == 4 and all(not r.decay_neighbours and not r.bug_neighbours for r in empty)
    with pytest.raises(ValueError):
        sim.nearest_patterns(q, p, metric="dot")


@pytest.mark.parametrize("way", WAYS)
def test_queries_without_a_vector_and_seeds_without_one(spark, way):
    patterns, queries = _data(20, 4)
    q, p = _frames(spark, patterns + [("bug_patterns", "none", None, "x", "low")], queries + [(99, None)])
    rows = {r.query_id: r for r in sim.nearest_patterns(q, p, **way).collect()}
    assert len(rows) == 5 and not rows[99].decay_neighbours and len(rows[0].decay_neighbours) == 5


def test_far_vectors(spark):
    patterns, queries = _data(40, 6)
    patterns = [(c, i, [x * 1e5 for x in v], t, s) for c, i, v, t, s in patterns]
    q, p = _frames(spark, patterns, queries)
    got = sim.nearest_patterns(q, p, metric="l2").filter("query_id = 5").first()
    distances = [n.distance for n in got.decay_neighbours]
    assert distances == sorted(distances) and len(distances) == 5


def test_bounded_search_has_no_shuffle(spark):
    q, p = _frames(spark, *_data(30, 5))
    plan = sim.with_pattern_risk(sim.nearest_patterns(q, p))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_distances_are_held_in_tiles():
    r = np.random.default_rng(1)
    q, p = (sim._unit(r.normal(size=(n, 16)), "cosine") for n in (500, 20000))
    tracemalloc.start()
    near, dist, counts = sim._top_k(q, p, 5, "cosine", None)
    assert tracemalloc.get_traced_memory()[1] < 60e6  # four million distances at once: 32 MB an array
    tracemalloc.stop()
    want = np.argsort(np.round(1 - q @ p.T, 9), axis=1, kind="stable")[:, :5]
    assert (near == want).all() and (counts == 5).all() and (np.diff(dist, axis=1) >= 0).all()


def test_a_query_goes_to_groups_of_cells_not_to_each_cell(spark, monkeypatch):
    """Random vectors name every cell: a query then has a row per group of cells, however many cells there are."""
    written, kept = {}, sim.materialize

    def counted(frame, purpose):
        out = kept(frame, purpose)
        written[purpose] = max(written.get(purpose, 0), out.count())
        return out

    monkeypatch.setattr(sim, "materialize", counted)
    patterns, queries = _data(400, 50)
    found = sim.nearest_patterns(*_frames(spark, patterns, queries), max_broadcast_bytes=0, large="cells")
    assert written["visits"] == 50 and _rows(found) == _loop(patterns, queries, "l2")


def test_catalogue_is_sent_as_it_is_stored(spark):
    """Workers hold the vectors in their own type, and names without an object per pattern; what is sent gives the loop's answers."""
    rnd = np.random.default_rng(8)
    vectors = rnd.standard_normal((3000, 64)).astype(np.float32)
    rows = pd.DataFrame({
        "embedding": list(vectors), "pattern_id": [f"{i:012}" for i in range(3000)], "bug_type": [("injection", None)[i % 2] for i in range(3000)], "severity": None,
    })
    sent = sim._sent(rows, "array<float>")
    assert sent[0].dtype == np.float32 and sim._sent(rows, "array<double>")[0].dtype == np.float64
    assert len(pickle.dumps(sent, 5)) < 3000 * 300
    assert sim._sent(rows[:0], "array<float>")[0].shape == (0, 0) and sent[2][0].to_pylist() == rows["bug_type"].tolist()
    for metric in sim.METRICS:
        q = sim._unit(vectors[:300].astype(np.float64), metric)
        near, dist, _ = sim._top_k(q, sim._Rows(sent[0], metric), 5, metric, None)
        want = np.round(sim._distances(q, sim._unit(vectors.astype(np.float64), metric), metric), sim.DECIMALS)
        assert np.array_equal(near, np.argsort(want, axis=1, kind="stable")[:, :5]) and np.allclose(dist, np.sort(want, axis=1)[:, :5], atol=1e-9)
