"""Operator 11 against plain loops over whole numbers."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcpulse.llm import hard_negatives
from srcpulse.llm.heaps import Heaps
from srcpulse.llm.queries import QUERIES


@given(st.integers(1, 70), st.integers(1, 70), st.integers(1, 70), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_strassen_is_the_product(n, k, m, seed):
    r = np.random.default_rng(seed)
    a, b = r.integers(-(2**28), 2**28, (n, k)), r.integers(-(2**28), 2**28, (k, m))
    assert (hard_negatives.strassen(a, b, leaf=4) == a @ b).all()


def test_sums_between_may_wrap_but_products_may_not():
    big = np.array([[2**30, -(2**30)] * 3], np.int64)
    assert hard_negatives.products(big, big)[0, 0] == 6 * 2**60
    a = np.full((6, 6), 2**62)
    assert (hard_negatives.strassen(a, np.eye(6, dtype=np.int64), leaf=1) == a).all()  # a + a leaves 64 bits and comes back
    with pytest.raises(OverflowError):
        hard_negatives.products(np.full((1, 8), 2**31), np.full((1, 8), 2**31))


def test_heaps_keep_the_best_of_any_order():
    rnd = np.random.default_rng(5)
    key, ids, score = rnd.integers(0, 7, 3000), rnd.permutation(3000), rnd.integers(0, 9, 3000)
    heaps = Heaps(4)
    for part in np.array_split(np.arange(3000), 17):
        heaps.push(key[part], ids[part], score[part], np.zeros(len(part), np.int64))
        heaps.merged()
    got = sorted(zip(*(x.tolist() for x in heaps.merged()[:3]), strict=True))
    want = [(k, i, s) for k in range(7) for s, i in sorted(((-s, i) for kk, i, s in zip(key, ids, score, strict=True) if kk == k))[:4] for s in [-s]]
    assert got == sorted(want)


def brute(rows, modulus, k=5, low=(4, 5)):
    every = sorted({(i, label, tuple(math.floor(256 * x) for x in v)) for i, label, v in rows
                    if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for a, label, q in every:
        if a % modulus:
            continue
        scored = [(-sum(x * y for x, y in zip(q, p, strict=False)), i, other) for i, other, p in every if i != a]
        for score, positive, _ in sorted(x for x in scored if x[2] == label)[:k]:
            fits = [x for x in sorted(scored) if x[2] != label and low[0] * -score <= low[1] * -x[0] <= low[1] * -score]
            out += [(a, positive, rank + 1, i, -score, -s) for rank, (s, i, _) in enumerate(fits[:k])]
    return sorted(out)


def as_rows(frame):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in frame.collect())


def test_odd_rows_ties_and_small_tiles(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 0, 0, 1, 2]), [rnd.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(rnd.choice([3, 5]))]) for i in range(90)]
    rows += [(i, 0, [1.0, 1.0, 1.0]) for i in range(100, 130)] + [(i, 1, [1.0, 1.0, 0.99]) for i in range(130, 150)]  # groups of ties
    rows += [(200, None, [1.0]), (201, 1, None), (202, 1, [1.0, None]), (203, 1, [float("nan")]), (204, 1, [float("inf")]), (None, 1, [9.0])]
    rows += [(210, 1, []), (5, 1, [3.0, 3.0, 3.0]), rows[7], rows[7], (220, 7, [2.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, rank int, tile string")
    plain = [(i, label, v and [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    mined = hard_negatives.mine(df, F.col("id") % 10 == 0, anchor_rows=4, tile_rows=7)
    assert as_rows(mined) == brute(plain, 10)
    mined = hard_negatives.mine(df, F.col("id") % 10 == 0, positives=3, negatives=3, low=(1, 2))
    assert as_rows(mined) == brute(plain, 10, 3, (1, 2))
    assert hard_negatives.mine(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.mine(df, F.col("id") < 0).count() == 0
    assert hard_negatives.mine(df.where("vec_id = 220"), F.col("id") % 10 == 0).count() == 0


def test_query_over_the_small_table(spark, sf):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert as_rows(QUERIES["op11_hard_negatives"](spark, sf)) == brute(rows, 100)
