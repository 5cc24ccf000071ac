"""Operator 12: exact counts and base scores, the filter's promises, and scores recomputed from plain counts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcpulse.llm import language_model as lm
from srcpulse.llm.queries import QUERIES


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def held_out(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 5 == 1


def plain_base(train, text):
    n, v = sum(train.values()), len(train)
    return sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(text))


def level_mean(c, base):
    """The mean of the counts that share the level of `c`."""
    if not c:
        return 0.0
    bounds = [1]
    while bounds[-1] <= c:
        bounds.append(max(bounds[-1] + 1, math.ceil(base ** len(bounds))))
    return (bounds[-2] + bounds[-1] - 1) / 2


def plain_score(counts, text, shape):
    """Interpolated log10 probability from dictionaries of n-gram counts by order."""
    seq = [b"", *tokens(text)]
    q = lambda gram: level_mean(counts[len(gram)][gram], shape.base)
    n, v = sum(counts[1].values()), len(counts[1])
    total = 0.0
    for i in range(1, len(seq)):
        p = (q((seq[i],)) + 0.5) / (n + 0.5 * (v + 1))
        for k in range(1, min(shape.order, i + 1)):
            context = tuple(seq[i - k : i])
            p = (q((*context, seq[i])) + shape.mu * p) / (q(context) + shape.mu)
        total += math.log10(p)
    return total


def plain_counts(texts, order):
    counts = {k: Counter() for k in range(1, order + 1)}
    for text in texts:
        seq = [b"", *tokens(text)]
        for k in counts:
            counts[k].update(tuple(seq[i : i + k]) for i in range(1 if k == 1 else 0, len(seq) - k + 1))
    return counts


def test_levels_and_their_means():
    counts = np.arange(1, 5000)
    for base in (2.0, 1.3, 10.0):
        levels = lm.levels_of(counts, base)
        assert levels[0] == 1 and (np.diff(levels.astype(int)) >= 0).all()
        assert np.allclose(lm.level_means(base)[levels], [level_mean(int(c), base) for c in counts])
    assert lm.levels_of(np.array([7, 8, 9]), 2.0).tolist() == [3, 4, 4]


def test_filter_never_misses_and_seldom_adds():
    rnd = np.random.default_rng(1)
    keys = rnd.integers(0, 2**63, 20_000).astype(np.uint64)
    levels = rnd.integers(1, 6, len(keys)).astype(np.uint8)
    bits = 8 * (int(levels.sum()) * 10 // 8)
    raw = lm.filled(keys, levels, bits, 6)
    found = lm.probed(keys, np.zeros(len(keys), np.int64), raw, bits, 6)
    assert (found >= levels).all() and (found > levels).mean() < 0.02
    strange = lm.probed(rnd.integers(0, 2**63, 50_000).astype(np.uint64), np.zeros(50_000, np.int64), raw, bits, 6)
    assert (strange > 0).mean() < 0.02


ROWS = [
    (1, "The cat sat"), (2, "the cat sat on the mat"), (3, None), (4, ""), (5, " \t\n\x0b\x0c\r "), (6, "The cat sat on"), (None, "the dog"), (6, "The cat sat on"),
    (6, "another text of one id"), (8, "É é \x1c x\x85y"), (9, "long " * 20_000), (10, "the cat sat"), (13, "zebra never seen " * 3), (17, "rare one"),
]


@pytest.mark.parametrize("order", [1, 3])
def test_scores_against_plain_counts(spark, order):
    shape = lm.Shape(order=order, bits_per_entry=200, probes=12, mu=7.0)  # so wide that nothing is taken for present
    docs = spark.createDataFrame([(*r, 1, b"x") for r in ROWS], "doc_id long, text string, c long, word binary")
    train = ~F.coalesce(F.col("doc_id") == 13, F.lit(False))
    model = lm.fit(docs, train, shape=shape, part_grams=50)
    texts = [t for d, t in ROWS if d != 13]
    counts = plain_counts(texts, order)
    words = Counter({k[0]: v for k, v in counts[1].items()})
    assert {bytes(r.word): r.c for r in model.words.collect() if r.c} == dict(words)
    want = sorted(((d, len(tokens(t)), sum(words[x] > 0 for x in tokens(t)), sum(words.values()), plain_base(words, t), plain_score(counts, t, shape)) for d, t in ROWS), key=str)
    for options in ({}, {"frequent": 3}, {"broadcast_bytes": 0, "frequent": 0, "chunk_tokens": 6}):
        got = lm.score(docs, model, **options)
        assert got.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        got = sorted((tuple(r) for r in got.collect()), key=str)
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for options in ({}, {"broadcast_bytes": 0}):
        got = lm.score(docs, lm.fit(docs, F.lit(False)), **options).collect()
        assert len(got) == len(ROWS) and all(r.train_tokens == r.n_known == r.base_score == 0 and abs(r.score) < 1e-9 for r in got)
        assert lm.score(docs.limit(0), lm.fit(docs.limit(0), F.lit(True)), **options).count() == 0


def test_query_over_the_small_corpus(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    train = Counter(t for d, x in docs if not held_out(d) for t in tokens(x))
    got = {r.doc_id: r for r in QUERIES["op12_language_model"](spark, sf).collect()}
    assert len(got) == len(docs)
    for d, x in docs:
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(d), len(tokens(x)), sum(train[t] > 0 for t in tokens(x)), sum(train.values()))
        assert math.isclose(r.base_score, plain_base(train, x), rel_tol=1e-9)
    unseen = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)  # context tells something about unseen texts
