"""The pipeline's near-duplicate stage against shingle sets and all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest

from srcpulse.llm import simhash


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id for r in corpus_pipeline.no_near_copies(spark, docs, "").collect()}


def test_repeated_lines_count_once(spark):
    rnd = random.Random(3)
    words = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    line, own = words(13), [words(200) for _ in range(3)]
    texts = [" ".join(own[0] + 40 * line), " ".join(own[1] + 40 * line), " ".join(own[2] + 2 * line), " ".join(own[2] + 40 * line)]
    assert kept(spark, texts) == {0, 1, 2}


def test_only_texts_that_are_alike_go(spark):
    """Pairs of 200 shingles with 178 or 172 in common (0.80, 0.75), and a chain of small sets."""
    rnd = random.Random(4)
    words = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts, want = [], set()
    for i in range(120):
        base = words(204)
        texts += [" ".join(base), " ".join(base[: 182 if i % 2 else 176] + words(22 if i % 2 else 28))]
        want |= {2 * i} if i % 2 else {2 * i, 2 * i + 1}
    small = words(9)  # five shingles, of which a text without the last word has four
    texts += [" ".join(small), " ".join(small[:8]), " ".join(small[:7]), None, "", " "]
    n = len(texts)
    assert kept(spark, texts) == want | {n - 6, n - 4, n - 3}


def test_blocks_of_a_large_group_lose_no_link(spark):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(150):
        x = list(base)
        for at in rnd.sample(range(100), 2):
            x[at] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(x))
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    root = list(range(150))
    for i in range(150):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    options = {"least": 0.8, "shingle": 5, "bits": 512, "max_bits": 200, "masks": corpus_pipeline.MASKS}
    for more in ({}, {"block_sets": 20}, {"block_shingles": 2000}):
        assert {r.doc_id for r in simhash.one_of_each(docs, **options, **more).collect()} == set(root)
    assert simhash.one_of_each(docs.limit(0), **options).count() == 0


def groups_of(sets, least):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return set(root)


def test_similar_texts_with_far_fingerprints_go(spark):
    """Five shingles against four of them are 0.8 alike; the fingerprints of these pairs differ in more than the 128 bits that name candidates."""
    rnd = random.Random(6)
    texts = []
    while len(texts) < 6:
        words = [f"w{rnd.randrange(10**9)}" for _ in range(9)]
        pair = " ".join(words), " ".join(words[:8])
        a, b = simhash.majorities([sorted(set(simhash.shingle_hashes(t, 5, 42))) for t in pair], 512)
        if np.bitwise_count(a ^ b).sum() > corpus_pipeline.MOST_BITS:
            texts += pair
    assert kept(spark, texts) == {0, 2, 4}


@pytest.mark.parametrize(("least", "max_bits", "hot_sets"), [(0.8, 0, 3), (0.5, 0, 3)])
def test_links_do_not_hang_on_bounds(spark, least, max_bits, hot_sets):
    """Short and long texts, a third with one common line, edited here and there: groups as by all pairs, even where fingerprints link nothing."""
    rnd = random.Random(7)
    line, texts = [f"l{i}" for i in range(14)], []
    for i in range(60):
        base = [f"w{rnd.randrange(10**9)}" for _ in range(rnd.choice([5, 7, 9, 14, 30, 80, 160]))]
        for _ in range(rnd.randrange(1, 5)):
            x = list(base)
            for at in rnd.sample(range(len(x)), min(len(x), rnd.choice([0, 0, 1, 2, 3, 4]))):
                x[at] = f"x{rnd.randrange(10**9)}"
            x = x[rnd.choice([0, 0, 1, 2]) :]
            texts.append(" ".join(x + line if i % 3 == 0 else x))
    hashes = [set(simhash.shingle_hashes(t, 5, 42)) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = simhash.one_of_each(docs, least=least, shingle=5, bits=512, max_bits=max_bits, hot_sets=hot_sets, block_sets=20)
    assert {r.doc_id for r in found.collect()} == groups_of(hashes, least)
