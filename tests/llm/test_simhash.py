"""Operator 4 against fingerprints by definition and all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from srcpulse.llm import simhash


def plain(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, bits=4):
    prints = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((str(d), f"{prints[i]:016x}", str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def as_rows(frame):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in frame.collect())


def test_small_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert as_rows(simhash.near_groups(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_nulls_copies_and_extra_columns(spark):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 4) for _ in range(60)) for _ in range(6)]
    rows = [(i, rnd.choice(base) + f" {rnd.choice('xyz')}" * (i % 3)) for i in range(60)]
    rows += [(200 + i, base[0]) for i in range(30)] + [(90, None), (91, ""), (92, " \n"), (None, base[0]), (None, "alone Here"), (93, "A b"), (93, "a B")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, root long")
    assert as_rows(simhash.near_groups(docs)) == brute(rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = simhash.near_groups(docs).select("root").distinct().count()
    assert kept.select("doc_id", "text").distinct().count() == groups
    assert simhash.near_groups(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("shard_rows", "first_masks"), [(10**6, None), (40, None), (40, 4)])
def test_links_of_a_hot_shard(spark, shard_rows, first_masks):
    """All fingerprints agree on the first 40 bits, so many shards hold them all; vantage halves, blocks and waves must lose no link."""
    rnd = np.random.default_rng(2)
    values = np.unique(rnd.integers(0, 2**24, 700, np.uint64))
    prints = spark.createDataFrame([(v,) for v in simhash._as_bytes(values[:, None])], "fp binary").repartition(3)
    number = {bytes(r.fp): r.root for r in simhash._print_roots(prints, 64, 4, None, shard_rows, first_masks).collect()}
    forest = simhash.Forest(len(values))
    for i, v in enumerate(values):
        close = np.flatnonzero(np.bitwise_count(values ^ v) <= 4)
        forest.link(close, np.full(len(close), i))
    groups = lambda of: {frozenset(i for i, r in enumerate(of) if r == one) for one in set(of)}
    assert groups([number[v] for v in simhash._as_bytes(values[:, None])]) == groups(forest.roots().tolist())


def test_trees_are_entered_and_blocks_meet(spark):
    """Shards of more members than a leaf holds, cut into pairs of blocks where halves cannot shrink them."""
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**63, 8).astype(np.uint64)
    flips = np.packbits(rnd.random((400, 512)) < 0.04, axis=1).view(">u8").astype(np.uint64)
    values = np.concatenate([base ^ flips, rnd.integers(0, 2**63, (50, 8)).astype(np.uint64)])
    prints = spark.createDataFrame([(v,) for v in simhash._as_bytes(values)], "fp binary").repartition(3)
    masks = simhash.sampled_masks(512, 24, 6)
    forest = simhash.Forest(len(values))
    for mask in masks:  # what the masks let meet, pair by pair
        bits = np.unpackbits(np.array([list(x) for x in simhash._as_bytes(values)], np.uint8), axis=1)[:, mask]
        for i in range(len(values)):
            close = np.flatnonzero((bits == bits[i]).all(axis=1) & (np.bitwise_count(values ^ values[i]).sum(axis=1) <= 40))
            forest.link(close, np.full(len(close), i))
    groups = lambda of: {frozenset(i for i, r in enumerate(of) if r == one) for one in set(of)}
    assert max(map(len, groups(forest.roots().tolist()))) > 2 * simhash.LEAF
    for shard_rows, first_masks in ((10**6, None), (30, None), (30, 5)):
        number = {bytes(r.fp): r.root for r in simhash._print_roots(prints, 512, 40, masks, shard_rows, first_masks).collect()}
        assert groups([number[v] for v in simhash._as_bytes(values)]) == groups(forest.roots().tolist())


def test_blocks_and_longer_fingerprints():
    assert len(simhash.block_masks(64, 4, 6)) == 15
    hashes = [[3, 2**63, 5], [], list(range(1000))]
    wide = simhash.majorities(hashes, 256)
    assert wide.shape == (3, 4) and wide[0, 0] == 1 and not wide[1].any()
    assert (wide[:, :1] == simhash.majorities(hashes, 64)).all()


def test_every_shard_has_a_tree(monkeypatch):
    """Runs of two to 40 members, all below the old leaf: links as by all pairs, and fewer distances where much is alike."""
    rnd = np.random.default_rng(5)
    sizes = rnd.integers(1, 41, 60)
    n = int(sizes.sum())
    base = rnd.integers(0, 2**63, (12, 8)).astype(np.uint64)
    flips = np.packbits(rnd.random((n, 512)) < 0.07, axis=1).view(">u8").astype(np.uint64)
    prints = base[rnd.integers(0, 12, n)] ^ flips
    for entries in (simhash.ENTRIES, 30):
        monkeypatch.setattr(simhash, "ENTRIES", entries)
        forest, plain_ = simhash.Forest(n), simhash.Forest(n)
        measured = simhash.vantage_links(prints, sizes, 110, forest, np.random.default_rng(0))
        for a, m in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
            for i in range(a, a + m):
                close = a + np.flatnonzero(np.bitwise_count(prints[a : a + m] ^ prints[i]).sum(axis=1) <= 110)
                plain_.link(close, np.full(len(close), i))
        assert (forest.roots() == plain_.roots()).all() and len(set(forest.roots())) < n
        assert measured < 0.8 * (sizes * (sizes - 1) // 2).sum()


def test_hot_shards_of_wide_bounds_are_halved(spark):
    """Two kinds of fingerprints under one key: a vantage point of the shard's own tells them apart, at 128 of 512 bits as well."""
    rnd = np.random.default_rng(6)
    base = rnd.integers(0, 2**63, (2, 8)).astype(np.uint64)
    base[1] = ~base[0]
    flips = np.packbits(rnd.random((300, 512)) < 0.05, axis=1).view(">u8").astype(np.uint64)
    values = np.concatenate([base[i % 2] ^ flips[i : i + 1] for i in range(300)])
    rows = [(0, 7, i, fp) for i, fp in enumerate(simhash._as_bytes(values))]
    keyed = spark.createDataFrame(rows, "shard int, key long, node long, fp binary").repartition(3)
    halves = simhash._halved(keyed, 128, 200).collect()
    parts = {p: {r.node % 2 for r in halves if r.part == p} for p in {r.part for r in halves}}
    assert len(halves) == 300 and len(parts) == 2 and all(len(kinds) == 1 for kinds in parts.values())
    links = simhash._links(simhash._dealt(simhash._halved(keyed, 128, 200), 200), 128)
    forest = simhash.Forest(300)
    u, v = zip(*((r.u, r.v) for r in links.collect()), strict=True)
    forest.link(np.array(u), np.array(v))
    assert forest.roots().tolist() == [i % 2 for i in range(300)]
