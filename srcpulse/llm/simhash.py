"""Operator 4: SimHash near-duplicates, linked through vantage-point trees.

A fingerprint bit is 1 where more than half of a text's shingle hashes have it. Distinct fingerprints are dealt to
shards so that any two within `max_bits` meet: with `blocks` blocks of bits, two of them differ in at most `max_bits`
blocks, so they agree in `blocks - max_bits` whole ones, and each choice of that many blocks is a shard key. (Longer
fingerprints with wide bounds use sampled bit positions instead, see `sampled_masks`; those find nearly all pairs.)
A shard over `shard_rows` is split on by vantage points of its own: the far half lies beyond a radius and the near half
reaches `max_bits` over it, so every linked pair still shares a half. Where no radius makes a shard smaller (unrelated fingerprints
under a wide bound, or much that is equal), what stays large is cut into blocks and searched in pairs of blocks, so a task
never holds more than two. Within every shard of two or more a vantage-point tree finds the links, whatever its size: branches
are pruned by the triangle inequality, and what lies within the bound of a vantage point is one component, whose members
need not meet. Vantage points alone would not do as shards: distances of unrelated 64-bit fingerprints lie within 32 +- 4,
and a band of +- 4 keeps more than half of them.

A shard gives a forest of its links, at most one link per member; links of all shards are joined to components by
alternating star steps over written tables. Many masks come in two waves, and the second tells links between groups of the
first only. Nothing is collected.

`one_of_each` can ask for an exact similarity of shingle sets. Then shards are sets with a window of two neighbouring shingle
hashes in common, which no similar pair lacks, and links of fingerprints in them name candidates. The sets of texts that have a
candidate are compared within the candidates' groups, and groups over a task's measure in pairs of blocks. Other sets that share as many
windows as similar ones must are compared too, however far their fingerprints are, so no link is lost.

Null and empty texts have fingerprint zero. Rows with a null doc_id belong to components, but name one only as null if
there is no other row in it. Repeated rows are all returned. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcpulse.llm.common import texts, written

#: One byte lane for each of eight bits.
LANES = np.uint64(0x0101010101010101)
#: Levels of halves that hot shards are split into at most; a part's number stays below 2 to one more.
HALVINGS = 8
#: Rows a task gathers before it looks for runs of a shard key.
GATHERED = 200_000
#: Points and queries of tree nodes that a task works on together, and distances that it measures at once.
ENTRIES, DISTANCES = 100_000, 8_192
#: Runs above this had a tree before, the others none. Trees have no such leaf now; tests name runs by it.
LEAF = 48
#: Links that a forest keeps waiting.
FLUSHED = 1_000_000
BROADCAST_ROWS = 500_000
#: Similarity from which sets are found by windows of two values, below by single ones.
WINDOWS_FROM = 0.7
#: A window of more sets than this is met only by sets that have too few others.
HOT = 64
#: Shingle sets compared in one task: so many sets and shingles are a block.
BLOCK_SETS, BLOCK_SHINGLES = 4_096, 1_000_000


def shingle_hashes(text: str, shingle: int, seed: int) -> list[int]:
    words = text.encode().lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, seed)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    return list(map(xxhash.xxh64_intdigest, [line[a:b] for a, b in zip(starts, ends, strict=True)], repeat(seed)))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash made of h; the first is h itself."""
    if not k:
        return h
    h = h + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majorities(hashes: list[list[int]], bits: int) -> np.ndarray:
    """Fingerprints of lists of hashes, as rows of `bits / 64` words, most significant first."""
    sizes = np.array([len(x) for x in hashes], np.int64)
    out = np.zeros((len(hashes), bits // 64), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    flat = np.array([h for x in hashes for h in x], np.uint64)
    # Bytes hold counts up to 255, so texts are counted in chunks of 255 hashes.
    firsts = np.concatenate([[0], np.cumsum(sizes[some])])
    chunks = np.concatenate([np.arange(a, b, 255) for a, b in zip(firsts, firsts[1:], strict=False)])
    of_text = np.concatenate([[0], np.cumsum(-(-sizes[some] // 255))[:-1]])
    for k in range(bits // 64):
        h = _mixed(flat, k)
        lanes = np.stack([np.add.reduceat(h >> np.uint64(b) & LANES, chunks) for b in range(8)], axis=1)
        counts = np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 8, 8).astype(np.int64)  # chunk, bit, byte
        counts = np.add.reduceat(counts, of_text, axis=0).transpose(0, 2, 1).reshape(-1, 64)
        set_ = 2 * counts > sizes[some, None]
        out[some, k] = np.packbits(set_, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _as_bytes(prints: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(prints.astype(">u8")).tobytes()
    n = 8 * prints.shape[1]
    return [raw[i : i + n] for i in range(0, len(raw), n)]


def _from_bytes(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), ">u8").reshape(len(values), -1).astype(np.uint64)


def common_windows(hashes: list[int], least: float) -> tuple[np.ndarray, int]:
    """Hashes of a set, and how many of them any other set with a Jaccard similarity of `least` or more has too (or as many as the
    other has to spare, if that is less).

    A window is two neighbours of the set in ascending order. A value that only one of two sets has breaks two windows of its own
    set at most, or one of the other, so a set of n loses 2 (1 - least) n windows at most to a set that similar. In an order that all
    sets share (by hash), the k-th window that both have is therefore among the first 2 (1 - least) n + k of each. Below
    `WINDOWS_FROM` too few windows would be left, and single values do the same with (1 - least) n + k."""
    values = np.unique(np.array(hashes, np.uint64))
    broken, windows = (1 - least) * len(values), _mixed(values, 1)
    if least >= WINDOWS_FROM:
        broken, windows = 2 * broken, _mixed(_mixed(values[:-1], 1) + values[1:], 2)
    most = int(broken + 1e-9) + 2 + len(values) // 10
    windows = np.partition(windows, most - 1)[:most] if len(windows) > most else windows
    return windows, len(windows) - int(broken + 1e-9)


def fingerprints(
    docs: DataFrame, *, id_col: str, text_col: str, shingle: int, bits: int, seed: int = 42, distinct: bool = False, least: float = 1.0
) -> DataFrame:
    """doc_id, text_hash, fp (binary) of every row. With `distinct` a text's repeated shingles count once, and set_id, node, n,
    windows and spare name its set of shingles, give the set's size and what it has in common with sets of a similarity of `least`."""

    def hashes(text: str) -> list[int]:
        found = shingle_hashes(text, shingle, seed)
        return sorted(set(found)) if distinct else found

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashes(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(_as_bytes(majorities(found, bits)), pa.binary())]
            if distinct:
                set_ids = [xxhash.xxh3_128_digest(np.array(x, np.uint64).tobytes()) for x in found]
                nodes = np.frombuffer(b"".join(set_ids), np.int64)[::2]
                windows, spare = zip(*(common_windows(x, least) for x in found), strict=True) if found else ((), ())
                columns += [pa.array(set_ids, pa.binary()), pa.array(nodes), pa.array(list(map(len, found)), pa.int64())]
                columns += [pa.array([x.view(np.int64) for x in windows], pa.list_(pa.int64())), pa.array(spare, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp", "set_id", "node", "n", "windows", "spare"][: len(columns)])

    rows = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(make, "doc_id long, text_hash long, fp binary" + (", set_id binary, node long, n long, windows array<long>, spare long" if distinct else ""))


def block_masks(bits: int, max_bits: int, blocks: int) -> list[list[int]]:
    """Bit positions of each choice of `blocks - max_bits` blocks: two fingerprints within `max_bits` agree on one choice."""
    if blocks <= max_bits:
        raise ValueError("more blocks than differing bits are needed")
    parts = [p.tolist() for p in np.array_split(np.arange(bits), blocks)]
    return [sorted(sum(c, [])) for c in combinations(parts, blocks - max_bits)]


def sampled_masks(bits: int, masks: int, size: int, seed: int = 7) -> list[list[int]]:
    """`masks` samples of `size` bit positions. Two fingerprints with a share p of differing bits agree on at least one
    with probability about 1 - (1 - (1 - p) ** size) ** masks."""
    rnd = np.random.default_rng(seed)
    return [sorted(rnd.choice(bits, size, replace=False).tolist()) for _ in range(masks)]


def _keyed(prints: DataFrame, masks: list[list[int]]) -> DataFrame:
    """shard, key, node, fp: a row for each of (node, fp) and mask."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("fp").to_pylist()
            bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), axis=1)
            for shard, mask in enumerate(masks):
                wide = np.zeros((len(raw), 64), np.uint8)
                wide[:, : len(mask)] = bits[:, mask]
                keys = np.packbits(wide, axis=1).view(">i8")[:, 0].astype(np.int64)
                columns = [pa.array(np.full(len(raw), shard, np.int32)), pa.array(keys), batch.column("node"), batch.column("fp")]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "key", "node", "fp"])

    # Fingerprints are small and their keys many: all tasks make keys, however few bytes the fingerprints have.
    dealt = prints.select("node", "fp").repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    return dealt.mapInArrow(key, "shard int, key long, node long, fp binary")


def _halved(keyed: DataFrame, max_bits: int, shard_rows: int) -> DataFrame:
    """Shards over `shard_rows`, split by vantage points into halves that overlap; `part` names the halves.

    A shard's vantage point is one of its own fingerprints, and its radius the one that leaves the larger half least. The
    outer half lies beyond the radius and the inner one within `max_bits` more, so a linked pair shares a half. Shards that no radius
    makes smaller by a tenth try another vantage point, as long as any shard of the level gets smaller."""
    names = ["shard", "key", "part"]
    keyed = keyed.withColumn("part", F.lit(1).cast("long"))
    done = None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _distance(_from_bytes(batch.column("fp")), _from_bytes(batch.column("vantage"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.select([*names, "node", "fp"]).columns, pa.array(far, pa.int64())], [*names, "node", "fp", "far"])

    for level in range(HALVINGS):
        hot = written(keyed.groupBy(*names).agg(F.count("*").alias("rows")).where(F.col("rows") > shard_rows), "simhash-hot")
        if hot.isEmpty():
            break
        # There is at most one hot shard per `shard_rows` rows, so what is told of them is small.
        vantage = F.min_by("fp", F.xxhash64("fp", F.lit(level))).alias("vantage")
        vantages = written(keyed.join(F.broadcast(hot.select(*names)), names).groupBy(*names).agg(vantage), "simhash-vantages")
        measured = keyed.join(F.broadcast(vantages), names).select(*names, "node", "fp", "vantage")
        measured = written(measured.mapInArrow(measure, "shard int, key long, part long, node long, fp binary, far long"), "simhash-far")
        by_far = Window.partitionBy(*names).orderBy("far")
        inner = F.sum("n").over(by_far.rangeBetween(Window.unboundedPreceding, max_bits))
        outer = F.sum("n").over(by_far.rangeBetween(1, Window.unboundedFollowing))
        halves = measured.groupBy(*names, "far").agg(F.count("*").alias("n")).select(*names, "far", F.greatest(inner, F.coalesce(outer, F.lit(0))).alias("larger"))
        radius = halves.groupBy(*names).agg(F.min(F.struct("larger", "far")).alias("best")).join(hot, names).where("best.larger <= 0.9 * rows")
        radius = written(radius.select(*names, F.col("best.far").alias("radius")), "simhash-radius")
        if radius.isEmpty():
            break
        cold = keyed.join(F.broadcast(hot.select(*names)), names, "left_anti")
        done = cold if done is None else done.unionByName(cold)
        split = measured.join(F.broadcast(radius), names, "left")
        half = F.when(F.col("radius").isNull(), F.array("part")).otherwise(
            F.filter(
                F.array(F.when(F.col("far") <= F.col("radius") + max_bits, 2 * F.col("part")), F.when(F.col("far") > F.col("radius"), 2 * F.col("part") + 1)),
                lambda x: x.isNotNull(),
            )
        )
        keyed = split.select("shard", "key", F.explode(half).alias("part"), "node", "fp").select("shard", "key", "node", "fp", "part")
    return keyed if done is None else done.unionByName(keyed)


def _dealt(keyed: DataFrame, shard_rows: int) -> DataFrame:
    """low, high: what is still over twice `shard_rows` is cut into blocks, and each pair of blocks is a run of its own, so
    no task holds more than two blocks and any two members meet. All else is the one pair (0, 0)."""
    names = ["shard", "key", "part"]
    hot = keyed.groupBy(*names).count().where(F.col("count") > 2 * shard_rows)
    hot = written(hot.select(*names, F.ceil(F.col("count") / shard_rows).cast("int").alias("blocks")), "simhash-blocks")
    whole = [F.lit(0).alias("low"), F.lit(0).alias("high")]
    if hot.isEmpty():
        return keyed.select("*", *whole)
    cold = keyed.join(hot.select(*names), names, "left_anti").select("*", *whole)
    own = keyed.join(hot, names).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cold.unionByName(other.select(*keyed.columns, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")))


def _distance(prints: np.ndarray, other: np.ndarray) -> np.ndarray:
    counts = np.bitwise_count(prints ^ other)
    if counts.shape[-1] != 8:
        return counts.sum(axis=-1, dtype=np.int64)
    # Eight counts of up to 64 are the bytes of one word: added as pairs, then all four.
    wide = np.ascontiguousarray(counts).view(np.uint64)[..., 0]
    wide = (wide & np.uint64(0x00FF00FF00FF00FF)) + (wide >> np.uint64(8) & np.uint64(0x00FF00FF00FF00FF))
    return (wide * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int64)


class Forest:
    """Components of numbered things; links are given as arrays and worked off many at a time."""

    def __init__(self, n: int) -> None:
        self._root = np.arange(n)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self._waiting.append((a, b))
        self._n += len(a)
        if self._n >= FLUSHED:
            self.roots()

    def roots(self) -> np.ndarray:
        """The least member of each thing's component."""
        if not self._n:
            return self._root
        a, b = (np.concatenate(x) for x in zip(*self._waiting, strict=True))
        self._waiting, self._n = [], 0
        while True:
            x, y = self._root[a], self._root[b]
            open_ = x != y
            if not open_.any():
                return self._root
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self._root, np.maximum(x, y), np.minimum(x, y))
            while ((up := self._root[self._root]) != self._root).any():
                self._root = up


def _pieces(n: int) -> list[slice]:
    return [slice(a, a + DISTANCES) for a in range(0, n, DISTANCES)]


def _far(prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), np.int64)
    for some in _pieces(len(a)):
        out[some] = _distance(prints.take(a[some], axis=0), prints.take(b[some], axis=0))
    return out


def _cuts(node: np.ndarray, far: np.ndarray, n_nodes: int) -> np.ndarray:
    """Which of the points, sorted by (node, far), are outer: a node is cut at the widest gap in the middle half of its ranks."""
    sizes = np.bincount(node, minlength=n_nodes)
    first = np.cumsum(sizes) - sizes
    rank = np.arange(len(node)) - first[node]
    gap = np.zeros(len(node), np.int64)
    gap[1:] = far[1:] - far[:-1]
    middle = (4 * rank >= sizes[node]) & (4 * rank <= 3 * sizes[node]) & (rank > 0)
    best = np.full(n_nodes, -1, np.int64)
    off_middle = np.abs(2 * rank - sizes[node])
    value = np.where(middle, (gap << 23) + (1 << 22) - np.minimum(off_middle, (1 << 22) - 1), -1)
    filled = np.flatnonzero(sizes)
    if len(filled):
        best[filled] = np.maximum.reduceat(value, first[filled])
    cut = np.where(value == best[node], rank, len(node))
    at = np.full(n_nodes, len(node), np.int64)
    np.minimum.at(at, node, np.where(value >= 0, cut, len(node)))
    return rank >= at[node]


def vantage_links(prints: np.ndarray, sizes: np.ndarray, max_bits: int, forest: Forest, rnd: np.random.Generator) -> int:
    """Unite all members within `max_bits` of each other in each of the runs that `prints` holds one after the other: a
    vantage-point tree per run, all trees level by level. Returns how many distances were measured.

    A node's vantage point meets all its points and queries. Points within the bound are linked by that alone: they become
    a child that is one component, whose points need not meet. The others are cut in two shells. Members of a later child
    are queries to the earlier ones, so a pair meets once at most, and a query goes to a child only where the triangle
    inequality lets a point of it be within the bound."""
    node = np.repeat(np.arange(len(sizes)), sizes)
    points = np.arange(len(prints))
    waiting = [(node, points, np.zeros(len(sizes), bool), node[:0], points[:0])]
    measured = 0
    while waiting:
        # Nodes, their points, whether a node is one component, and queries from outside of it.
        node, points, one, of, queries = waiting.pop()
        n = len(one)
        wanted = (np.bincount(node, minlength=n) > 1) & ~one | (np.bincount(of, minlength=n) > 0) & (np.bincount(node, minlength=n) > 0)
        if not wanted.all():
            number = np.cumsum(wanted) - 1
            keep, asked = wanted[node], wanted[of]
            node, points, of, queries, one = number[node[keep]], points[keep], number[of[asked]], queries[asked], one[wanted]
            n = len(one)
        if not n:
            continue
        entries = np.bincount(node, minlength=n) + np.bincount(of, minlength=n)
        if n > 1 and entries.sum() > ENTRIES:
            part = np.cumsum(entries) // ENTRIES
            for p in np.unique(part):
                own = part == p
                number = np.cumsum(own) - 1
                keep, asked = own[node], own[of]
                waiting.append((number[node[keep]], points[keep], one[own], number[of[asked]], queries[asked]))
            if len(np.unique(part)) > 1:
                continue
            node, points, one, of, queries = waiting.pop()
        order = np.argsort(node, kind="stable")
        node, points = node[order], points[order]
        sizes = np.bincount(node, minlength=n)
        picked = np.cumsum(sizes) - sizes + rnd.integers(0, sizes)
        vantage = points[picked]
        node, points = np.delete(node, picked), np.delete(points, picked)
        far, asked = _far(prints, points, vantage[node]), _far(prints, queries, vantage[of])
        measured += len(far) + len(asked)
        close = (far <= max_bits) & ~one[node]
        forest.link(points[close], vantage[node[close]])
        found = asked <= max_bits
        forest.link(queries[found], vantage[of[found]])
        # Children of a node: 3 * node is the component around the vantage point, then the two shells.
        child = 3 * node
        rest = np.flatnonzero(~close)
        rest = rest[np.lexsort((far[rest], node[rest]))]
        child[rest] += 1 + _cuts(node[rest], far[rest], n)
        least, most = np.full(3 * n, np.iinfo(np.int64).max // 2), np.full(3 * n, -1)
        np.minimum.at(least, child, far)
        np.maximum.at(most, child, far)
        going = ~found | ~one[of]  # a query that meets a component is done with it
        of, queries, asked, found = of[going], queries[going], asked[going], found[going]
        inside = ~one[node]
        to = [3 * of[~found], 3 * of + 1, 3 * of + 2, 3 * node[inside & (child % 3 > 0)], (3 * node + 1)[inside & (child % 3 == 2)]]
        who = [queries[~found], queries, queries, points[inside & (child % 3 > 0)], points[inside & (child % 3 == 2)]]
        at = [asked[~found], asked, asked, far[inside & (child % 3 > 0)], far[inside & (child % 3 == 2)]]
        to, who, at = np.concatenate(to), np.concatenate(who), np.concatenate(at)
        near = (at >= least[to] - max_bits) & (at <= most[to] + max_bits)
        joined = np.repeat(one, 3)
        joined[::3] = True
        waiting.append((child, points, joined, to[near], who[near]))
    return measured


def _links(keyed: DataFrame, max_bits: int) -> DataFrame:
    """u > v: a forest of the links of each shard, between different nodes. Rows of one node are linked already."""
    names = ["shard", "key", "part", "low", "high"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([table.column(n).to_numpy() for n in names], axis=1).astype(np.int64)
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cuts = np.concatenate([[0], new, [len(keys)]]) if last else np.concatenate([[0], new])
            rest = [] if last else table.slice(int(cuts[-1])).to_batches()
            n = int(cuts[-1])
            if n < 2:
                return None, rest
            prints, forest = _from_bytes(table.column("fp").slice(0, n).combine_chunks()), Forest(n)
            node = table.column("node").slice(0, n).to_numpy()
            sizes, rnd = np.diff(cuts)[: np.searchsorted(cuts, n)], np.random.default_rng(0)
            vantage_links(prints, sizes, max_bits, forest, rnd)
            # What a row is linked to is told as its node and the node of its root; equal nodes are no news.
            u, v = node, node[forest.roots()]
            pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1)[u != v], axis=0)
            if not len(pairs):
                return None, rest
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"]), rest

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= GATHERED:
                out, held = found(False)
                rows = 0  # a run that goes on is looked at again after as many more rows
                if out is not None:
                    yield out
        if held and sum(b.num_rows for b in held):
            out, held = found(True)
            if out is not None:
                yield out

    dealt = keyed.repartition(*names).sortWithinPartitions(*names, "fp")
    return dealt.mapInArrow(link, "u long, v long").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """u, root: every linked node but the roots, by alternating large and small stars (roots are least nodes)."""
    links, seen = written(links.where("u > v"), "simhash-links"), None
    for _ in range(rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "simhash-stars")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.select("u", F.col("v").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")


def _print_roots(prints: DataFrame, bits: int, max_bits: int, masks: list[list[int]] | None, shard_rows: int, first_masks: int | None = None) -> DataFrame:
    """fp, root (a number) of all distinct fingerprints, those linked within `max_bits` under one root.

    With `first_masks` the masks come in two waves: the nodes of the second are the groups that the first has found, so a
    large group, which meets itself under nearly every mask, gives links to other groups only."""
    masks = masks or block_masks(bits, max_bits, max_bits + 2)
    nodes = written(prints.select("fp", F.monotonically_increasing_id().alias("node")), "simhash-nodes")
    cuts = [0, first_masks, len(masks)] if first_masks and first_masks < len(masks) else [0, len(masks)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        keyed = _dealt(_halved(_keyed(nodes, masks[a:b]), max_bits, shard_rows), shard_rows)
        roots = components(_links(keyed, max_bits))
        roots = F.broadcast(roots) if roots.count() <= BROADCAST_ROWS else roots
        joined = nodes.join(roots, nodes["node"] == roots["u"], "left")
        nodes = written(joined.select("fp", F.coalesce("root", "node").alias("node")), "simhash-nodes")
    return nodes.withColumnRenamed("node", "root")


def near_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 64, max_bits: int = 4,
    masks: list[list[int]] | None = None, shard_rows: int = 200_000, first_masks: int | None = None,
) -> DataFrame:
    """doc_id, text_hash, fingerprint (hex), component_id (least doc_id reachable), root (a component's name) of every row."""
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, bits=bits), "simhash-prints")
    by_print = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = by_print.join(_print_roots(by_print.select("fp"), bits, max_bits, masks, shard_rows, first_masks), "fp")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(named, "root").select("fp", "root", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "text_hash", F.lower(F.hex("fp")).alias("fingerprint"), "component_id", "root")


def set_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A forest of the links between sets (of distinct values) with a Jaccard similarity of `least` or more."""
    order = sorted((i for i, x in enumerate(sets) if len(x)), key=lambda i: len(sets[i]))
    if len(order) < 2:
        return []
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    values, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    left, flat, of_left = np.arange(len(order)), ids, sizes  # sets not reached yet, by size
    mark, out = np.zeros(len(values), np.uint8), []
    while len(left):
        queue = [int(left[0])]
        left, flat, of_left = left[1:], flat[of_left[0] :], of_left[1:]
        while queue and len(left):
            at = queue.pop()
            a, b = np.searchsorted(of_left, [least * sizes[at] - 1, sizes[at] / least + 1])
            if a == b:
                continue
            bounds = np.concatenate([[0], np.cumsum(of_left)])
            own = ids[starts[at] : starts[at + 1]]
            mark[own] = 1
            both = np.add.reduceat(mark[flat[bounds[a] : bounds[b]]], bounds[a:b] - bounds[a], dtype=np.int64)
            mark[own] = 0
            close = np.zeros(len(left), bool)
            close[a:b] = both / (sizes[at] + of_left[a:b] - both) >= least
            if close.any():
                queue += left[close].tolist()
                out += [(order[at], order[i]) for i in left[close]]
                flat = flat[np.repeat(~close, of_left)]
                left, of_left = left[~close], of_left[~close]
    return out


def _shared(windows: DataFrame) -> DataFrame:
    """key, sets, node, windows: the nodes of every window that two or more (`sets`) have. Windows of the same nodes are one key, with
    their number."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def found(last: bool) -> Iterator[pa.RecordBatch]:
            window, node = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            new = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
            end = len(window) if last else int(new[-1])
            held.append((window[end:], node[end:]))
            window, node = window[:end], node[:end]
            each = np.concatenate([[True], (window[1:] != window[:-1]) | (node[1:] != node[:-1])])[:end]
            window, node = window[each], node[each]
            starts = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])[: len(window)])
            sizes = np.diff(np.append(starts, len(window)))
            if not (sizes > 1).any():
                return
            keys = np.add.reduceat(_mixed(node.view(np.uint64), 3), starts)
            _, first, counts = np.unique(keys, return_index=True, return_counts=True)
            times = np.zeros(len(starts), np.int64)
            times[first] = counts
            rows = np.repeat((times > 0) & (sizes > 1), sizes)
            columns = [np.repeat(x, sizes)[rows] for x in (keys.view(np.int64), sizes.astype(np.int64))] + [node[rows], np.repeat(times, sizes)[rows]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "sets", "node", "windows"])

        rows = 0
        for batch in batches:
            held.append((batch.column("window").to_numpy(), batch.column("node").to_numpy()))
            rows += batch.num_rows
            if rows >= GATHERED:
                yield from found(False)
                rows = 0
        if sum(len(w) for w, _ in held):
            yield from found(True)

    found = windows.repartition("window").sortWithinPartitions("window", "node").mapInArrow(runs, "key long, sets long, node long, windows long")
    return found.groupBy("key", "sets", "node").agg(F.sum("windows").alias("windows"))


def _met(shared: DataFrame, each: DataFrame, hot_sets: int) -> DataFrame:
    """The rows of `shared` that are needed, with `spare` and `hot`, how many of a set's windows more than `hot_sets` have. Similar sets
    share at least as many windows as one of them has to spare, so a set meets others at its hot ones only if these are as many."""
    hot = shared.where(F.col("sets") > hot_sets).groupBy("node").agg(F.sum("windows").alias("hot"))
    rows = shared.join(each.select("node", "spare"), "node").join(hot, "node", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    return rows.where((F.col("sets") <= hot_sets) | (F.col("hot") >= F.col("spare")))


def _near_nodes(each: DataFrame, shared: DataFrame, max_bits: int, shard_rows: int) -> DataFrame:
    """node, near: sets in the shards of their common windows, linked by fingerprints within `max_bits`, an eighth of the shards first:
    the others then tell links between the groups that these have found."""
    nodes = each.select("node", "fp", F.col("node").alias("near"))
    for wave in (F.pmod("key", F.lit(8)) == 0, F.pmod("key", F.lit(8)) > 0):
        keyed = shared.where(wave).join(nodes, "node").select(F.lit(0).alias("shard"), "key", F.col("near").alias("node"), "fp")
        roots = components(_links(_dealt(_halved(keyed, max_bits, shard_rows), shard_rows), max_bits))
        roots = F.broadcast(roots) if roots.count() <= BROADCAST_ROWS else roots
        joined = nodes.join(roots, nodes["near"] == roots["u"], "left")
        nodes = written(joined.select("node", "fp", F.coalesce("root", "near").alias("near")), "simhash-nodes")
    return nodes.select("node", "near")


def _far_pairs(shared: DataFrame, grouped: DataFrame, least: float, block_sets: int) -> DataFrame:
    """u, v: pairs of sets with sizes and windows in common that allow a similarity of `least`, which no fingerprints brought into one
    group. Windows of many sets are dealt as pairs of blocks."""
    rows = shared.drop("sets").join(grouped.select("node", "near", "n"), "node")
    apart = rows.groupBy("key").agg(F.min("near").alias("a"), F.max("near").alias("b"), F.count("*").alias("sets")).where("a < b")
    rows = rows.join(apart.select("key", F.ceil(F.col("sets") / block_sets).cast("int").alias("blocks")), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["key", "low", "high"]
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "n", "node", "near", "windows", "spare", "hot")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([table.column(x).to_numpy() for x in names], axis=1).astype(np.int64)
            n, node, near, windows, spare, hot = (table.column(x).to_numpy() for x in ("n", "node", "near", "windows", "spare", "hot"))
            run = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
            end = len(run) if last else int(np.searchsorted(run, run[-1]))
            held[:] = [] if last else table.slice(end).to_batches()
            # Within a run, rows ascend by size: each meets those after it, up to the size that the similarity allows.
            for i in range(0, end, GATHERED):
                at = np.arange(i, min(end, i + GATHERED))
                step = 1
                while len(at):
                    at = at[at + step < end]
                    at = at[(run[at] == run[at + step]) & (least * n[at + step] <= n[at] + 1e-9 * n[at])]
                    a = at[near[at] != near[at + step]]
                    b = a + step
                    # Windows that both have are at least `spare` of one of them; those that are hot need not be among the rows.
                    columns = [np.maximum(node[a], node[b]), np.minimum(node[a], node[b]), np.minimum(spare[a], spare[b]) - np.minimum(hot[a], hot[b]), windows[a]]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["u", "v", "needed", "windows"])
                    step += 1

        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= GATHERED:
                yield from found(False)
                count = 0
        if held and sum(b.num_rows for b in held):
            yield from found(True)

    found = rows.repartition(*names).sortWithinPartitions(*names, "n").mapInArrow(pairs, "u long, v long, needed long, windows long")
    return found.groupBy("u", "v", "needed").agg(F.sum("windows").alias("windows")).where("windows >= needed").select("u", "v")


def _blocked(members: DataFrame, block_sets: int, block_shingles: int) -> DataFrame:
    """What `_set_links` wants of the groups (`near`) of two sets or more, dealt to blocks of a task's measure."""
    measures = members.groupBy("near").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
    blocks = F.ceil(F.greatest(F.col("sets") / block_sets, F.col("shingles") / block_shingles)).cast("int")
    wanted = members.join(measures.select("near", blocks.alias("blocks")), "near")
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("set_id"), F.col("blocks"))).otherwise(0).cast("int")
    wanted = wanted.select("set_id", F.col("of.doc_id").alias("__id"), F.col("of.text_hash").alias("__hash"), "near", "blocks", block.alias("block"))
    return written(wanted, "simhash-near")


def set_groups(
    docs: DataFrame, *, least: float, id_col: str = "doc_id", text_col: str = "text", shingle: int, bits: int, max_bits: int,
    masks: list[list[int]] | None = None, shard_rows: int = 200_000, first_masks: int | None = 16, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES,
    hot_sets: int = HOT,
) -> DataFrame:
    """doc_id, text_hash, root of every row: texts linked by a Jaccard similarity of shingle sets of `least` or more.

    Every pair that similar has a window in common (`common_windows`). Sets that share one are a shard; with `masks` shards are those of
    sampled bits. What fingerprints within `max_bits` connect in these is compared as groups, and all other pairs with a window in
    common one by one, so neither bound loses a link."""
    made = fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, bits=bits, distinct=True, least=least)
    prints = written(made, "simhash-prints")
    each = prints.groupBy("set_id").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("of"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("node").alias("node"),
        F.first("spare").alias("spare"),
    )
    each = written(each, "simhash-sets")
    shared = written(_shared(prints.select("node", F.explode("windows").alias("window"))), "simhash-shared")
    shared = written(_met(shared, each, hot_sets), "simhash-met")
    if masks:
        near = _print_roots(each.select("fp").distinct(), bits, max_bits, masks, shard_rows, first_masks).withColumnRenamed("root", "near")
        rooted = each.join(near, "fp").drop("fp")
    else:
        rooted = each.drop("fp").join(_near_nodes(each, shared, max_bits, shard_rows), "node")
    rooted = written(rooted, "simhash-rooted")
    links = _set_links(docs, _blocked(rooted, block_sets, block_shingles), least, id_col, text_col, shingle)
    far = written(_far_pairs(shared, rooted, least, block_sets), "simhash-far-pairs")
    stars = far.select(F.col("u").alias("near"), F.col("v").alias("node")).union(far.select("u", "u").distinct())
    rest = _blocked(stars.join(rooted.drop("near"), "node"), block_sets, block_shingles)
    links = links.union(_set_links(docs, rest, least, id_col, text_col, shingle))
    roots = components(links).withColumnRenamed("u", "set_id")
    return prints.join(roots, "set_id", "left").select("doc_id", "text_hash", F.coalesce("root", "set_id").alias("root"))


def _set_links(docs: DataFrame, wanted: DataFrame, least: float, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """u > v: forests of the exact links within the groups of `wanted`, of each pair of blocks where a group has several."""
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    rows = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    rows = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["__id"]) & (rows["text_hash"] == wanted["__hash"])).select("near", "blocks", "block", "set_id", "text")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.array(list(set(shingle_hashes(t, shingle, 42))), np.uint64).tobytes() for t in batch.column("text").to_pylist()]
            columns = [batch.column(n) for n in ("near", "blocks", "block", "set_id")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary())], ["near", "blocks", "block", "set_id", "hashes"])

    made = rows.mapInArrow(hashes, "near long, blocks int, block int, set_id binary, hashes binary")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block")))
    dealt = made.withColumn("other", F.explode(others))
    names = ["near", "low", "high"]
    dealt = dealt.select("near", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "set_id", "hashes")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def found() -> Iterator[pa.RecordBatch]:
            ids = list(held)
            pairs = [(max(ids[a], ids[b]), min(ids[a], ids[b])) for a, b in set_links([np.frombuffer(held[i], np.uint64) for i in ids], least)]
            if pairs:
                u, v = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

        for batch in batches:
            for near, low, high, set_id, raw in zip(*(batch.column(n).to_pylist() for n in [*names, "set_id", "hashes"]), strict=True):
                if (near, low, high) != key:
                    yield from found()
                    key, held = (near, low, high), {}
                held[set_id] = raw  # rows that repeat are one set
        yield from found()

    return dealt.repartition(*names).sortWithinPartitions(*names).mapInArrow(link, "u binary, v binary").distinct()


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float | None = None, **options) -> DataFrame:
    """The rows of `docs` that stay, all columns: of each group those of the least (doc_id, hash of the text). Groups are
    those of near fingerprints, or with `least` those of shingle sets with that Jaccard similarity or more.

    Rows equal in doc_id and text are one document, and go or stay together."""
    found = near_groups if least is None else partial(set_groups, least=least)
    groups = written(found(docs, id_col=id_col, text_col=text_col, **options).select("doc_id", "text_hash", "root"), "simhash-groups")
    key = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")
    gone = groups.join(groups.groupBy("root").agg(F.min(key).alias("first")), "root").where(key != F.col("first"))
    gone = written(gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "simhash-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    same = docs[id_col].cast("long").eqNullSafe(gone["__id"]) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == gone["__hash"])
    return docs.join(gone, same, "left_anti")
