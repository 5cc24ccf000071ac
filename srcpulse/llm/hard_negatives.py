"""Operator 11: hard negatives by exact integer products of tiles.

Vectors become integers, floor(`scale` * x), and rows are packed in label order into tiles: matrices of a bounded number
of rows, shorter vectors padded with zeros. Every anchor tile meets every candidate tile that it has a use for (the anchor
set is the stated query set; a tile pair, never a row pair, is a row of a plan). Scores of a tile pair come from a
recursive Strassen product over int64. Its additions wrap around modulo 2^64 without harm: a sum that fits 64 bits comes
out exact whatever happens between; a product that might not fit is an error, never a wrong number.

Two passes, each over the tile pairs it needs: tiles that share a label give each anchor's positives, tiles that do not
are all of one label give the negatives of each (anchor, positive). A task keeps a heap of the best few rows per anchor
(per anchor and positive) and merges tile after tile into it; heaps of different tasks meet in a ranked window whose
group limit cuts them before the shuffle. A pass that has no tile pair for an anchor gives it no rows.

Rows with a null id, label, vector or component, or a component that is not finite, take no part. Rows equal in id, label
and vector are one row. Rows that share an id otherwise are rows of their own, never positives or negatives of an anchor
of that id, and ties beyond the id go by label, then by a
hash of the vector. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcpulse.llm.common import written
from srcpulse.llm.heaps import Heaps, best

#: Rows of a tile, and the side from which a product is not split any more.
ANCHOR_ROWS, TILE_ROWS, LEAF = 256, 1024, 32
#: Anchor tiles whose heaps a task holds before it hands them on.
HELD_TILES = 64
TILE = "n int, width int, low long, high long, ids binary, labels binary, vectors binary"
SENT = ("n", "width", "ids", "labels", "vectors")
FOUND = "id long, score long, tie long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank long"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b over int64: seven products of quarters in place of eight; odd sides are padded with zeros."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    a = np.pad(a, ((0, n % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, m % 2)))
    r, s, t = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * r, 2 * t), np.int64)
    out[:r, :t] = p1 + p4 - p5 + p7
    out[:r, t:] = p3 + p5
    out[r:, :t] = p2 + p4
    out[r:, t:] = p1 - p2 + p3 + p6
    return out[:n, :m]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of the rows of `a` against the rows of `b`; the shorter vectors count as padded with zeros."""
    k = min(a.shape[1], b.shape[1])
    a, b = a[:, :k], b[:, :k]
    most = [max(abs(int(x.min(initial=0))), int(x.max(initial=0))) for x in (a, b)]
    if most[0] * most[1] * k >= 2**63:
        raise OverflowError("scores of these vectors may not fit 64 bits; a smaller scale is needed")
    return strassen(a, np.ascontiguousarray(b.T))


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """(bytes of a component, components) in the narrowest whole-number type that holds them."""
    least, most = int(x.min(initial=0)), int(x.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if -(2 ** (8 * w - 1)) <= least and most < 2 ** (8 * w - 1))
    return width, x.astype(f"<i{width}").tobytes()


def rows_of(df: DataFrame, *, id_col: str, label: Column | str, vector_col: str, scale: int) -> DataFrame:
    """id, label, q (array of long) of the rows that take part, equal rows once."""
    v = F.col(vector_col).cast("array<double>")
    label = F.col(label) if isinstance(label, str) else label
    some = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = some.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(fine)
    return some.select("id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("q"))


def tiles(rows: DataFrame, of_rows: int) -> DataFrame:
    """Tiles of up to `of_rows` rows in (label, id) order, a written table; `tile` numbers them from 0 without gaps."""
    spark = rows.sparkSession
    names = [c.split()[0] for c in TILE.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tile(held: list) -> pa.RecordBatch:
            ids, labels, vectors = (list(x) for x in zip(*held, strict=True))
            wide = max(map(len, vectors))
            q = np.zeros((len(held), wide), np.int64)
            for i, v in enumerate(vectors):
                q[i, : len(v)] = v
            width, raw = _narrow(q)
            row = [len(held), width, labels[0], labels[-1], np.array(ids, "<i8").tobytes(), np.array(labels, "<i8").tobytes(), raw]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        held, last = [], None
        for batch in batches:
            flat = batch.column("q").flatten().to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.cumsum(batch.column("q").value_lengths().to_numpy())])
            for i, (one, label) in enumerate(zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                v = flat[cuts[i] : cuts[i + 1]]
                if last is not None and last[:2] == (one, label) and np.array_equal(last[2], v):
                    continue  # equal rows follow each other
                last = (one, label, v)
                held.append(last)
                if len(held) == of_rows:
                    yield tile(held)
                    held = []
        if held:
            yield tile(held)

    order = ["label", "id", F.xxhash64("q"), "q"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    made = rows.repartitionByRange(n, "label", "id").sortWithinPartitions(*order).mapInArrow(pack, TILE)
    made = written(made.withColumn("place", F.monotonically_increasing_id()), "hard-packed")
    # One number per tile of many rows goes through the window; the tiles themselves are joined to it.
    numbers = made.select("place").withColumn("tile", (F.row_number().over(Window.orderBy("place")) - 1).cast("int"))
    return written(made.join(numbers, "place").drop("place"), "hard-tiles")


def _pairs(left: DataFrame, right: DataFrame, use: Column, *also: str) -> DataFrame:
    """A row for each pair of tiles that `use` asks for, dealt by the right tile. Numbers are paired; vectors follow by keys:
    a left tile moves once for each pair, a right tile once."""
    limits = lambda t, p: t.select(F.col("tile").alias(p), F.col("low").alias(f"{p}_low"), F.col("high").alias(f"{p}_high"))
    whole = lambda t, p, *more: t.select(F.col("tile").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in (*SENT, *more)))
    every = F.sequence(F.lit(0), F.lit(int(right.agg(F.max("tile")).first()[0])))
    numbers = limits(left, "a").withColumn("b", F.explode(every)).join(limits(right, "b"), "b").where(use).select("a", "b")
    # A pair costs much time and few bytes, so the number of tasks is stated and not left to the bytes.
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return numbers.join(whole(left, "a", *also), "a").repartition(n, "b").join(whole(right, "b"), "b")


class _Tile:
    def __init__(self, n: int, width: int, ids: bytes, labels: bytes, vectors: bytes) -> None:
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.vectors = np.frombuffer(vectors, f"<i{width}").reshape(n, -1).astype(np.int64)


def _tile(batch: pa.RecordBatch, i: int, p: str) -> _Tile:
    return _Tile(*(batch.column(f"{p}_{c}")[i].as_py() for c in SENT))


def _searched(pairs: DataFrame, k: int, schema: str, asked, useful) -> DataFrame:
    """The `k` best rows of each query of the left tiles, over the pairs that a task has. `asked(batch, i, tile)` gives a left
    tile's queries as columns of the result, `useful(tile, queries, right, scores)` the (query, column) pairs that count."""
    names = [c.split()[0] for c in schema.split(", ")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        heaps, at, right = Heaps(k), None, None

        def found() -> Iterator[pa.RecordBatch]:
            key, ids, score, tie = heaps.merged()
            for number, (_, queries) in held.items():
                some = np.flatnonzero(key >> 32 == number)
                lead = [c[key[some] & (2**32 - 1)] for c in queries]
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (*lead, ids[some], score[some], tie[some])], names)

        for batch in batches:
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                if at != b:
                    at, right = b, _tile(batch, i, "b")
                if a not in held:
                    if len(held) >= HELD_TILES:
                        yield from found()
                        held, heaps = {}, Heaps(k)
                    left = _tile(batch, i, "a")
                    held[a] = (left, asked(batch, i, left))
                left, queries = held[a]
                scores = products(left.vectors, right.vectors)
                query, col = useful(left, queries, right, scores)
                score = scores[queries[0][query], col]
                # Rows of one id: tiles, and rows of a tile, are in the order of label and vector.
                tie = col + (b << 32)
                keep = best(query, score, right.ids[col], tie, k)
                heaps.push(query[keep] + (a << 32), right.ids[col[keep]], score[keep], tie[keep])
        yield from found()

    return pairs.mapInArrow(search, schema)


def _positives(anchors: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """tile, at, anchor_id, rank, id, score: the `k` best rows of the label of the anchor at place `at` of a tile."""

    def asked(batch: pa.RecordBatch, i: int, tile: _Tile) -> list[np.ndarray]:
        return [np.arange(len(tile.ids)), np.full(len(tile.ids), batch.column("a")[i].as_py()), tile.ids]

    def useful(left: _Tile, queries: list, right: _Tile, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero((left.labels[:, None] == right.labels) & (left.ids[:, None] != right.ids))

    shared = (F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high"))
    found = _searched(_pairs(anchors, candidates, shared), k, f"at long, tile long, anchor_id long, {FOUND}", asked, useful)
    first = Window.partitionBy("tile", "at").orderBy(F.desc("score"), "id", "tie")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("tie")


def _negatives(anchors: DataFrame, candidates: DataFrame, positives: DataFrame, k: int, low: tuple[int, int]) -> DataFrame:
    """The `k` best rows of other labels between `low` of a positive's score and that score, for each positive."""
    num, den = low
    # A tile has a bounded number of anchors, each with a bounded number of positives.
    theirs = positives.groupBy("of_tile").agg(F.sort_array(F.collect_list(F.struct("at", "rank", "id", "score"))).alias("positives"))
    wanted = anchors.join(theirs, F.col("tile") == F.col("of_tile")).drop("of_tile")

    def asked(batch: pa.RecordBatch, i: int, tile: _Tile) -> list[np.ndarray]:
        at, rank, ids, score = np.array([list(p.values()) for p in batch.column("a_positives")[i].as_py()], np.int64).T
        return [at, np.full(len(at), batch.column("a")[i].as_py()), tile.ids[at], rank, ids, score]

    def useful(left: _Tile, queries: list, right: _Tile, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, _, _, rank, _, top = queries
        q, r = np.divmod(top, den)
        least = num * q - (-num * r) // den
        n = len(left.ids)
        lowest, highest = np.full(n, 2**63 - 1), np.full(n, -(2**63))
        np.minimum.at(lowest, at, least)
        np.maximum.at(highest, at, top)
        other = (left.labels[:, None] != right.labels) & (left.ids[:, None] != right.ids)
        row, col = np.nonzero(other & (scores >= lowest[:, None]) & (scores <= highest[:, None]))
        score, out = scores[row, col], []
        for one in np.unique(rank):  # one positive of each anchor at a time
            of = np.full(n, -1)
            of[at[rank == one]] = np.flatnonzero(rank == one)
            query = of[row]
            fits = np.flatnonzero((query >= 0) & (score >= least[query]) & (score <= top[query]))
            out.append((query[fits], col[fits]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    apart = (F.col("a_low") < F.col("a_high")) | (F.col("b_low") < F.col("b_high")) | (F.col("a_low") != F.col("b_low"))
    lead = "at long, of_tile long, anchor_id long, positive_rank long, positive_id long, positive_score long"
    found = _searched(_pairs(wanted, candidates, apart, "positives"), k, f"{lead}, {FOUND}", asked, useful)
    first = Window.partitionBy("of_tile", "at", "positive_rank").orderBy(F.desc("score"), "id", "tie")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def mine(
    df: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", label: Column | str = "label", vector_col: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (4, 5), anchor_rows: int = ANCHOR_ROWS, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank: for each anchor (`is_anchor`
    over `id`) and each of its `positives` best rows of the same label, the `negatives` best rows of other labels whose score is
    at most the positive's and at least `low` (a fraction) of it."""
    if not 0 <= low[0] <= low[1]:
        raise ValueError("low must be a fraction of at most one")
    rows = written(rows_of(df, id_col=id_col, label=label, vector_col=vector_col, scale=scale), "hard-rows")
    candidates, anchors = tiles(rows, tile_rows), tiles(rows.where(is_anchor), anchor_rows)
    if anchors.isEmpty():
        return df.sparkSession.createDataFrame([], RESULT)
    best_of = written(_positives(anchors, candidates, positives).withColumnRenamed("tile", "of_tile"), "hard-positives")
    return _negatives(anchors, candidates, best_of, negatives, low).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), "positive_rank",
    )
