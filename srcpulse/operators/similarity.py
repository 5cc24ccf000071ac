"""Nearest patterns of every query vector.

Exact ways with one result:

* A catalogue whose size is checked to be small is sent to every task, and each batch of queries is
  multiplied with it. The plan is narrow: no shuffle and no row per (query, pattern) pair.
* A larger catalogue is scanned as eight-bit codes, whose bounds leave few vectors to be looked at in full (`quantised`).
* Where it has clusters it can be cut into cells around a few pivots instead (``large="cells"``). The triangle inequality tells from
  the distances to the pivots alone which cells can hold a neighbour of a query; only those are searched.
  Cells and the queries that visit them are split until each group has a bounded number of rows.

Distances are compared at nine decimals and ties go to the smaller ``pattern_id``, so the order in which
products are summed decides nothing.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from srcpulse.functions import scoring
from srcpulse.operators import quantised
from srcpulse.operators.quantised import kth_bound
from srcpulse.schemas import NEIGHBOUR
from srcpulse.session import materialize

# Functions sent to tasks travel with their code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values: neighbours asked of each collection -------------------------------------------
DECAY, BUG = "decay_patterns", "bug_patterns"
NEIGHBOURS = {DECAY: 5, BUG: 3}
# -------------------------------------------------------------------------------------------------
METRICS = ("l2", "cosine")  # l2 is the squared distance, the default of the catalogue
DECIMALS = 9
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
MAX_PIVOTS = 256
CELL_ROWS = 8192
QUERY_ROWS = 8192
#: Queries and rows whose distances are held at once.
TILE_QUERIES, TILE_ROWS = 256, 4096
#: Queries of a batch that are searched, and their answers made, at once.
SEARCHED_ROWS = 2048
_CHUNK_ENTRIES = 250_000
_FOUND = f"array<{NEIGHBOUR}>"


def _matrix(vectors, metric: str) -> np.ndarray:
    return _unit(np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64), metric)


def _unit(m: np.ndarray, metric: str) -> np.ndarray:
    """Rows brought to length one where the metric is the angle."""
    if metric == "cosine" and len(m):
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return m


def _squared(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = q @ p.T
    d *= -2.0
    d += (q * q).sum(axis=1)[:, None]
    d += (p * p).sum(axis=1)[None, :]
    return np.maximum(d, 0.0, out=d)


def _distances(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Squared distance, or one minus the cosine of vectors already brought to unit length; not yet rounded."""
    if metric != "cosine":
        return _squared(q, p)
    d = q @ p.T
    np.subtract(1.0, d, out=d)
    return np.maximum(d, 0.0, out=d)


class _Rows:
    """Rows of a catalogue as it is stored; those of a tile become doubles, of unit length where the metric is the angle."""

    def __init__(self, stored: np.ndarray, metric: str) -> None:
        self._stored, self._metric = stored, metric

    def __len__(self) -> int:
        return len(self._stored)

    def __getitem__(self, part) -> np.ndarray:
        return _unit(self._stored[part].astype(np.float64), self._metric)


def _tiles(n_queries: int, n: int) -> Iterator[tuple[np.ndarray, slice]]:
    """All queries against all rows, in tiles of bounded size."""
    for start in range(0, n_queries, TILE_QUERIES):
        rows = np.arange(start, min(start + TILE_QUERIES, n_queries))
        for at in range(0, n, TILE_ROWS):
            yield rows, slice(at, min(at + TILE_ROWS, n))


def _top_k(q: np.ndarray, p: np.ndarray, k: int, metric: str, max_distance: float | None, tiles=None):
    """Positions and distances of the k nearest rows of ``p``, nearest first, and how many of them count.

    Rows of ``p`` are in order of ``pattern_id``. Distances are compared at nine decimals, and ties fall to the smaller
    position. ``tiles`` names the parts to look at, as positions in ``q`` and a slice of ``p`` or positions in it; without it all is looked at.

    Of each tile only entries go on that are not farther than the k-th nearest can be, as the least distances of groups of
    rows tell; so most entries are compared once and never sorted.
    """
    k = min(k, len(p))
    near, dist, counts = np.zeros((len(q), k), dtype=np.int64), np.zeros((len(q), k)), np.zeros(len(q), dtype=np.int64)
    if not k or not len(q):
        return near, dist, counts
    reach = np.full(len(q), np.inf)
    held, waiting = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), []

    def first_k() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, at, d = (np.concatenate(x) for x in zip(held, *waiting, strict=True))
        order = np.lexsort((at, d, row))
        row, at, d = row[order], at[order], d[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        return row[place < k], at[place < k], d[place < k]

    for rows, part in tiles if tiles is not None else _tiles(len(q), len(p)):
        d = _distances(q[rows], p[part], metric)
        reach[rows] = np.minimum(reach[rows], kth_bound(d, k))
        # What rounds to the same nine decimals is a tie.
        most = reach[rows] + 1.1 * 10.0**-DECIMALS + 1e-15 * np.where(np.isfinite(reach[rows]), reach[rows], 0.0)
        row, col = np.nonzero(d <= most[:, None])
        at = col + part.start if isinstance(part, slice) else part[col]
        waiting.append((rows[row], at, np.round(d[row, col], DECIMALS)))
        if sum(len(w[0]) for w in waiting) >= _CHUNK_ENTRIES:
            held, waiting = first_k(), []
    row, at, d = first_k()
    place = np.arange(len(row)) - np.searchsorted(row, row)
    near[row, place], dist[row, place] = at, d
    counts = np.bincount(row if max_distance is None else row[d <= max_distance], minlength=len(q))
    return near, dist, counts


def _flat(near: np.ndarray, dist: np.ndarray, counts: np.ndarray):
    """The counted entries of all rows, one after another."""
    kept = np.arange(near.shape[1])[None, :] < counts[:, None]
    return near[kept], dist[kept]


def _catalogue_fits(patterns: DataFrame, max_bytes: int) -> tuple[bool, int]:
    """Whether the vectors, as doubles, stay below ``max_bytes``; one aggregate over the catalogue."""
    row = patterns.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding")).alias("cells")).first()
    return (row["cells"] or 0) * 8 <= max_bytes, row["n"]


def nearest_patterns(
    queries: DataFrame, patterns: DataFrame, k: Mapping[str, int] = NEIGHBOURS, metric: str = "l2",
    max_distance: float | None = None, max_broadcast_bytes: int = MAX_BROADCAST_BYTES, large: str = "codes",
) -> DataFrame:
    """The nearest patterns of every query in each collection: ``query_id, decay_neighbours, bug_neighbours``.

    ``queries(query_id, embedding)`` with unique ids, ``patterns(collection, pattern_id, embedding, bug_type,
    severity)``. Without ``max_distance`` every query has its k neighbours, however far. A query without a
    vector has none.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    if large not in ("codes", "cells"):
        raise ValueError("a large catalogue is searched by codes or by cells")
    known = patterns.filter(F.col("collection").isin(*k) & F.col("embedding").isNotNull()).select(
        "collection", F.col("pattern_id").cast("string").alias("pattern_id"), "embedding", "bug_type", "severity"
    )
    fits, count = _catalogue_fits(known, max_broadcast_bytes)
    if fits:
        return _by_broadcast(queries, known, k, metric, max_distance)
    if large == "cells":
        return _by_cells(queries, known, k, metric, max_distance, count)
    return _by_codes(queries, known, k, metric, max_distance)


def _sent(rows: pd.DataFrame, kind: str) -> tuple[np.ndarray, pa.Array, list[pa.Array]]:
    """Vectors of the catalogue's own type and the columns of its patterns, as arrays that a worker takes up without an object per value."""
    vectors = np.zeros((len(rows), len(rows["embedding"].iloc[0]) if len(rows) else 0), np.float32 if kind == "array<float>" else np.float64)
    for i, v in enumerate(rows["embedding"]):
        vectors[i] = v
    named = [pa.array(rows[c].to_numpy(object), pa.string()).dictionary_encode() for c in ("bug_type", "severity")]
    return vectors, pa.array(rows["pattern_id"].to_numpy(object), pa.string()), named


def _by_broadcast(queries, known, k, metric, max_distance) -> DataFrame:
    rows = known.toPandas().sort_values("pattern_id", kind="stable")
    stored = known.schema["embedding"].dataType.simpleString()
    shelves = {name: _sent(rows[rows["collection"] == name], stored) for name in k}
    sent = queries.sparkSession.sparkContext.broadcast(shelves)
    kind = pa.list_(
        pa.struct([("pattern_id", pa.string()), ("distance", pa.float64()), ("bug_type", pa.string()), ("severity", pa.string())])
    )

    def lists(q: np.ndarray, asked: np.ndarray, name: str) -> pa.Array:
        """Neighbour lists of all queries; ``asked`` tells which of them have a vector."""
        matrix, ids, named = sent.value.get(name, (np.empty((0, 0)), None, None))
        counts = np.zeros(len(asked), dtype=np.int64)
        if not len(q) or not len(matrix):
            return pa.array([[]] * len(asked), type=kind)
        near, dist, found = _top_k(q, _Rows(matrix, metric), k[name], metric, max_distance)
        counts[asked] = found
        near, dist = _flat(near, dist, found)
        at = pa.array(near)
        fields = [ids.take(at), pa.array(dist), *[c.take(at).cast(pa.string()) for c in named]]
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(kind.value_type))).cast(kind)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SEARCHED_ROWS):
                batch = whole.slice(start, SEARCHED_ROWS)
                vectors = batch.column("embedding")
                asked = vectors.is_valid().to_numpy(zero_copy_only=False)
                flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                q = _unit(flat.reshape(int(asked.sum()), -1) if asked.any() else np.empty((0, 0)), metric)
                columns = [batch.column("query_id"), *[lists(q, asked, name) for name in (DECAY, BUG)]]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "decay_neighbours", "bug_neighbours"])

    id_type = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "embedding").mapInArrow(
        search, f"query_id {id_type}, decay_neighbours {_FOUND}, bug_neighbours {_FOUND}"
    )


def _pair_distances(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of equal place."""
    if metric == "cosine":
        return np.round(np.maximum(1.0 - (_unit(q, metric) * _unit(p, metric)).sum(axis=1), 0.0), DECIMALS)
    d = (q * q).sum(axis=1) + (p * p).sum(axis=1) - 2.0 * (q * p).sum(axis=1)
    return np.round(np.maximum(d, 0.0), DECIMALS)


def _by_codes(queries, known, k, metric, max_distance) -> DataFrame:
    found = None
    for name, wanted in k.items():
        rows = quantised.search(queries, known.filter(F.col("collection") == name), wanted, metric, max_distance, _pair_distances)
        rows = rows.withColumn("collection", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    return _gathered(queries, found)


def _by_cells(queries, known, k, metric, max_distance, count) -> DataFrame:
    """Search only the cells that can hold a neighbour, in groups of bounded size."""
    spark = queries.sparkSession
    id_type = queries.schema["query_id"].dataType.simpleString()
    found = None
    for name, wanted in k.items():
        shelf = known.filter(F.col("collection") == name)
        n_pivots = min(MAX_PIVOTS, max(1, math.isqrt(count)))
        picked = shelf.orderBy(F.xxhash64("pattern_id"), "pattern_id").limit(n_pivots).select("embedding").collect()
        if not picked:
            continue
        pivots = spark.sparkContext.broadcast(_matrix([r[0] for r in picked], metric))
        rows = _search_shelf(queries, shelf, wanted, metric, max_distance, pivots, id_type).withColumn(
            "collection", F.lit(name)
        )
        found = rows if found is None else found.unionByName(rows)
    return _gathered(queries, found)


def _gathered(queries, found) -> DataFrame:
    """The ranked rows of all collections as lists of each query."""

    def gathered(name: str) -> Column:
        # at most k entries of a query
        entry = F.when(
            F.col("collection") == name, F.struct("rank", F.struct("pattern_id", "distance", "bug_type", "severity").alias("n"))
        )
        return F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["n"])

    empty = F.array().cast(_FOUND)
    if found is None:
        return queries.select("query_id", empty.alias("decay_neighbours"), empty.alias("bug_neighbours"))
    lists = found.groupBy("query_id").agg(gathered(DECAY).alias("decay_neighbours"), gathered(BUG).alias("bug_neighbours"))
    return queries.select("query_id").join(lists, "query_id", "left").select(
        "query_id", *[F.coalesce(c, empty).alias(c) for c in ("decay_neighbours", "bug_neighbours")]
    )


def _groups_of(sizes: np.ndarray, most: int) -> tuple[list[tuple[int, int]], int]:
    """The first group and the number of groups of each cell, and how many groups there are: small cells share a group of about ``most``
    rows, a larger one has several of its own."""
    out, n, held = [], 0, 0
    for size in sizes.tolist():
        turns = max(1, math.ceil(size / most))
        if held and (turns > 1 or held + size > most):
            n, held = n + 1, 0
        out.append((n, turns))
        held += size
        if turns > 1:
            n, held = n + turns, 0
    return out, n + (held > 0 or not n)


def _cell_tiles(visits: np.ndarray, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries of each cell and its rows, in tiles of bounded size."""
    for c in np.unique(cell):
        rows, part = np.flatnonzero(visits[:, c]), np.flatnonzero(cell == c)
        for some, at in _tiles(len(rows), len(part)):
            yield rows[some], part[at]


def _search_shelf(queries, shelf, k, metric, max_distance, pivots, id_type) -> DataFrame:
    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = np.sqrt(_squared(_matrix(pdf["embedding"], metric), pivots.value))
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), to_pivot=d[np.arange(len(d)), cell])

    fields = "pattern_id string, embedding array<float>, bug_type string, severity string"
    placed = shelf.select("pattern_id", F.col("embedding").cast("array<float>"), "bug_type", "severity").mapInPandas(
        to_cells, f"{fields}, cell int, to_pivot double"
    )
    placed = materialize(placed, "cells")
    # Per cell: its size, its radius and its k members nearest the pivot. At most MAX_PIVOTS cells.
    inner = Window.partitionBy("cell").orderBy("to_pivot")
    near = (
        placed.select("cell", "to_pivot").withColumn("r", F.row_number().over(inner)).filter(F.col("r") <= k)
        .groupBy("cell").agg(F.collect_list("to_pivot").alias("nearest"))
    )
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("to_pivot").alias("radius")).join(near, "cell").collect()
    n_cells = len(pivots.value)
    size, radius = np.zeros(n_cells, dtype=int), np.full(n_cells, -np.inf)
    members = np.full((n_cells, k), np.inf)
    for s in stats:
        size[s["cell"]], radius[s["cell"]] = s["n"], s["radius"]
        members[s["cell"], : len(s["nearest"])] = sorted(s["nearest"])
    shelf_of, n_slices = _groups_of(size, CELL_ROWS)

    def visited(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The home cell of each query, and which cells may hold one of its neighbours."""
        homes, visits = np.zeros(len(q), dtype=np.int64), np.zeros((len(q), n_cells), dtype=bool)
        for start in range(0, len(q), TILE_QUERIES):
            d = np.sqrt(_squared(q[start : start + TILE_QUERIES], pivots.value))
            reachable = (d[:, :, None] + members[None, :, :]).reshape(len(d), -1)
            bound = np.partition(reachable, k - 1, axis=1)[:, k - 1]
            homes[start : start + len(d)] = d.argmin(axis=1)
            visits[start : start + len(d)] = (size > 0) & (d - radius <= bound[:, None] + 1e-6)
        return homes, visits

    def to_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(home=visited(_matrix(pdf["embedding"], metric))[0].astype("int32"))

    known = queries.filter(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<float>").alias("embedding"))
    known = materialize(known.mapInPandas(to_home, f"query_id {id_type}, embedding array<float>, home int"), "asked")
    asked = np.zeros(n_cells, dtype=int)
    for r in known.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect():
        asked[r["home"]] = r["n"]
    block_of, _ = _groups_of(asked, QUERY_ROWS)

    def place_in(groups: list[tuple[int, int]], cell: str, by: str) -> Column:
        """The group of a row: of a cell with several groups the hash of the row's name picks one."""
        first, turns = (F.array(*[F.lit(g[i]).cast("bigint") for g in groups]) for i in (0, 1))
        return F.get(first, F.col(cell)) + F.pmod(F.xxhash64(by), F.get(turns, F.col(cell)))

    def to_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row per query and slice that holds one of its cells; a batch per slice, so a task holds one copy of its queries."""
        for pdf in batches:
            if len(pdf):
                visits = visited(_matrix(pdf["embedding"], metric))[1]
                for at in range(n_slices):
                    inside = [c for c, (first, turns) in enumerate(shelf_of) if first <= at < first + turns]
                    some = pdf[visits[:, inside].any(axis=1)]
                    if len(some):
                        yield some.assign(slice=np.int64(at))

    blocked = known.withColumn("block", place_in(block_of, "home", "query_id")).select("query_id", "embedding", "block")
    left = blocked.mapInPandas(to_slices, f"query_id {id_type}, embedding array<float>, block long, slice long")
    left = materialize(left, "visits")
    met = left.select("block", "slice").distinct().toDF("block", "slice")
    right = placed.drop("to_pivot").withColumn("slice", place_in(shelf_of, "cell", "pattern_id")).join(met, "slice")

    def search(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "pattern_id", "distance", "bug_type", "severity"]
        if not len(q) or not len(p):
            return pd.DataFrame([], columns=names)
        p = p.sort_values("pattern_id", kind="stable")
        info, cell = p[names[1:2] + names[3:]].to_numpy(object), p["cell"].to_numpy()
        asking = _matrix(q["embedding"], metric)
        visits, rows = visited(asking)[1], _matrix(p["embedding"], metric)
        found = _top_k(asking, rows, k, metric, max_distance, None if visits[:, np.unique(cell)].mean() > 0.5 else _cell_tiles(visits, cell))
        near, dist = _flat(*found)
        ids = q["query_id"].to_numpy().repeat(found[2])
        return pd.DataFrame(
            {"query_id": ids, "pattern_id": info[near, 0], "distance": dist, "bug_type": info[near, 1], "severity": info[near, 2]}
        )

    keys = ["block", "slice"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        search, f"query_id {id_type}, pattern_id string, distance double, bug_type string, severity string"
    )
    order = Window.partitionBy("query_id").orderBy("distance", "pattern_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def neighbour_rows(found: DataFrame) -> DataFrame:
    """One row per (query, collection, rank)."""

    def ranked(column: str, name: str) -> Column:
        def entry(n, i):
            return F.struct(F.lit(name).alias("collection"), (i + 1).alias("rank"), n.alias("n"))

        return F.transform(F.col(column), entry)

    both = found.select(
        "query_id", F.explode(F.concat(ranked("decay_neighbours", DECAY), ranked("bug_neighbours", BUG))).alias("e")
    )
    return both.select("query_id", "e.collection", "e.rank", "e.n.*")


def with_pattern_risk(found: DataFrame, cfg: scoring.ScoreConfig = scoring.DEFAULT) -> DataFrame:
    decay, bugs = F.col("decay_neighbours"), F.col("bug_neighbours")
    return found.select(
        "*",
        F.size(decay).alias("pattern_matches"),
        F.size(bugs).alias("bug_pattern_matches"),
        scoring.pattern_risk(decay, bugs, cfg).alias("pattern_risk_score"),
        scoring.similar_issues(bugs).alias("similar_issues"),
        scoring.pattern_warnings(bugs).alias("pattern_warnings"),
    )
