"""Nearest patterns through eight-bit codes: exact answers that read few full vectors.

A vector p is kept as whole numbers of eight bits and a scale, p' = scale * code, with the length r of what p' leaves of p,
rounded up. By the triangle inequality the distance of any query q to p lies within r of its distance to p', and q . p lies
within r |q| of q . p'. So a scan of the codes, a quarter of the bytes of the vectors, gives a lower and an upper bound of each
distance. The k-th least upper bound of a query is a distance that k patterns stay within; patterns whose lower bound is above it
are out. Only the others are fetched as full vectors and ranked by their true distance.

Codes are packed into blocks of bounded size. Queries counted to be small go to all tasks and the codes do not move; more queries
are packed into blocks too, and pairs of blocks meet by key. Equal vectors can only be told apart by their ids: of each
distinct vector only the k least ids go on, so a vector that very many patterns share brings no candidates beyond k.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from srcpulse.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CODE_ROWS, QUERY_ROWS = 8192, 2048
QUERY_BYTES = 64 * 1024 * 1024
#: Entries whose least one stands for all of them; queries whose bounds are held at once.
GROUP_ROWS, TILE_QUERIES = 32, 128
#: Added to every bound: rounding of sums of doubles, and distances that are equal at nine decimals.
SLACK = 4e-9
_LEVELS = 127
_CODES = "n int, places binary, codes binary, scales binary, rests binary"
_QUERIES = "n int, places binary, vectors binary"
_BOUNDS = "query long, pattern long, low double, high double"


def unit(m: np.ndarray, metric: str) -> np.ndarray:
    """Rows brought to length one where the metric is the angle."""
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if metric == "cosine" and len(m) else m


def coded(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and lengths of the rests of the rows of ``p``."""
    scale = np.abs(p).max(axis=1, initial=0.0) / _LEVELS
    scale[scale == 0] = 1.0
    code = np.clip(np.rint(p / scale[:, None]), -_LEVELS, _LEVELS).astype(np.int8)
    rest = np.linalg.norm(p - code * scale[:, None], axis=1)
    return code, scale, rest * (1 + 1e-9) + 1e-12


def bounds(q: np.ndarray, code: np.ndarray, scale: np.ndarray, rest: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of all rows of ``q`` to all coded vectors."""
    near = code.astype(np.float64) * scale[:, None]
    if metric == "cosine":
        middle = 1.0 - q @ near.T
        spread = np.linalg.norm(q, axis=1)[:, None] * rest
        return np.maximum(middle - spread, 0.0) - SLACK, np.maximum(middle + spread, 0.0) + SLACK
    squared = (q * q).sum(axis=1)[:, None] + (near * near).sum(axis=1) - 2.0 * (q @ near.T)
    # Sums of squares cancel: what is lost is a share of the squares, not of the distance.
    lost = 1e-13 * ((q * q).sum(axis=1)[:, None] + (near * near).sum(axis=1)) * q.shape[1] + SLACK
    low, high = np.sqrt(np.maximum(squared - lost, 0.0)) - rest, np.sqrt(np.maximum(squared + lost, 0.0)) + rest
    return np.maximum(low, 0.0) ** 2 - SLACK, high**2 + SLACK


def kth_bound(d: np.ndarray, k: int) -> np.ndarray:
    """A number per row that at least ``k`` entries of it do not exceed: the k-th least of the least entries of groups."""
    groups = d.shape[1] // GROUP_ROWS
    if groups < k:
        return np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)
    least = d[:, : groups * GROUP_ROWS].reshape(len(d), GROUP_ROWS, groups).min(axis=1)
    return np.partition(least, k - 1, axis=1)[:, k - 1]


def still_open(low: np.ndarray, high: np.ndarray, k: int, reach: np.ndarray | None = None) -> np.ndarray:
    """Which entries may be among the ``k`` nearest of their row. ``reach``, a distance per row that k patterns are known to stay
    within, is brought down where these entries say so."""
    if reach is None:
        reach = np.full(len(low), np.inf)
    np.minimum(reach, kth_bound(high, k), out=reach)
    return low <= reach[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _packed(rows: DataFrame, schema: str, of_rows: int, shape) -> DataFrame:
    """Blocks of up to ``of_rows`` rows of (place, embedding)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block(m: np.ndarray) -> pa.RecordBatch:
            places = np.concatenate([p for p, _ in held])
            values = [len(places), places.astype("<i8").tobytes(), *shape(m)]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if i == 0 else pa.binary()) for i, v in enumerate(values)], names)

        for batch in batches:
            for start in range(0, batch.num_rows, of_rows):
                some = batch.slice(start, of_rows)
                held.append((some.column("place").to_numpy(), _matrix(some.column("embedding"))))
                n += some.num_rows
                if n >= of_rows:
                    yield block(np.concatenate([m for _, m in held]))
                    held, n = [], 0
        if held:
            yield block(np.concatenate([m for _, m in held]))

    return rows.select("place", "embedding").mapInArrow(pack, schema)


def _numbered(blocks: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Blocks with numbers from 0 without gaps; the window sees one number per block."""
    made = materialize(blocks.withColumn("_at", F.monotonically_increasing_id()), "blocks")
    numbers = made.select("_at", (F.row_number().over(Window.orderBy("_at")) - 1).alias(name))
    return made.join(numbers, "_at").drop("_at"), made.count()


def _block(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    at = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)
    n = batch.column("n")[i].as_py()
    return at("places", "<i8"), at("codes", np.int8).reshape(n, -1), at("scales", "<f8"), at("rests", "<f8")


def _found(q_places: np.ndarray, q: np.ndarray, block: tuple, k: int, metric: str, reach: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The open pairs of a block; the bounds of ``TILE_QUERIES`` queries are held at once."""
    places, code, scale, rest = block
    for at in range(0, len(q), TILE_QUERIES):
        some = slice(at, at + TILE_QUERIES)
        low, high = bounds(q[some], code, scale, rest, metric)
        row, col = np.nonzero(still_open(low, high, k, reach[some]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(q_places[some][row]), pa.array(places[col]), pa.array(low[row, col]), pa.array(high[row, col])], ["query", "pattern", "low", "high"]
        )


def candidates(queries: DataFrame, shelf: DataFrame, k: int, metric: str, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query, pattern (places) of the pairs whose bounds leave them open; both frames have ``place, embedding`` and are written tables."""

    def codes(m: np.ndarray) -> tuple[bytes, ...]:
        code, scale, rest = coded(unit(m, metric))
        return code.tobytes(), scale.astype("<f8").tobytes(), rest.astype("<f8").tobytes()

    size = queries.agg(F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0))).first()[0] * 8
    if size <= query_bytes:
        rows = queries.select("place", "embedding").toPandas()
        m = unit(np.array(rows["embedding"].tolist(), np.float64).reshape(len(rows), -1), metric)
        context = queries.sparkSession.sparkContext
        sent = context.broadcast((rows["place"].to_numpy(np.int64), m))
        # Each block meets all queries, so blocks are what tasks share.
        blocks = _packed(shelf.select("place", "embedding").repartition(context.defaultParallelism, "place"), _CODES, CODE_ROWS, codes)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_places, q = sent.value
            reach = np.full(len(q), np.inf)
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from _found(q_places, q, _block(batch, i), k, metric, reach)

        near = blocks.mapInArrow(scan, _BOUNDS)
    else:
        asked, n = _numbered(_packed(queries, _QUERIES, QUERY_ROWS, lambda m: (unit(m, metric).astype("<f8").tobytes(),)), "block")
        asked = asked.select("block", F.col("n").alias("q_n"), F.col("places").alias("q_places"), "vectors")
        parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = _packed(shelf, _CODES, CODE_ROWS, codes)
        dealt = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("turn", F.xxhash64("places"))
        pairs = dealt.join(asked, "block").repartition(parts, "block", "turn")

        def scan_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    q = np.frombuffer(batch.column("vectors")[i].as_py(), "<f8").reshape(batch.column("q_n")[i].as_py(), -1)
                    q_places = np.frombuffer(batch.column("q_places")[i].as_py(), "<i8")
                    yield from _found(q_places, q, _block(batch, i), k, metric, np.full(len(q), np.inf))

        near = pairs.mapInArrow(scan_pairs, _BOUNDS)
    near = materialize(near, "bounds")
    kth = Window.partitionBy("query").orderBy("high", "pattern")
    reach = near.select("query", "pattern", "high").withColumn("r", F.row_number().over(kth)).where(F.col("r") <= k)
    reach = reach.groupBy("query").agg(F.max("high").alias("reach"))
    return near.join(reach, "query").where("low <= reach").select("query", "pattern")


def first_of_equals(shelf: DataFrame, k: int) -> DataFrame:
    """The ``k`` patterns of least id of each distinct vector."""
    same = Window.partitionBy("embedding").orderBy("pattern_id")
    return shelf.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k).drop("_r")


def search(queries: DataFrame, shelf: DataFrame, k: int, metric: str, max_distance: float | None, true_distances, **options) -> DataFrame:
    """query_id, pattern_id, distance, bug_type, severity, rank of the ``k`` nearest rows of ``shelf`` to each query with a vector."""
    vectors = F.col("embedding").cast("array<float>").alias("embedding")
    q = queries.where(F.col("embedding").isNotNull()).select("query_id", vectors)
    q = materialize(q.withColumn("place", F.monotonically_increasing_id()), "queries")
    p = first_of_equals(shelf.select("pattern_id", vectors, "bug_type", "severity"), k)
    p = materialize(p.withColumn("place", F.monotonically_increasing_id()), "shelf")
    near = candidates(q, p, k, metric, **options)
    both = near.join(p.withColumnRenamed("place", "pattern"), "pattern").join(
        q.select(F.col("place").alias("query"), "query_id", F.col("embedding").alias("asked")), "query"
    )
    id_type = queries.schema["query_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = true_distances(_matrix(batch.column("asked")), _matrix(batch.column("embedding")), metric)
                columns = [batch.column(c) for c in ("query_id", "pattern_id", "bug_type", "severity")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(d)], ["query_id", "pattern_id", "bug_type", "severity", "distance"])

    found = both.select("query_id", "pattern_id", "bug_type", "severity", "asked", "embedding").mapInArrow(
        measure, f"query_id {id_type}, pattern_id string, bug_type string, severity string, distance double"
    )
    if max_distance is not None:
        found = found.where(F.col("distance") <= max_distance)
    order = Window.partitionBy("query_id").orderBy("distance", "pattern_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
