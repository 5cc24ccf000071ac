"""Operator 9: documents packed into token sequences by bounded-space best fit.

Every task reads its documents once and keeps at most `open_windows` windows open. A piece goes to the window that it
fills best. Where none has room and no more may be opened, the fullest window is emitted: if at least `least_piece` ids
still fit there, the head of the piece tops it up first, so little is padded. Texts longer than a window are cut into
whole windows and a rest. What is open at the end of a task is leftover; leftovers of all tasks are merged by the same
rule, in rounds, until one task holds the rest. A round leaves `open_windows` of up to `merge_rows` windows per task,
so no task ever gets more than that many rows, whatever the input.

Null and empty texts are the end id alone. Repeated rows are packed each on their own; a null doc_id is kept; an empty
table gives no sequence.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcpulse.llm.common import texts, written
from srcpulse.llm.tokens import codec

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, leftover boolean"
MOVES = "sequence_id long, into long, base long, used long, leftover boolean"
#: Sequence ids are a task's number times this, plus a running number.
PER_TASK = 1 << 36
#: Rows of one output batch.
OUT_ROWS = 20_000


class Windows:
    """At most `most` open windows of `capacity` ids, by free room."""

    def __init__(self, capacity: int, most: int, number: Callable[[], int]) -> None:
        self.capacity, self.most, self._number = capacity, most, number
        self.open: list[tuple[int, int]] = []  # (room, window), least room first

    def fullest_room(self, size: int) -> int:
        """0 if `size` ids fit somewhere or a window may be opened, else the room of the fullest window."""
        return 0 if len(self.open) < self.most or self.open[-1][0] >= size else self.open[0][0]

    def emit_fullest(self) -> int:
        return self.open.pop(0)[1]

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) of `size` ids: the window with least room that holds them, else a new one."""
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, window = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                self.emit_fullest()
            room, window = self.capacity, self._number()
        if room > size:
            insort(self.open, (room - size, window))
        return window, self.capacity - room


def _numbers(first: int) -> Callable[[], int]:
    numbers = iter(range(first, first + PER_TASK))
    return lambda: next(numbers)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pack_texts(encode: Callable[[str], np.ndarray], end: int, capacity: int, most: int, least_piece: int, step: int):
    schema = pa.schema([(n, pa.bool_() if n == "leftover" else pa.int64()) for n in (c.split()[0] for c in PIECES.split(", "))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbers((step << 56) + TaskContext.get().partitionId() * PER_TASK)
        windows = Windows(capacity, most, number)
        done: list[tuple] = []
        waiting: dict[int, list[tuple]] = {}  # the pieces of open windows

        def put(doc: int | None, ids: bytes, start: int, size: int, total: int) -> None:
            window, offset = windows.place(size)
            piece = (doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), total, window, offset)
            waiting.setdefault(window, []).append(piece)
            if offset + size == capacity:
                close(window)

        def close(window: int) -> None:
            done.extend((*p, False) for p in waiting.pop(window))

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text), np.uint32(end)).astype("<u4").tobytes()
                total, start = len(ids) // 4, 0
                while total - start >= capacity:  # whole windows
                    part = zlib.crc32(ids[4 * start : 4 * (start + capacity)])
                    done.append((doc, start, capacity, part, total, number(), 0, False))
                    start += capacity
                while start < total:
                    size = total - start
                    if room := windows.fullest_room(size):
                        if room >= least_piece:
                            put(doc, ids, start, room, total)
                            start += room
                            continue
                        close(windows.emit_fullest())
                    put(doc, ids, start, size, total)
                    start = total
                if len(done) >= OUT_ROWS:
                    yield _table(done, schema)
                    done.clear()
        yield _table(done + [(*p, True) for pieces in waiting.values() for p in pieces], schema)

    return pack


def _merge_windows(capacity: int, most: int, step: int):
    schema = pa.schema([(n, pa.bool_() if n == "leftover" else pa.int64()) for n in (c.split()[0] for c in MOVES.split(", "))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(capacity, most, _numbers((step << 56) + TaskContext.get().partitionId() * PER_TASK))
        moves = []
        for batch in batches:
            for window, used in zip(batch.column("sequence_id").to_pylist(), batch.column("used").to_pylist(), strict=True):
                into, base = windows.place(used)
                moves.append((window, into, base, used))
        still = {w for _, w in windows.open}
        yield _table([(*m, m[1] in still) for m in moves], schema)

    return merge


def pack(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = 0, capacity: int = 1024,
    open_windows: int = 16, least_piece: int = 16, merge_rows: int = 8192,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    fit = _pack_texts(lambda t: codec(tokenizer).ids(t), end, capacity, open_windows, least_piece, 0)
    pieces = written(texts(docs, id_col, text_col).mapInArrow(fit, PIECES), "pack-pieces")
    left = pieces.where("leftover").groupBy("sequence_id").agg(F.sum("length").alias("used"))
    moves = None
    for step in range(1, 100):
        n = left.count()
        if n == 0:
            break
        tasks = -(-n // max(merge_rows, 4 * open_windows))  # each round leaves a quarter at most
        dealt = left.repartition(tasks, "sequence_id").sortWithinPartitions(F.desc("used"), "sequence_id")
        made = written(dealt.mapInArrow(_merge_windows(capacity, open_windows, step), MOVES), "pack-moves")
        now = made.select("sequence_id", "into", "base")
        if moves is None:
            moves = now
        else:
            later = now.select(F.col("sequence_id").alias("into"), F.col("into").alias("last"), F.col("base").alias("more"))
            moves = moves.join(later, "into", "left").select(
                "sequence_id", F.coalesce("last", "into").alias("into"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base")
            )
        if tasks == 1:
            break
        left = made.where("leftover").groupBy(F.col("into").alias("sequence_id")).agg(F.sum("used").alias("used"))
    pieces = pieces.drop("leftover")
    if moves is None:
        return pieces
    return pieces.join(moves, "sequence_id", "left").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("into", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )
