"""Operator 3: token ids in files of Simple-8b words, and back.

File format: a Parquet table of blocks, ascending in (shard, block). A block holds whole documents, about `block_ids`
ids: `doc_id` and `ends` (ids of the block up to and with each document), `words` (little-endian 64-bit
Simple-8b words, selector in the top 4 bits, first id in the lowest bits), `escapes` (uint32 position and value of each
id that needs more than `escape_bits` bits; its place among the words holds 0), `first` (ids of the shard before the
block) and `n_ids`. So each block is decoded alone, and any document is found by its offset.

Documents are encoded where they are read; their ids are range-partitioned by (doc_id, hash of the text), and a task writes one shard. Null texts count as empty, null
doc_ids come first, repeated rows are written each on their own, in any order among equals; an empty table gives an
empty one. `read_documents` takes the offset of a shard from the totals of the shards, one number per shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcpulse.llm.common import texts, written
from srcpulse.llm.tokens import codec

BLOCKS = "shard int, block int, first long, n_ids long, doc_id array<long>, ends array<long>, words binary, escapes binary"
#: Simple-8b, fixed values: (ids in a word, bits of each), by selector from 2; 240 and 120 zeros by selectors 0 and 1.
SELECTORS = (
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
COUNTS = np.array([240, 120, *(n for n, _ in SELECTORS)])
WIDTHS = np.array([0, 0, *(b for _, b in SELECTORS)])
#: Bits of each value below 2 ** 16.
BITS = np.array([n.bit_length() for n in range(1 << 16)], np.uint8)


def simple8b(ids: np.ndarray, escape_bits: int = 15) -> tuple[bytes, bytes]:
    """(words, escapes) of unsigned ids. A last word may hold fewer ids than its selector says; the reader knows how many."""
    out = np.flatnonzero(ids >> escape_bits)
    escapes = np.stack([out.astype("<u4"), ids[out].astype("<u4")], axis=1).tobytes()
    values = ids.astype(np.uint64)
    values[out] = 0
    n = len(values)
    if not n:
        return b"", escapes
    # The largest width of the 1, 2, 4 ... ids from each place on; beyond the end there are only zeros.
    width = np.zeros(n + 240, np.uint8)
    width[:n] = BITS[values] if escape_bits <= 16 else np.ceil(np.log2(values + np.uint64(1)))
    widest = {1: width}
    for size in (2, 4, 8, 16, 32, 64, 128):
        half = widest[size // 2]
        widest[size] = np.maximum(half[: len(half) - size // 2], half[size // 2 :])
    selector = np.full(n, 15, np.uint8)
    for s in range(14, -1, -1):  # the selector with most ids wins
        size = 1 << int(COUNTS[s]).bit_length() - 1
        selector[np.maximum(widest[size][:n], widest[size][COUNTS[s] - size :][:n]) <= WIDTHS[s]] = s
    take = COUNTS[selector]
    starts, i, step = [], 0, take.tolist()
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts)
    kinds = selector[at]
    words = kinds.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        rows = np.flatnonzero(kinds == s)
        if len(rows):
            places = at[rows, None] + np.arange(COUNTS[s])
            some = np.where(places < n, values[np.minimum(places, n - 1)], np.uint64(0))
            words[rows] |= np.bitwise_or.reduce(some << (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])), axis=1)
    return words.astype("<u8").tobytes(), escapes


def from_simple8b(words: bytes, escapes: bytes, n: int) -> np.ndarray:
    """The `n` ids, one array operation per selector."""
    packed = np.frombuffer(words, "<u8")
    kinds = (packed >> np.uint64(60)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(COUNTS[kinds])])
    ids = np.zeros(int(starts[-1]), "<u4")
    for s in range(2, 16):
        rows = np.flatnonzero(kinds == s)
        if len(rows):
            shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])
            ids[starts[rows, None] + np.arange(COUNTS[s])] = packed[rows, None] >> shifts & np.uint64((1 << int(WIDTHS[s])) - 1)
    odd = np.frombuffer(escapes, "<u4").reshape(-1, 2)
    ids[odd[:, 0]] = odd[:, 1]
    return ids[:n]


def write_ids(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = 0, block_ids: int = 32_768,
    escape_bits: int = 15,
) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; the table of blocks, read back."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(tokenizer)
        for batch in batches:
            ids = [made.ids(text) for text in batch.column("text").to_pylist()]
            wide = [len(x) > 0 and int(x.max()) >= 1 << 16 for x in ids]
            raw = [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(ids, wide, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(wide), pa.array(raw, pa.binary())], ["doc_id", "tie", "wide", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first, total = TaskContext.get().partitionId(), 0, 0, 0
        last = np.array([end], "<u4")
        keys: list = []
        ends: list[int] = []
        parts: list[np.ndarray] = []

        def full() -> pa.RecordBatch:
            row = [shard, block, first, total, keys, ends, *simple8b(np.concatenate(parts), escape_bits)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for doc, wide, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "wide", "ids")), strict=True):
                parts += [np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4"), last]
                keys.append(doc)
                total += len(parts[-2]) + 1
                ends.append(total)
                if total >= block_ids:
                    yield full()
                    block, first, total = block + 1, first + total, 0
                    keys, ends, parts = [], [], []
        if keys:
            yield full()

    # Texts stay where they are: their ids, two bytes each, are written, and only those are put in order.
    rows = texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    encoded = written(rows.mapInArrow(encode, "doc_id long, tie long, wide boolean, ids binary"), "token-ids")
    ordered = encoded.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    return written(ordered.mapInArrow(pack, BLOCKS), "token-files", compression="zstd")


def read_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids = from_simple8b(b["words"], b["escapes"], b["n_ids"]).astype("<u4").tobytes()
                cuts = [0, *b["ends"]]
                pairs = list(zip(cuts, cuts[1:], strict=False))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b["doc_id"], pa.int64()),
                        pa.array([b["shard"]] * len(pairs), pa.int32()),
                        pa.array([b["first"] + i for i, _ in pairs], pa.int64()),
                        pa.array([j - i for i, j in pairs], pa.int64()),
                        pa.array([zlib.crc32(ids[4 * i : 4 * j]) for i, j in pairs], pa.int64()),
                    ],
                    ["doc_id", "shard", "local", "n_tokens", "ids_crc32"],
                )

    found = blocks.mapInArrow(decode, "doc_id long, shard int, local long, n_tokens long, ids_crc32 long")
    totals = blocks.groupBy(F.col("shard").alias("of")).agg(F.sum("n_ids").alias("ids"))
    # One row per shard, so the window and the broadcast hold as many rows as the writer had tasks.
    before = totals.select("of", F.coalesce(F.sum("ids").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return found.join(F.broadcast(before), found.shard == before.of).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )
