"""Operator 1: repeated byte strings by suffix order and longest-previous-factor arrays.

A window is a string of `least` bytes; windows that occur more than once are looked for in three steps.

1. Each window has an anchor: of its `gram`-byte strings the one with the least hash, the first of equals. Equal windows
   have equal anchors at equal offsets. Neighbouring windows share anchors, so a document gives a row for each run of
   windows with one anchor (a segment): hash of the anchor, hash of the segment, place. Counting those rows, combined
   before the shuffle, shows the segments that occur again whole, and the anchors that occur in different segments.
2. Of the latter, one text per different segment is fetched, and the segments of an anchor are put in suffix order: ranks
   by prefix doubling, up to `least` bytes. Where neighbours in that order share `least` bytes, the longest previous
   factor of a place (through its previous or next smaller place in suffix order) has that length if and only if the
   run of such neighbours holds a smaller place; the same with larger places gives the later occurrences. An anchor with
   more than `bucket_segments` segments is dealt on by the hash of each window, and counted instead.
3. Places go back to their documents, windows are united to spans, and spans are cut out.

`keep="first"` removes later copies only (order: doc_id, hash of the text, place); `keep="none"` removes all copies.
Null and empty texts, and texts under `least` bytes, lose nothing. Rows equal in doc_id and text count as copies of each
other; with `keep="first"` they are treated alike, so that the first of them loses what it shares with the others only if
some other row had it before. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcpulse.llm.common import kept, texts, written

SEGMENTS = "doc_id long, text_hash long, anchor long, segment long, start int, windows int, times int, stride int"
#: Windows of a long text that are looked at together, and the bits that number them.
CHUNK = 1 << 20
PLACE = np.uint64((1 << 21) - 1)
#: An odd number, and its inverse modulo 2**64: the base of the rolling hash.
BASE = 0x9E3779B97F4A7C15 | 1
#: Segments that a task puts in suffix order together.
GATHERED = 2_500
BROADCAST_ROWS = 500_000


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return kept("powers", n, lambda: (run(BASE), run(pow(BASE, -1, 2**64))))


def segments(raw: bytes, least: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, segment hash, start, windows) of the runs of windows with one anchor."""
    view = memoryview(raw)
    for first in range(0, max(0, len(raw) - least + 1), CHUNK):
        part = np.frombuffer(view[first : first + CHUNK + least - 1], np.uint8)
        n = len(part)
        up, down = _powers(CHUNK + least) if n > 1 << 16 else (p[: 1 << 16] for p in _powers(CHUNK + least))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        grams = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(32)
        order = grams & ~PLACE | np.arange(len(grams), dtype=np.uint64)
        size, reach = 1, least - gram + 1
        while 2 * size <= reach:
            order = np.minimum(order[: len(order) - size], order[size:])
            size *= 2
        order = np.minimum(order[: len(order) - (reach - size)], order[reach - size :]) if reach > size else order
        at = (order & PLACE).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        ends = np.append(starts[1:], len(at))
        hashes = [xxhash.xxh3_64_intdigest(view[first + a : first + b + least - 1]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        yield grams[at[starts]].view(np.int64), np.array(hashes, np.uint64).view(np.int64), first + starts, ends - starts


def _folded(anchor: np.ndarray, segment: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring equal segments at equal distances as one row, with `times` and `stride`: texts of a short period."""
    n = len(start)
    gap = np.diff(start, append=start[-1] + 1)
    same = np.zeros(n, bool)  # as the one before, and as far from it as the one after
    same[1:] = (anchor[1:] == anchor[:-1]) & (segment[1:] == segment[:-1])
    same[2:] &= ~same[1:-1] | (gap[1:-1] == gap[:-2])
    heads = np.flatnonzero(~same)
    return anchor[heads], segment[heads], start[heads], windows[heads], np.diff(heads, append=n), gap[heads]


def _segment_rows(docs: DataFrame, least: int, gram: int) -> DataFrame:
    names = [c.split()[0] for c in SEGMENTS.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, held = batch.column("doc_id"), batch.column("text_hash"), []
            for i, text in enumerate(batch.column("text").to_pylist()):
                held += [(i, _folded(*found)) for found in segments(text.encode(), least, gram)]
            if held:
                rows = pa.array(np.repeat([i for i, _ in held], [len(x[0]) for _, x in held]))
                columns = [np.concatenate(c) for c in zip(*(x for _, x in held), strict=True)]
                types = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
                arrays = [ids.take(rows), hashes.take(rows), *(pa.array(c).cast(t) for c, t in zip(columns, types, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(scan, SEGMENTS)


def suffix_ranks(raw: np.ndarray, places: np.ndarray, least: int) -> np.ndarray:
    """Ranks of the suffixes at `places`, compared by their first `least` bytes; each has as many."""
    if least < 8:
        width = least
    else:
        width = 8
    wide = np.concatenate([raw, np.zeros(width, np.uint8)]).astype(np.uint64)
    key = np.zeros(len(raw), np.uint64)
    for i in range(width):
        key = key << np.uint64(8) | wide[i : i + len(raw)]
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)

    def joined(at: np.ndarray, step: int) -> np.ndarray:
        second = rank[np.minimum(at + step, len(rank) - 1)]
        return np.unique(rank[at] * (len(rank) + 1) + second, return_inverse=True)[1].astype(np.int64)

    while 2 * width <= least:
        rank = joined(np.arange(len(rank)), width)
        width *= 2
    return joined(places, least - width) if width < least else rank[places]


def shared_places(rank: np.ndarray, age: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(earlier, other) for each suffix: its longest previous factor, or also its longest later factor, has the full length.

    In suffix order, suffixes of one rank are the runs of neighbours with a full common prefix. Within a run sorted by
    age the previous smaller value of a suffix is the one before, and there is none only for the first."""
    order = np.lexsort((age, rank))
    before = np.zeros(len(order), bool)
    before[1:] = rank[order][1:] == rank[order][:-1]
    after = np.append(before[1:], False)
    earlier, other = np.zeros(len(order), bool), np.zeros(len(order), bool)
    run = np.cumsum(~before)
    oldest = age[order][np.flatnonzero(~before)][run - 1] if len(order) else age
    earlier[order] = age[order] > oldest
    other[order] = before | after
    return earlier, other


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


PLACED = "anchor long, segment long, earlier array<struct<a:int,b:int>>, other array<struct<a:int,b:int>>"
RUN = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _in_suffix_order(fetched: DataFrame, least: int) -> DataFrame:
    """Windows of each segment that occur earlier, or elsewhere at all, in the anchor's other segments."""

    def place(rows: list[dict]) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(r["raw"] for r in rows), np.uint8)
        sizes = np.array([len(r["raw"]) for r in rows])
        counts = sizes - least + 1
        first, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(rows)), counts)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        keys = [(r["doc_id"] is None, r["doc_id"] or 0, r["text_hash"], r["start"]) for r in rows]
        age = np.empty(len(rows), np.int64)
        age[sorted(range(len(rows)), key=keys.__getitem__)] = np.arange(len(rows))
        earlier, other = shared_places(suffix_ranks(raw, first[of] + offset, least), age[of])
        cuts = np.cumsum(counts)[:-1]
        as_spans = lambda flags: pa.array([[{"a": a, "b": b} for a, b in _runs(f)] for f in np.split(flags, cuts)], RUN)
        return pa.RecordBatch.from_arrays(
            [pa.array([r["anchor"] for r in rows], pa.int64()), pa.array([r["segment"] for r in rows], pa.int64()), as_spans(earlier), as_spans(other)],
            ["anchor", "segment", "earlier", "other"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            if len(held) >= GATHERED and held[0]["anchor"] != held[-1]["anchor"]:
                cut = len(held)
                while held[cut - 1]["anchor"] == held[-1]["anchor"]:
                    cut -= 1
                yield place(held[:cut])
                held = held[cut:]
        if held:
            yield place(held)

    return fetched.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(scan, PLACED)


def _by_window_hash(fetched: DataFrame, least: int) -> DataFrame:
    """The same for anchors with very many segments: windows are counted by their hash, wherever they go."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                view, n = memoryview(r["raw"]), len(r["raw"]) - least + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([r[c]] * n, pa.int64()) for c in ("anchor", "segment")), pa.array(range(n), pa.int32()),
                        pa.array([xxhash.xxh3_128_digest(view[i : i + least]) for i in range(n)], pa.binary()),
                        *(pa.array([r[c]] * n, t) for c, t in (("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()))),
                    ],
                    ["anchor", "segment", "at", "window", "doc_id", "text_hash", "start"],
                )

    rows = fetched.mapInArrow(windows, "anchor long, segment long, at int, window binary, doc_id long, text_hash long, start int")
    age = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash", "start")
    rows = written(rows.select("anchor", "segment", "at", "window", age.alias("age")), "repeats-windows")
    many = rows.groupBy("window").agg(F.min("age").alias("oldest"), F.count("*").alias("n")).where("n > 1")
    flags = rows.join(many, "window").select("anchor", "segment", "at", (F.col("age") > F.col("oldest")).alias("is_earlier"))
    one = lambda c: F.sort_array(F.collect_list(c))
    span = F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))
    return flags.groupBy("anchor", "segment").agg(one(F.when(F.col("is_earlier"), span)).alias("earlier"), one(span).alias("other"))


def _fetched(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """`wanted` rows (anchor, segment, doc_id, text_hash, start, windows) with the bytes of the segment."""
    per_doc = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "segment", "start", "windows")).alias("wanted"))
    per_doc = per_doc.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "wanted")
    # Rows equal in doc_id and text have the same bytes, so whichever comes gives them; distinct() below leaves one.
    rows = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "segment", "doc_id", "text_hash", "start", "raw"]
        types = [*[pa.int64()] * 4, pa.int32(), pa.binary()]
        for batch in batches:
            for r in batch.to_pylist():
                raw = r["text"].encode()
                out = [(w["anchor"], w["segment"], r["doc_id"], r["text_hash"], w["start"], raw[w["start"] : w["start"] + w["windows"] + least - 1]) for w in r["wanted"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    found = rows.select("doc_id", "text_hash", "text", "wanted").mapInArrow(
        cut, "anchor long, segment long, doc_id long, text_hash long, start int, raw binary"
    )
    return written(found.dropDuplicates(["anchor", "segment"]), "repeats-fetched")


def repeated_spans(docs: DataFrame, *, least: int = 400, gram: int = 100, keep: str = "none", bucket_segments: int = 2_000) -> DataFrame:
    """doc_id, text_hash, spans (start, end in bytes, maximal, sorted) of the rows of (doc_id, text, text_hash) that lose some."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    rows = written(_segment_rows(docs, least, gram), "repeats-segments")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash", "start", "windows")
    kinds = rows.groupBy("anchor", "segment").agg(F.sum("times").alias("n"), F.min(place).alias("first"))
    again = kinds.groupBy("anchor").agg(F.count("*").alias("different"), F.sum("n").alias("all")).where("all > 1").select("anchor", "different")
    kinds = written(kinds.join(again, "anchor"), "repeats-kinds")
    mixed = kinds.where("different > 1").select("anchor", "segment", "different", "first.doc_id", "first.text_hash", "first.start", "first.windows")
    if mixed.isEmpty():
        placed = docs.sparkSession.createDataFrame([], PLACED)
    else:
        fetched = _fetched(docs, mixed, least)
        hot = written(mixed.where(F.col("different") > bucket_segments).select("anchor").distinct(), "repeats-hot")
        if hot.isEmpty():
            placed = _in_suffix_order(fetched, least)
        else:
            placed = _in_suffix_order(fetched.join(hot, "anchor", "left_anti"), least).unionByName(
                _by_window_hash(fetched.join(hot, "anchor", "left_semi"), least)
            )
        placed = written(placed, "repeats-placed")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("windows").alias("b")))
    nothing = F.array().cast("array<struct<a:int,b:int>>")
    found = rows.join(kinds.select("anchor", "segment", "n", "first"), ["anchor", "segment"]).join(placed, ["anchor", "segment"], "left")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")) & (F.col("start") == F.col("first.start"))
    piece = lambda start, times, runs: F.struct(start.alias("start"), times.alias("times"), "stride", runs.alias("runs"))
    if keep == "none":
        runs = F.when(F.col("n") > 1, whole).otherwise(F.coalesce("other", nothing))
        pieces = F.array(piece(F.col("start"), F.col("times"), runs))
    else:
        later = piece(F.col("start") + F.col("stride"), F.col("times") - 1, whole)
        pieces = F.when(is_first, F.array(piece(F.col("start"), F.lit(1), F.coalesce("earlier", nothing)), later))
        pieces = pieces.otherwise(F.array(piece(F.col("start"), F.col("times"), whole)))
    found = found.select("doc_id", "text_hash", F.explode(pieces).alias("run")).where((F.size("run.runs") > 0) & (F.col("run.times") > 0))
    found = found.groupBy("doc_id", "text_hash").agg(F.collect_set("run").alias("runs"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for row in batch.column("runs").to_pylist():
                marks = sorted(
                    (x["start"] + t * x["stride"] + r["a"], x["start"] + t * x["stride"] + r["b"] - 1 + least)
                    for x in row for t in range(x["times"]) for r in x["runs"]
                )
                out: list[list[int]] = []
                for a, b in marks:
                    if out and a <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], b)
                    else:
                        out.append([a, b])
                spans.append([{"a": a, "b": b} for a, b in out])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(spans, RUN)], ["doc_id", "text_hash", "spans"])

    return found.mapInArrow(unite, "doc_id long, text_hash long, spans array<struct<a:int,b:int>>")


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False, with_text: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and `kept`, the bytes that stay, and `text`, the same as a string) of every row.

    Spans are cut at bytes: where a cut falls inside a character, what is left of it stands as U+FFFD in `text` (not in `kept`)."""
    rows = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    spans = repeated_spans(rows, **options).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "spans")
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, given = [], batch.column("text").to_pylist()
            for text, spans in zip(given, batch.column("spans").to_pylist(), strict=True):
                raw, at, parts, n = text.encode(), 0, [], 0
                for s in spans or ():
                    parts.append(raw[at : s["a"]])
                    at, n = s["b"], n + s["b"] - s["a"]
                kept = b"".join([*parts, raw[at:]])
                out.append((len(raw), n, len(spans or ()), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
            arrays += [pa.array(columns[4], pa.binary())] * with_bytes
            if with_text:
                arrays.append(pa.array([k.decode(errors="replace") if n else t for t, n, k in zip(given, columns[1], columns[4], strict=True)], pa.string()))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes + ["text"] * with_text
            yield pa.RecordBatch.from_arrays(arrays, names)

    return joined.mapInArrow(cut, KEPT + ", kept binary" * with_bytes + ", text string" * with_text)
