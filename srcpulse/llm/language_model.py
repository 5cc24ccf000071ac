"""Operator 12: n-gram scores through a log-frequency Bloom filter.

Tokens are words between ASCII white space, A-Z as a-z, and one end per text, which is also the context of the first word.

Training counts every n-gram up to `order` by its 64-bit hash: a task sums what it has seen and sends packed parts of the
hash range, each merged by one task into a written table. A count c becomes the level 1 + floor(log_base c), and the filter
holds the pairs (n-gram, 1) .. (n-gram, level): a part of the hash range is a bit array of its own, all of one length, with
`bits_per_entry` bits a pair. To read a count, levels are probed upwards until one is missing; the level stands for
the mean of its range. A missing n-gram is taken for present with the filter's error rate, a present one is never missed.
The probability of a word interpolates orders: p_k = (c(context word) + mu p_k-1) / (c(context) + mu), from the add-half p_1.

The filter grows with the corpus. Up to `broadcast_bytes` it goes to all workers. Beyond that it stays a table: chunks of
documents send each part the distinct n-grams that lie in it, a task that holds the part's bits answers with levels, and the
chunk is scored from the answers. Both ways probe the same bits and give the same scores.

The base score is exact: counts of words, not of hashes, are summed over the corpus; those of the `frequent` most common
words (over all documents) go to all tasks, other words of a document are joined with the table of counts.

Null and empty texts are one end. Repeated rows each count and are each returned. A null doc_id counts as an empty one for
held_out. Without training rows all counts are 0 and all scores 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcpulse.llm.common import texts, written

#: Stands for the end of a text among words: no word is empty.
END = b""
#: Words whose exact counts go to all tasks, at most.
FREQUENT = 200_000
#: N-grams that a task sums before it sends them; n-grams of a part, about; tokens of a chunk of documents.
HELD_GRAMS, PART_GRAMS, CHUNK_TOKENS = 6_000_000, 2_000_000, 1_000_000
BROADCAST_BYTES = 128 * 1024 * 1024
#: Words whose hashes a worker keeps.
KEPT_WORDS = 1_000_000
COUNTS = "part int, grams binary, counts binary"
CHUNK = "chunk long, doc_id long, text_hash long, hashes binary"


@dataclass(frozen=True)
class Shape:
    """What scores depend on besides the counts."""

    order: int = 2
    base: float = 2.0
    bits_per_entry: float = 10.0
    probes: int = 6
    mu: float = 100.0


@dataclass(frozen=True)
class Model:
    """Exact words (word, c in training, everywhere), their totals, and the parts (part, bits) of the filter, each of `part_bits` bits."""

    shape: Shape
    words: DataFrame
    n_train: int
    n_distinct: int
    filter: DataFrame
    parts: int
    part_bits: int


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


class _Words(dict):
    """Number of each word that a task has met, in order; `hashes` and what else belongs to a number are arrays."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[bytes] = []
        self.hashes = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def numbers(self, texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of end, words, end of all texts in a row, first place of each text)."""
        if len(self.words) > KEPT_WORDS:
            self.clear()
            self.words, self.hashes = [], self.hashes[:0]
        found, sizes = [], []
        for text in texts_:
            words = words_of(text)
            found += [END, *words, END]
            sizes.append(len(words) + 2)
        out = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        new = [xxhash.xxh3_64_intdigest(w) for w in self.words[len(self.hashes) :]]
        self.hashes = np.concatenate([self.hashes, np.array(new, np.uint64)])
        return out, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[:-1]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _within(starts: np.ndarray, n: int) -> np.ndarray:
    """The place of each of `n` tokens within its text."""
    sizes = np.diff(starts, append=n)
    return np.arange(n) - np.repeat(starts, sizes)


def grams(hashes: np.ndarray, within: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams of each order that end at each token. A token at place p of its text ends n-grams of up to
    p + 1 tokens; hashes beyond that cross texts and stand for nothing."""
    out = [hashes]
    for _ in range(order - 1):
        out.append(_mixed(np.concatenate([out[-1][:1], out[-1][:-1]]), hashes))
    return out


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of the hash, so sorted hashes are sorted by part."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def levels_of(counts: np.ndarray, base: float) -> np.ndarray:
    """1 + floor(log_base(count)), from a table of the least count of each level, so no rounding decides."""
    least, top = [1], int(counts.max(initial=1))
    while least[-1] <= top:
        least.append(max(least[-1] + 1, math.ceil(base ** len(least))))
    return np.searchsorted(np.array(least), counts, side="right").astype(np.uint8)


def level_means(base: float) -> np.ndarray:
    """The mean of the counts that each level stands for; 0 for level 0."""
    least = [1]
    while len(least) < 257:
        least.append(max(least[-1] + 1, math.ceil(min(base ** len(least), 2.0**62))))
    return np.array([0.0, *((a + b - 1) / 2 for a, b in zip(least, least[1:], strict=False))])


def _hashed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of the places of each n-gram: double hashing over 32 bits."""
    return keys.astype(np.uint32), (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _places(start: np.ndarray, step: np.ndarray, turn: int, bits: int) -> np.ndarray:
    """The bit for one turn, which numbers level and probe, within a part of `bits` bits."""
    return (start + step * np.uint32(turn)).astype(np.uint64) * np.uint64(bits) >> np.uint64(32)


def filled(keys: np.ndarray, levels: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """The bit array of one part, as bytes."""
    on = np.zeros(bits, bool)
    start, step = _hashed(keys)
    for level in range(1, int(levels.max(initial=0)) + 1):
        some = levels >= level
        start, step, levels = start[some], step[some], levels[some]
        for turn in range(level * probes, (level + 1) * probes):
            on[_places(start, step, turn, bits)] = True
    return np.packbits(on, bitorder="little")


def probed(keys: np.ndarray, at: np.ndarray, raw: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """Levels of the n-grams, whose part's bits start at byte `at` of `raw`: probed upwards until one is missing."""
    levels, left = np.zeros(len(keys), np.uint8), np.arange(len(keys))
    start, step = _hashed(keys)
    level = 1
    while len(left) and level < 256:
        for turn in range(level * probes, (level + 1) * probes):
            place = _places(start, step, turn, bits)
            hit = raw[at + (place >> np.uint64(3)).astype(np.int64)] & (np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)) != 0
            left, at, start, step = left[hit], at[hit], start[hit], step[hit]
        levels[left] = level
        level += 1
    return levels


def word_counts(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, c (in training rows), everywhere: exact counts over all rows, the end among them; a written table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def sent() -> pa.RecordBatch:
            every = list(held[0] | held[1])
            columns = [pa.array(every, pa.binary())] + [pa.array([c[w] for w in every], pa.int64()) for c in held]
            return pa.RecordBatch.from_arrays(columns, ["word", "out", "c"])

        for batch in batches:
            for text, is_train in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("train").to_pylist(), strict=True):
                held[is_train].update(words_of(text))
                held[is_train][END] += 1
            if sum(map(len, held)) > HELD_GRAMS // 10:
                yield sent()
                held = (Counter(), Counter())
        yield sent()

    rows = texts(docs.withColumn("__train", train), id_col, text_col, "__train").withColumnRenamed("__train", "train")
    found = rows.select("text", "train").mapInArrow(count, "word binary, out long, c long").groupBy("word")
    return written(found.agg(F.sum("c").alias("c"), F.sum(F.col("c") + F.col("out")).alias("everywhere")), "model-words")


def gram_counts(docs: DataFrame, order: int, parts: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, grams (sorted 64-bit hashes), counts of all n-grams of the rows, a row per part; a written table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n = _Words(), [], 0

        def sent() -> pa.RecordBatch:
            keys, counts = _summed(np.concatenate(held))
            cuts = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
            some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            cut = lambda x, t: pa.array([x[cuts[p] : cuts[p + 1]].astype(t).tobytes() for p in some], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), cut(keys, "<u8"), cut(counts, "<i8")], ["part", "grams", "counts"])

        for batch in batches:
            numbers, starts = known.numbers(batch.column("text").cast(pa.binary()).to_pylist())
            within = _within(starts, len(numbers))
            # The end that leads a text is a context and no token of it.
            held += [one[within >= max(k, 1)] for k, one in enumerate(grams(known.hashes[numbers], within, order))]
            n += order * len(numbers)
            if n > HELD_GRAMS:
                yield sent()
                held, n = [], 0
        if held:
            yield sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def merged() -> pa.RecordBatch:
            keys, counts = _summed(*(np.concatenate([np.frombuffer(x[i], "<u8" if i == 0 else "<i8") for x in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["part", "grams", "counts"])

        for batch in batches:
            for part, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if at is not None and part != at:
                    yield merged()
                    held = []
                at = part
                held.append((keys, counts))
        if held:
            yield merged()

    sent = texts(docs, id_col, text_col).select("text").mapInArrow(count, COUNTS)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(merge, COUNTS), "model-grams")


def fit(docs: DataFrame, train: Column, *, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text", part_grams: int = PART_GRAMS) -> Model:
    words = word_counts(docs, train, id_col=id_col, text_col=text_col)
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    parts = max(16, math.ceil(shape.order * total.n / part_grams))
    counts = gram_counts(docs.where(train), shape.order, parts, id_col=id_col, text_col=text_col)
    base, probes = shape.base, shape.probes

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(levels_of(np.frombuffer(c, "<i8"), base).sum(dtype=np.int64)) for c in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["entries"])

    # Parts are equal ranges of a hash, so the fullest one is little above the mean.
    most = counts.select("counts").mapInArrow(entries, "entries long").agg(F.max("entries")).first()[0] or 0
    bits = max(64, 8 * math.ceil(most * shape.bits_per_entry / 8))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, keys, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = filled(np.frombuffer(keys, "<u8"), levels_of(np.frombuffer(c, "<i8"), base), bits, probes)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([raw.tobytes()], pa.binary())], ["part", "bits"])

    return Model(shape, words, total.n, total.v, written(counts.mapInArrow(build, "part int, bits binary"), "model-filter"), parts, bits)


class _Scorer:
    """Scores of texts, given a look-up from n-gram hashes to levels."""

    def __init__(self, shape: Shape, n_train: int, n_distinct: int) -> None:
        self.shape, self._total, self._means = shape, n_train + 0.5 * (n_distinct + 1), level_means(shape.base)

    def keys(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """All n-grams that a score looks at."""
        within = _within(starts, len(hashes))
        return np.concatenate([one[within >= k] for k, one in enumerate(grams(hashes, within, self.shape.order))])

    def scores(self, hashes: np.ndarray, starts: np.ndarray, look_up, first: np.ndarray | None = None) -> np.ndarray:
        """log10 of the probability of each text; `first` has the levels of single tokens where they are known."""
        if not len(starts):
            return np.zeros(0)
        within = _within(starts, len(hashes))
        counts = self._means[look_up(hashes) if first is None else first]
        p = (counts + 0.5) / self._total
        for k, one in enumerate(grams(hashes, within, self.shape.order)[1:], start=1):
            some = np.flatnonzero(within >= k)
            context, counts = counts[some - 1], np.zeros(len(hashes))
            counts[some] = self._means[look_up(one[some])]
            p[some] = (counts[some] + self.shape.mu * p[some]) / (context + self.shape.mu)
        p[starts] = 1.0  # the end that leads a text
        return np.add.reduceat(np.log10(p), starts)


CHUNKED = [c.split()[0] for c in CHUNK.split(", ")]


def _chunks(docs: DataFrame, id_col: str, text_col: str, chunk_tokens: int) -> DataFrame:
    """chunk, doc_id, text_hash, hashes of (end, words, end) of every row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chunk, n = _Words(), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers, starts = known.numbers(batch.column("text").cast(pa.binary()).to_pylist())
            hashes, chunks = np.split(known.hashes[numbers], starts[1:]), []
            for one in hashes[: batch.num_rows]:
                if n and n + len(one) > chunk_tokens:
                    chunk, n = chunk + 1, 0
                n += len(one)
                chunks.append(chunk)
            raw = pa.array([one.tobytes() for one in hashes[: batch.num_rows]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), batch.column("doc_id"), batch.column("text_hash"), raw], CHUNKED)

    return texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")).mapInArrow(cut, CHUNK)


def _joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of several texts in a row, and the first place of each."""
    return np.frombuffer(b"".join(raw), "<u8"), np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw], dtype=np.int64)])[:-1]


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The words that are so common, over all documents, that at most `most` are."""
    of_size = words.groupBy(F.floor(F.log2("everywhere") * 8).alias("size")).count().orderBy(F.desc("size"))
    least, n = None, 0
    for row in of_size.toLocalIterator():  # at most 8 x 63 sizes
        n += row["count"]
        if n > most:
            break
        least = row["size"]
    if least is None:
        return words.limit(0)
    return words.where(F.floor(F.log2("everywhere") * 8) >= least)


def _base(docs: DataFrame, model: Model, id_col: str, text_col: str, frequent: int, raw_filter: np.ndarray | None) -> DataFrame:
    """rid, doc_id, text_hash, n_tokens, and n_known and base of the frequent words, others as `rare`, score where the filter is given."""
    log_of = lambda c: math.log10((c + 0.5) / (model.n_train + 0.5 * (model.n_distinct + 1)))
    table = {bytes(r.word): (log_of(r.c), int(r.c > 0)) for r in _frequent(model.words, frequent).toLocalIterator()}
    sent = docs.sparkSession.sparkContext.broadcast((table, raw_filter))
    scorer, probes, parts, bits = _Scorer(model.shape, model.n_train, model.n_distinct), model.shape.probes, model.parts, model.part_bits

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, raw = sent.value
        known = _Words()
        log_p, is_known, level = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint8)

        def look_up(keys: np.ndarray) -> np.ndarray:
            return probed(keys, part_of(keys, parts) * (bits // 8), raw, bits, probes)

        for batch in batches:
            if not batch.num_rows:
                continue
            before = len(known.words)
            numbers, starts = known.numbers(batch.column("text").cast(pa.binary()).to_pylist())
            before = before if before <= KEPT_WORDS else 0  # all was forgotten
            new = [table.get(w, (math.nan, 0)) for w in known.words[before:]]
            log_p = np.concatenate([log_p[:before], np.array([x for x, _ in new], np.float64)])
            is_known = np.concatenate([is_known[:before], np.array([x for _, x in new], np.int64)])
            sizes = np.diff(starts, append=len(numbers))
            is_token = np.ones(len(numbers), bool)
            is_token[starts] = False
            each = np.where(is_token, log_p[numbers], 0.0)
            odd = np.flatnonzero(np.isnan(each))
            each[odd] = 0.0
            doc = np.repeat(np.arange(len(starts)), sizes)[odd]
            pair, tf = np.unique(doc << 32 | numbers[odd], return_counts=True)
            word_of, cuts = (pair & (2**32 - 1)).tolist(), np.searchsorted(pair >> 32, np.arange(len(starts) + 1))
            rare = pa.StructArray.from_arrays([pa.array([known.words[i] for i in word_of], pa.binary()), pa.array(tf.astype(np.int64))], ["word", "tf"])
            score = pa.nulls(batch.num_rows, pa.float64())
            if raw is not None:
                level = np.concatenate([level[:before], look_up(known.hashes[before:])])
                score = pa.array(scorer.scores(known.hashes[numbers], starts, look_up, level[numbers]))
            columns = [
                batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes - 1), pa.array(np.add.reduceat(is_known[numbers] * is_token, starts)),
                pa.array(np.add.reduceat(each, starts)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), rare), score,
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_tokens", "n_known", "base", "rare", "score"])

    rows = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    found = rows.mapInArrow(scan, "doc_id long, text_hash long, n_tokens long, n_known long, base double, rare array<struct<word:binary,tf:long>>, score double")
    return written(found.withColumn("rid", F.monotonically_increasing_id()), "model-scan")


def _in_order(*columns: str) -> list:
    return [F.col(c).asc_nulls_first() for c in columns]


def routed_scores(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, text_hash, score of the distinct documents, by questions that go to the parts of the filter."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = written(_chunks(docs, id_col, text_col, chunk_tokens), "model-chunks")
    scorer, probes, parts, bits = _Scorer(model.shape, model.n_train, model.n_distinct), model.shape.probes, model.parts, model.part_bits

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def asked() -> pa.RecordBatch:
            keys = np.unique(scorer.keys(*_joined(held)))
            cuts = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
            some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            columns = [pa.array(some, pa.int32()), pa.array([at] * len(some), pa.int64()), pa.array([keys[cuts[p] : cuts[p + 1]].tobytes() for p in some], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "chunk", "raw"])

        for batch in batches:
            for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                if held and chunk != at:
                    yield asked()
                    held = []
                at = chunk
                held.append(raw)
        if held:
            yield asked()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, None
        for batch in batches:
            chunks_, keys_, levels_ = [], [], []
            for part, chunk, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if chunk is None:  # the part's bits come before its questions
                    at, mine = part, np.frombuffer(raw, np.uint8)
                    continue
                keys = np.frombuffer(raw, "<u8")
                levels = probed(keys, np.zeros(len(keys), np.int64), mine, bits, probes) if at == part else np.zeros(len(keys), np.uint8)
                chunks_.append(chunk)
                keys_.append(raw)
                levels_.append(levels.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(chunks_, pa.int64()), pa.array(keys_, pa.binary()), pa.array(levels_, pa.binary())], ["chunk", "hashes", "levels"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, table = None, [], None
        for batch in batches:
            docs_, ids, texts_, scores = [], [], [], []

            def done() -> list[float]:
                return scorer.scores(*_joined(docs_), lambda keys: table[1][np.searchsorted(table[0], keys)]).tolist()

            for chunk, levels, doc, text, raw in zip(*(batch.column(c).to_pylist() for c in ("chunk", "levels", "doc_id", "text_hash", "hashes")), strict=True):
                if chunk != at:
                    scores += done()
                    docs_, at, held, table = [], chunk, [], None
                if levels is not None:
                    held.append((np.frombuffer(raw, "<u8"), np.frombuffer(levels, np.uint8)))
                    continue
                if table is None:
                    keys, found = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(keys, kind="stable")
                    table, held = (keys[order], found[order]), []
                docs_.append(raw)
                ids.append(doc)
                texts_.append(text)
            scores += done()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts_, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "text_hash", "score"])

    filters = model.filter.select("part", F.lit(None).cast("long").alias("chunk"), F.col("bits").alias("raw"))
    asked = filters.unionByName(chunks.select("chunk", "hashes").mapInArrow(ask, "part int, chunk long, raw binary"))
    answers = asked.repartition(n, "part").sortWithinPartitions(*_in_order("part", "chunk")).mapInArrow(answer, "chunk long, hashes binary, levels binary")
    both = chunks.withColumn("levels", F.lit(None).cast("binary")).unionByName(
        answers.select("chunk", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("text_hash"), "hashes", "levels")
    )
    dealt = both.repartition(n, "chunk").sortWithinPartitions("chunk", F.col("levels").isNull())
    return dealt.mapInArrow(score, "doc_id long, text_hash long, score double").distinct()


def score(
    docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT,
    broadcast_bytes: int = BROADCAST_BYTES, chunk_tokens: int = CHUNK_TOKENS,
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    raw = None
    if small := model.parts * model.part_bits // 8 <= broadcast_bytes:
        raw = np.zeros(model.parts * model.part_bits // 8, np.uint8)
        for row in model.filter.toLocalIterator():
            raw[row.part * (model.part_bits // 8) :][: len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    found = _base(docs, model, id_col, text_col, frequent, raw)
    total = model.n_train + 0.5 * (model.n_distinct + 1)
    rare = found.select("rid", F.explode("rare").alias("x")).select("rid", "x.word", "x.tf").join(model.words, "word", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("rid").agg(
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("more"), F.sum(F.col("tf") * F.log10((c + 0.5) / F.lit(total))).alias("rest")
    )
    out = found.drop("rare").join(rare, "rid", "left")
    if not small:
        by_doc = routed_scores(docs, model, id_col=id_col, text_col=text_col, chunk_tokens=chunk_tokens).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("score").alias("routed"))
        out = out.join(by_doc, out["doc_id"].eqNullSafe(by_doc["id"]) & (out["text_hash"] == by_doc["hash"])).drop("score").withColumnRenamed("routed", "score")
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
    )
