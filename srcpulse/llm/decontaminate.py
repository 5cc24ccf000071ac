"""Operator 6: passages of benchmark items found in documents by a generalised suffix automaton.

The words of all items make one automaton; each document's words run through it, which gives at every word the longest
run, ending there, that stands in some item. A run of `window` words or more is a hit, and so is a whole item of fewer
words. The items of a hit are those of the automaton's state: each state of the window's length knows its items.

An automaton has at most two states per item word, so it is broadcast only in shards of at most `shard_words` words;
more items than one shard holds make more shards, and the hits of a document are united over them.

Null texts have no words: as documents they have no hit, as items they are never found. Equal items are all found.
Repeated document rows are each judged on their own; empty tables give empty results, an empty benchmark no hit.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcpulse.llm.common import texts

#: A-Z fold to a-z, digits and a-z and all non-ASCII bytes are word bytes, the rest are blanks.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
HITS = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: defaultdict[int, set] = defaultdict(set)  # state -> items with a run ending there
        shorts: defaultdict[int, set] = defaultdict(set)  # state -> items of fewer words than a window
        for item, sequence in items:
            last = 0
            for at, word in enumerate(sequence, 1):
                last = self._extend(last, word)
                if at >= window:
                    ends[last].add(str(item))
            if sequence and len(sequence) < window:
                shorts[last].add((len(sequence), str(item)))
        self._settle(ends, shorts)

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        old = nxt[last].get(word)
        if old is not None:
            return old if length[old] == length[last] + 1 else self._split(last, word, old)
        new = self._state({}, 0, length[last] + 1)
        while last != -1 and word not in nxt[last]:
            nxt[last][word] = new
            last = link[last]
        if last != -1:
            old = nxt[last][word]
            link[new] = old if length[old] == length[last] + 1 else self._split(last, word, old)
        return new

    def _state(self, following: dict[bytes, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, last: int, word: bytes, old: int) -> int:
        """The shorter runs of `old` get a state of their own."""
        copy = self._state(dict(self.next[old]), self.link[old], self.length[last] + 1)
        self.link[old] = copy
        while last != -1 and self.next[last].get(word) == old:
            self.next[last][word] = copy
            last = self.link[last]
        return copy

    def _settle(self, ends, shorts) -> None:
        """Items by the state that holds a run of exactly `window` words, and short items by every state that ends with them."""
        self.items: dict[int, set] = defaultdict(set)
        self.found: dict[int, list[tuple[int, object]]] = {}
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for state, items in ends.items():
            while self.length[self.link[state]] >= self.window:
                state = self.link[state]
            self.items[state] |= items
        for state in order:
            here = [*self.found.get(self.link[state], ()), *shorts.get(state, ())]
            if here:
                self.found[state] = here
        # Runs longer than a window share a state with it or lie below one that holds it.
        self.base = list(range(len(self.length)))
        for state in order:
            if self.length[self.link[state]] >= self.window:
                self.base[state] = self.base[self.link[state]]

    def hits(self, sequence: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal spans of words that are hit, and the items found."""
        nxt, link, length, window, found = self.next, self.link, self.length, self.window, self.found
        spans: list[list[int]] = []
        items: set = set()
        state = run = 0
        for at, word in enumerate(sequence):
            to = nxt[state].get(word)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = nxt[state].get(word)
            if to is None:
                continue
            state, run = to, run + 1
            start = at + 1
            if run >= window:
                items |= self.items[self.base[state]]
                start -= run
            if found and state in found:
                for size, item in found[state]:
                    if size <= run:
                        items.add(item)
                        start = min(start, at + 1 - size)
            if start > at:
                continue
            while spans and start <= spans[-1][1]:
                start = min(start, spans.pop()[0])
            spans.append([start, at + 1])
        return [(a, b) for a, b in spans], items


def _shards(items: DataFrame, shard_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Bounded groups of items: streamed to the driver a partition at a time, never more than a shard held."""
    some: list = []
    size = 0
    for item, text in items.toLocalIterator():
        sequence = words(text)
        if some and size + len(sequence) > shard_words:
            yield some
            some, size = [], 0
        some.append((item, sequence))
        size += len(sequence)
    yield some


def _automata(items: DataFrame, id_col: str, text_col: str, window: int, shard_words: int) -> list:
    """Broadcast automata of all items, each of bounded size."""
    chosen = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    send = items.sparkSession.sparkContext.broadcast
    return [send(Automaton(shard, window)) for shard in _shards(chosen, shard_words)]


def _hits(sequence: list[bytes], shards: list) -> tuple[list[tuple[int, int]], set]:
    found = [shard.value.hits(sequence) for shard in shards]
    if len(found) == 1:
        return found[0]
    return united([span for spans, _ in found for span in spans]), set().union(*(names for _, names in found))


def find_items(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = 10, shard_words: int = 4_000_000,
) -> DataFrame:
    """doc_id, n_words, `spans` of hit words, `items` found (as strings), of every document."""
    rows = texts(docs, id_col, text_col)
    shards = _automata(items, item_id_col, item_text_col, window, shard_words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, found = [], [], []
            for text in batch.column("text").to_pylist():
                sequence = words(text)
                hits, names = _hits(sequence, shards)
                n_words.append(len(sequence))
                spans.append([{"start": a, "end": b} for a, b in hits])
                found.append(sorted(names))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n_words, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(found, pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "spans", "items"],
            )

    return rows.mapInArrow(scan, HITS)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    starts, ends, inside = [], [], False
    for at, byte in enumerate(raw.translate(FOLD)):
        if (byte != 0x20) != inside:
            (ends if inside else starts).append(at)
            inside = not inside
    ends += [len(raw)] * inside
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*kept, raw[at:]]).decode()


def decontaminated(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10,
    most_covered: float = 0.8, shard_words: int = 4_000_000,
) -> DataFrame:
    """The rows of `docs`, all columns, with hit words removed from the text; rows with a larger share of hit words go."""
    shards = _automata(items, item_id_col, item_text_col, window, shard_words)
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = [], []
            for i, text in enumerate(batch.column(at).to_pylist()):
                sequence = words(text)
                spans, _ = _hits(sequence, shards)
                if sum(b - a for a, b in spans) <= most_covered * len(sequence):
                    rows.append(i)
                    kept.append(without_spans(text, spans) if spans else text)
            some = batch.take(pa.array(rows, pa.int64()))
            yield some.set_column(at, batch.schema.field(at), pa.array(kept, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)
