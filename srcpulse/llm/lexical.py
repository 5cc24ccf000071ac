"""Operator 13: ranked lexical search by dense products of tiles.

A query term weighs w = floor(1000 ln((2N+2) / (2df+1))) and a document answers it with the whole-number impact
(10^9 tf) div (1000 tf + 8 m); a score is the sum of w times impact over the query's terms. Items are dealt to blocks of a bounded
number of terms, so the vocabulary that goes to the tasks is bounded; each block is one pass over the texts, which leaves
a written table of sparse term counts, and one pass over that table. The second pass puts the impacts of a tile of
documents into a dense float64 matrix over the compact vocabulary of a tile of items and multiplies it with their weights.
Columns are taken in runs whose partial sums stay below 2^53, so each product is exact, and runs are added as integers.

A tile keeps of each item the best `k` entries with all their ties in order; tiles merge in heaps, heaps of tasks in a ranked window.

Null texts have no terms. Items equal in id and terms are one; items that share an id otherwise are ranked each on their
own. Repeated documents each count and can each be ranked; a null doc_id comes after all others of its score. Items
without terms, without a document above 0, and empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcpulse.llm.common import terms_of, texts, written
from srcpulse.llm.heaps import Heaps, best

#: Terms of all items of a block together, items of a tile and documents of a tile.
BLOCK_TERMS, ITEM_TILE, DOC_TILE = 200_000, 64, 1024
#: Impacts are below this, and float64 sums of whole numbers are exact below that.
MOST_IMPACT, EXACT = 1_000_000, 2**53
VECTORS = "doc_id long, n long, terms binary, counts binary"
RANKED = "item int, item_id long, doc_id long, score long, tie long"
#: Distance of two items in the keys of the heaps, and the id that stands for null.
NO_ID = 2**63 - 1


def item_terms(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id (the item's id), terms (distinct, sorted) of the distinct items that have any."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.binary()))], ["doc_id", "terms"])

    found = texts(items, id_col, text_col).mapInArrow(cut, "doc_id long, terms array<binary>")
    return written(found.where(F.size("terms") > 0).distinct(), "lexical-items")


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (all terms), terms and counts of the vocabulary's terms in every row; a written table."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = terms_of(text)
                some, times = np.unique(np.array([i for i in map(get, words) if i is not None], "<i4"), return_counts=True)
                n.append(len(words))
                terms.append(some.tobytes())
                counts.append(times.astype("<i8").tobytes())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    return written(texts(docs, id_col, text_col).mapInArrow(count, VECTORS), "lexical-counts")


def _frequencies(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """Rows that hold each term of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    summed = vectors.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(n_terms, np.int64)
    for row in summed.toLocalIterator():  # one number per term of the block
        out[row.term] = row.df
    return out


def runs(weight: np.ndarray) -> list[int]:
    """Ends of the runs of columns whose sums of weight times impact are exact in float64."""
    ends, total = [], 0
    for i, w in enumerate(np.abs(weight).tolist()):
        if total + w * MOST_IMPACT >= EXACT and total:
            ends.append(i)
            total = 0
        total += w * MOST_IMPACT
    return [*ends, len(weight)]


class _Items:
    """A tile of items: the columns of their vocabulary and the weight of each column for each item."""

    def __init__(self, first: int, terms: list[np.ndarray], weight: np.ndarray) -> None:
        self.first, self.n = first, len(terms)
        self.vocabulary, column = np.unique(np.concatenate(terms), return_inverse=True)
        of_item = np.repeat(np.arange(self.n), [len(t) for t in terms])
        w = weight[self.vocabulary]
        self.weights = np.zeros((len(self.vocabulary), self.n))
        self.weights[column, of_item] = w[column]
        self.ends = runs(w)

    def scores(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, n_rows: int) -> np.ndarray:
        """Scores of `n_rows` documents for each item, from the (row, term, impact) they have."""
        column = np.searchsorted(self.vocabulary, term)
        mine = np.flatnonzero(self.vocabulary[np.minimum(column, len(self.vocabulary) - 1)] == term)
        dense = np.zeros((n_rows, len(self.vocabulary)))
        dense[row[mine], column[mine]] = impact[mine]
        out, start = np.zeros((n_rows, self.n), np.int64), 0
        for end in self.ends:
            out += (dense[:, start:end] @ self.weights[start:end]).astype(np.int64)
            start = end
        return out


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _ranked(vectors: DataFrame, ids: list, tiles: list[_Items], n_docs: int, n_all: int, k: int) -> DataFrame:
    """The best `k` rows of each item among those of each task."""
    sent = vectors.sparkSession.sparkContext.broadcast((ids, tiles))
    names = [c.split()[0] for c in RANKED.split(", ")]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, blocks = sent.value
        heaps = Heaps(k)
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_TILE):
                some = batch.slice(at, DOC_TILE)
                n, raw = some.column("n").to_pylist(), some.column("terms").to_pylist()
                term = np.frombuffer(b"".join(raw), "<i4")
                row = np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw])
                tf = np.frombuffer(b"".join(some.column("counts").to_pylist()), "<i8")
                m = np.array([10 + 90 * x * n_docs // n_all for x in n], np.int64)
                impact = impacts(tf, m[row]).astype(np.float64)
                doc_ids = some.column("doc_id")
                doc, null = doc_ids.fill_null(NO_ID).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                for block in blocks:
                    scores = block.scores(row, term, impact, len(raw))
                    # An entry below the k-th best of its item is no use; all that tie with it are kept for the order by id.
                    least = np.partition(scores, -k, axis=0)[-k] if len(raw) > k else np.zeros(block.n, np.int64)
                    place, item = np.nonzero((scores >= least) & (scores > 0))
                    score = scores[place, item]
                    keep = best(item, score, doc[place], null[place], k)
                    heaps.push(item[keep] + block.first, doc[place[keep]], score[keep], null[place[keep]])
        item, doc, score, null = heaps.merged()
        columns = [pa.array(item.astype(np.int32)), pa.array([item_ids[i] for i in item.tolist()], pa.int64()), pa.array(doc, mask=null > 0), pa.array(score), pa.array(null)]
        yield pa.RecordBatch.from_arrays(columns, names)

    return vectors.mapInArrow(rank, RANKED)


def search(
    docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", block_terms: int = BLOCK_TERMS, item_tile: int = ITEM_TILE,
) -> DataFrame:
    """item_id, rank, doc_id, score: the `k` best rows above 0 of each item."""
    queries = item_terms(items, id_col=item_id_col, text_col=item_text_col)
    blocks = max(1, math.ceil((queries.agg(F.sum(F.size("terms"))).first()[0] or 0) / block_terms))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("doc_id", "terms"), F.lit(blocks)))
    parts = []
    for block in range(blocks):
        # A block has about `block_terms` terms, and so at most that many items.
        mine = sorted(((r.doc_id, [bytes(t) for t in r.terms]) for r in queries.where(F.col("block") == block).toLocalIterator()), key=lambda x: x[1])
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in mine for t in terms}))}
        vectors = term_counts(docs, vocabulary, id_col=id_col, text_col=text_col)
        total = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        if not mine or not total.docs:
            continue
        df = _frequencies(vectors, len(vocabulary))
        weight = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * f + 1))) for f in df.tolist()], np.int64)
        terms = [np.array([vocabulary[t] for t in found], np.int64) for _, found in mine]
        tiles = [_Items(i, terms[i : i + item_tile], weight) for i in range(0, len(terms), item_tile)]
        ranked = _ranked(vectors.where("n > 0"), [i for i, _ in mine], tiles, total.docs, total.n, k)
        first = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        parts.append(ranked.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
