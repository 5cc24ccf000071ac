"""Operator 2: tokens of each document by a two-tier lookup of pre-token lengths.

The driver counts the pre-tokens of a bounded sample and broadcasts the lengths of the most frequent ones (at most
`frequent` entries of at most 64 characters). Tasks add up lengths from that table; what it lacks is merged once per
worker and kept in the worker's cache. No pre-token is shuffled. The sample decides speed only, never a count.

Null and empty texts have 0 tokens. Repeated rows are counted each on their own; an empty table gives an empty result;
a null doc_id is kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcpulse.llm.common import texts
from srcpulse.llm.tokens import KEPT_CHARS, codec

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def frequent_lengths(docs: DataFrame, path: str, entries: int, sample_docs: int, sample_chars: int) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of at most `sample_docs` texts, `sample_chars` of each."""
    made = codec(path)
    if made.merge is None:
        return {}
    seen: Counter[str] = Counter()
    for (text,) in docs.select(F.substring("text", 1, sample_chars)).limit(sample_docs).collect():
        seen.update(made.pieces(text) or ())
    return {p: len(made.merge(p)) for p, _ in seen.most_common(entries) if len(p) <= KEPT_CHARS}


def token_counts(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
    frequent: int = 20_000, sample_docs: int = 2_000, sample_chars: int = 4_096,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row."""
    rows = texts(docs, id_col, text_col)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(rows, tokenizer, frequent, sample_docs, sample_chars))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(tokenizer)
        lengths = made.lengths(table.value)
        for batch in batches:
            some = batch.column("text").to_pylist()
            n = [made.count(t, lengths) for t in some]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) for t in some], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(count, SCHEMA)
