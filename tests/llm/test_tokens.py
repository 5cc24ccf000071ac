"""Operators 2, 3, 9: against the tokenizer library, and round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from srcpulse.llm import packing, token_counts, token_files
from srcpulse.llm.queries import QUERIES, TOKENIZER
from srcpulse.llm.tokens import Codec, codec

LIBRARY = Tokenizer.from_file(TOKENIZER)
ODD = [
    None, "", " ", "  \n\n x", "don't we'll I'M 'S", "<|endoftext|> a <|endoftext|>", "naïve café ñ ß", "日本語 テスト 한국어", "𝔘𝔫𝔦 😀 \x1c\x85 x",
    "٣٤ ²³ Ⅷ", "a" * 5000, " " * 3000 + "x", "1234567890 " * 50, "\x00\x01", "ʼn ΐ Ӂ ԰", "same", "same",
]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i else None, t, i, "x") for i, t in enumerate(ODD)]
    rows.append((len(ODD) - 1, "same", 0, "y"))
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, shard string")


@given(st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_library_s(text):
    assert codec(TOKENIZER).ids(text).tolist() == ids(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_makes_go_to_the_library(name):
    made = Codec(public_tokenizers.path(name))
    assert made.merge is None
    assert made.ids("Hello there").tolist() == made.library.encode("Hello there", add_special_tokens=False).ids


def test_odd_texts_and_rows(odd):
    want = sorted((str(i if i else None), len((t or "").encode()), len(ids(t))) for i, t in [*enumerate(ODD), (len(ODD) - 1, "same")])
    got = token_counts.token_counts(odd, TOKENIZER, limit=20)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert all(r.over_limit == (r.n_tokens > 20) for r in got.collect())
    files = token_files.read_documents(token_files.write_ids(odd, TOKENIZER, block_ids=50)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in files) == sorted((d, n + 1) for d, _, n in want)
    check_pieces(packing.pack(odd, TOKENIZER, capacity=64, open_windows=3, merge_rows=2).collect(), 64)


def test_empty_tables(odd):
    none = odd.limit(0)
    assert token_counts.token_counts(none, TOKENIZER).count() == 0
    assert token_files.read_documents(token_files.write_ids(none, TOKENIZER)).count() == 0
    assert packing.pack(none, TOKENIZER).count() == 0


def test_queries_over_the_small_corpus(spark, sf):
    docs = {r.doc_id: ids(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counted = QUERIES["op2_token_counts"](spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in counted} == {d: len(x) for d, x in docs.items()}
    start, want = 0, {}
    for d in sorted(docs):
        whole = np.array([*docs[d], 0], "<u4")
        want[d] = (start, len(whole), zlib.crc32(whole.tobytes()))
        start += len(whole)
    got = QUERIES["op3_token_files"](spark, sf).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want
    pieces = QUERIES["op9_packing"](spark, sf).collect()
    check_pieces(pieces, 1024)
    for r in pieces:
        part = np.array([*docs[r.doc_id], 0], "<u4")[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(docs[r.doc_id]) + 1
    assert len({r.sequence_id for r in pieces}) <= 1.01 * start / 1024 + 4


def check_pieces(pieces, capacity):
    """Every id in one piece, every sequence gapless from 0 and not too long."""
    windows, docs = defaultdict(list), defaultdict(list)
    for r in pieces:
        windows[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(r.length for r in pieces) >= sum(p[0][2] for p in docs.values())


@pytest.mark.parametrize("tasks", [1, 5])
def test_packing_merges_the_leftovers_of_many_tasks(spark, tasks):
    rows = [(i, "word " * random.Random(i).randrange(1, 90)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks)
    pieces = packing.pack(docs, TOKENIZER, capacity=100, open_windows=4, least_piece=3, merge_rows=8).collect()
    check_pieces(pieces, 100)
    total = sum(r.length for r in pieces)
    assert total == sum(len(ids(t)) + 1 for _, t in rows)
    assert len({r.sequence_id for r in pieces}) <= 1.1 * total / 100 + 4


@given(st.lists(st.one_of(st.just(0), st.integers(0, 2**32 - 1), st.integers(0, 40)), max_size=900), st.sampled_from([1, 8, 15, 20, 32]))
@settings(max_examples=150, deadline=None)
def test_simple8b_round_trip(values, escape_bits):
    array = np.array(values, "<u4")
    packed, escapes = token_files.simple8b(array, escape_bits)
    assert token_files.from_simple8b(packed, escapes, len(array)).tolist() == values


def test_simple8b_packs_small_ids_tightly():
    assert len(token_files.simple8b(np.ones(6000, "<u4"))[0]) == 8 * 100
    assert len(token_files.simple8b(np.zeros(480, "<u4"))[0]) == 8 * 2
