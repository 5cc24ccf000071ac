"""Operator 1 against every window of every text."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcpulse.llm import repeats
from srcpulse.llm.queries import QUERIES


def brute(rows, least, keep="none"):
    seen = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for n, (_, b) in enumerate(raws):
        for i in range(len(b) - least + 1):
            seen.setdefault(b[i : i + least], []).append((n, i))
    out = []
    for n, (d, b) in enumerate(raws):
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            places = seen[b[i : i + least]]
            if (len(places) > 1) if keep == "none" else (places[0] != (n, i)):
                gone[i : i + least] = b"\1" * least
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(d), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, start long, spans string")
    return sorted((str(r.doc_id), *tuple(r)[1:5]) for r in repeats.without_repeats(docs, **options).collect())


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(60), text(9)
    rows = [(i, text(rnd.randrange(0, 60))) for i in range(30)]
    rows += [(100 + i, f"{text(5)} {line} {text(6)} {passage[i : 150 + 2 * i]} {text(4)}") for i in range(25)]
    rows += [(200 + i, passage) for i in range(6)] + [(300, "x" * 300), (301, "ab" * 200 + "xyz"), (302, f"{passage} {passage}"), (303, "x" * 70)]
    return rows + [(400, None), (401, ""), (402, "short")]


@pytest.mark.parametrize("bucket_segments", [2000, 2])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_against_all_windows(spark, bucket_segments, keep):
    rows = corpus()
    assert run(spark, rows, least=60, gram=16, keep=keep, bucket_segments=bucket_segments) == brute(rows, 60, keep)


def test_long_texts_and_default_lengths(spark, monkeypatch):
    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared = text(5000)
    rows = [(1, text(3000) + shared + text(50)), (2, shared[300:4000]), (3, text(20) + shared[100:499]), (4, shared[100:500]), (5, text(900))]
    assert run(spark, rows) == brute(rows, 400)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(None, "a b c d e f g " * 40), (1, "z" * 500), (1, "z" * 500), (None, "q" + "a b c d e f g " * 40)]
    assert run(spark, rows) == brute(rows, 400)
    assert run(spark, []) == [] and run(spark, [(1, "x" * 3)]) == brute([(1, "x" * 3)], 400)


def test_chunks_of_a_long_text(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 64)
    raw = bytes(random.Random(4).choices(b"ab", k=500))
    starts = [(int(s) + i) for _, _, start, n in repeats.segments(raw, 40, 10) for s, k in zip(start, n, strict=True) for i in range(k)]
    assert starts == list(range(461))


@given(st.binary(min_size=9, max_size=60), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_suffix_ranks(raw, least):
    places = np.arange(len(raw) - least + 1)
    ranks = repeats.suffix_ranks(np.frombuffer(raw, np.uint8), places, least)
    parts = [raw[i : i + least] for i in places]
    assert np.unique(ranks, return_inverse=True)[1].tolist() == [sorted(set(parts)).index(p) for p in parts]


def test_the_query_tells_the_text_that_stays(spark, tmp_path):
    """A passage of over 50 words that two documents share goes from both, the same passage cut below 400 bytes stays."""
    rnd = random.Random(6)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghé") for _ in range(7)) for _ in range(n))
    passage, short = words(70), words(40)
    assert len(short.encode()) < 400 < len(passage.encode())
    rows = [(1, f"{words(9)} {passage} {words(9)}"), (2, f"{words(30)} {passage}"), (3, words(90)), (4, f"{words(5)} {short}"), (5, short), (6, None), (7, "é" * 300), (8, "aé" + "é" * 300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in QUERIES["op1_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert sorted((str(r.doc_id), *tuple(r)[1:5]) for r in found.values()) == brute(rows, 400)
    assert all(found[d].text == (t or "") for d, t in rows if not found[d].n_removed) and {d for d in found if found[d].n_removed} == {1, 2, 7, 8}
    for d in (1, 2):
        assert passage not in found[d].text and hashlib.sha256(found[d].text.encode()).hexdigest() == found[d].kept_sha256
    cut = spark.createDataFrame([(1, "é" + words(60)), (2, None)], "doc_id long, text string")
    cut = cut.withColumn("text", F.when(F.col("doc_id") == 2, F.lit("ĩ" + cut.first().text[1:])).otherwise(F.col("text")))  # one byte of the first character is shared
    both = repeats.without_repeats(cut, with_bytes=True, with_text=True)
    assert both.columns[5:] == ["kept", "text"] and {r.doc_id: (bytes(r.kept), r.text) for r in both.collect()} == {1: (b"\xc3", "\ufffd"), 2: (b"\xc4", "\ufffd")}
