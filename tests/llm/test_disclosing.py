"""Operator 8: terms that disclose a value are marked in every document."""

import math
import random
import re
from collections import Counter

import pytest

from srcpulse.llm import pii, queries


@pytest.fixture
def docs(spark):
    far = "one two three four five six seven eight nine"
    rows = [(i, f"Zorbo called ann@x.org about the thing number {i}") for i in range(5)]
    rows += [(1000 + i, f"the thing about nothing called item {i}") for i in range(200)]
    rows += [(90, None), (91, "zorbo alone"), (92, f"ann@x.org {far} Zorbo x@zorbo.org")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_the_query_marks_terms_far_from_their_value(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.spans for r in queries.QUERIES["op8_pii"](spark, str(tmp_path)).collect()}
    assert len(got) == 208 and got[1000] == "" == got[90]
    assert "term:0:5" in got[0].split(",") and got[91] == "term:0:5"
    assert got[92] == "email:0:9,term:55:60,email:61:72"


def test_both_ways_and_sanitised_texts(spark, docs):
    some, none = (sorted(map(str, pii.report(pii.spans(docs, everywhere=True, broadcast_terms=n)).collect())) for n in (500_000, 0))
    assert some == none
    clean = {r.doc_id: r.text for r in pii.sanitised(docs, remove_bits=99).collect()}
    assert clean[91] == "<TERM> alone" and clean[1000] == "the thing about nothing called item 0"


def plain_pairs(rows, near, smooth, least_docs, least_share, least_bits):
    """(entity, term) -> bits by plain counts."""
    both, holding, held, n = Counter(), Counter(), Counter(), len(rows)
    for _, text in rows:
        text = text or ""
        words = {m[0].translate(pii._LOWER) for m in re.finditer(pii.TERM, text)}
        holding.update(words)
        close = {(e, t) for value, t, _, _ in pii.near_terms(text, pii.base_spans(text), near) for e in (value, value.split(":")[0] + ":*")}
        both.update(close)
        held.update({e for e, _ in close})
    out = {}
    for (entity, term), b in both.items():
        p = held[entity] / n
        share = (b + smooth * p) / (holding[term] + smooth)
        if b >= least_docs and share >= least_share and math.log2(share / p) >= least_bits:
            out[entity, term] = round(math.log2(share / p), 9)
    return out


@pytest.mark.parametrize("broadcast_terms", [500_000, 0])
def test_pairs_against_plain_counts(spark, broadcast_terms):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["É", "Straße"]
    values = ["a@b.org", "ann@x.org", "10.0.0.7", "+1 (212) 555 0100", "4111 1111 1111 1111"]
    rows = []
    for i in range(300):
        text = [rnd.choice(words) for _ in range(rnd.randrange(0, 30))]
        if rnd.random() < 0.25:
            value = rnd.randrange(5)
            at = rnd.randrange(len(text) + 1)
            text[at:at] = [f"Tell{value}"] * (rnd.random() < 0.8) + [f"user{i}@site{i}.org" if value == 0 else values[value], f"near{value % 2}"]
        rows.append((i, " ".join(text)))
    rows += [(900, None), (901, ""), (902, "Tell1 w1"), (903, "w2 tell2"), (904, "user7@site7.org again"), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, term long, entity string")
    for options in ({"smooth": 1.5, "least_docs": 2, "least_share": 0.5, "least_bits": 2.0}, {"smooth": 0.5, "least_docs": 1, "least_share": 0.3, "least_bits": 1.0}):
        want = plain_pairs(rows, 3, **options)
        got = pii.disclosing(docs, pii.find(docs, near=3), broadcast_terms=broadcast_terms, **options).collect()
        assert {(r.entity, r.term): round(r.bits, 9) for r in got} == want
        assert any(e.endswith("*") for e, _ in want) and any(not e.endswith("*") for e, _ in want)


def test_terms_on_the_shipped_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = {(r.entity, r.term): round(r.bits, 9) for r in pii.disclosing(docs, pii.find(docs)).collect()}
    assert got == plain_pairs([tuple(r) for r in docs.collect()], 6, 1.5, 2, 0.5, 4.0) and len(got) > 10
