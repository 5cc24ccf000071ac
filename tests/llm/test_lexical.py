"""Operator 13 against plain whole-number arithmetic."""

import math
import random
import re
from collections import Counter

import numpy as np

from srcpulse.llm import lexical
from srcpulse.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_all = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, wanted in {(i, frozenset(terms(t))) for i, t in items}:
        scored = []
        for doc, c, n in counts:
            m = 10 + 90 * n * n_docs // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank + 1, None if null else doc, -s) for rank, (s, null, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def as_rows(frame):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect()), key=str)


def test_random_texts_in_blocks_and_tiles(spark):
    rnd = random.Random(11)
    words = [f"{a}{b}" for a in "abcde" for b in ("", "É", "7", "日")] + ["the", "The"]
    text = lambda n: rnd.choice([" ", ", ", "\x00-", "  "]).join(rnd.choice(words + ["the"] * 9) for _ in range(n))
    docs = [(i, text(rnd.randrange(0, 60))) for i in range(80)] + [(200, None), (201, ""), (202, "---"), (None, "aÉ aÉ b7"), (None, "aÉ"), (203, "zz " * 40_000)]
    docs += [(300 + i, "Same c7 words!") for i in range(25)] + [(7, "aÉ c日"), (7, "aÉ c日")]
    items = [(i, text(rnd.randrange(1, 9))) for i in range(30)] + [(90, None), (91, ""), (92, "c7 SAME"), (92, "c7 SAME same"), (93, "zz"), (94, "the the"), (94, "aÉ"), (None, "b7"), (95, "nowhere")]
    left = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n long, score long")
    right = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, doc_id long")
    want = brute(docs, items)
    assert as_rows(lexical.search(left, right)) == want
    assert as_rows(lexical.search(left, right, block_terms=20, item_tile=3)) == want
    assert as_rows(lexical.search(left, right, k=3)) == brute(docs, items, 3)
    assert lexical.search(left, right.limit(0)).count() == 0
    assert lexical.search(left.limit(0), right).count() == 0
    assert lexical.search(left.where("doc_id = 201"), right).count() == 0


def test_runs_keep_sums_exact():
    weight = np.array([2**32, 2**32, -(2**32), 5, 2**33], np.int64)
    ends = lexical.runs(weight)
    assert ends[-1] == len(weight) and ends == sorted(set(ends))
    for a, b in zip([0, *ends], ends, strict=False):
        assert b == a + 1 or int(np.abs(weight[a:b]).sum()) * lexical.MOST_IMPACT < lexical.EXACT
    tile = lexical._Items(0, [np.arange(5), np.array([2, 4])], weight)
    impact = np.array([999_999, 999_997, 999_983, 999_979, 999_961.0])
    found = tile.scores(np.zeros(5, np.int64), np.arange(5), impact, 1)
    assert found.tolist() == [[sum(int(w) * int(i) for w, i in zip(weight, impact, strict=True)), -(2**32) * 999_983 + 2**33 * 999_961]]


def test_query_over_the_small_corpus(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert as_rows(QUERIES["op13_lexical_search"](spark, sf)) == brute(docs, items)
