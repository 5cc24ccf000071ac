"""Operator 6 against a plain search of every window."""

import hashlib
import random
import re

from srcpulse.llm import decontaminate
from srcpulse.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - window + 1)):
            if w:
                windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def as_dict(frame):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect()}


def test_query_over_the_small_corpus(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert as_dict(QUERIES["op6_decontaminate"](spark, sf)) == brute(docs, items, 10)


def test_random_texts_and_shards(spark):
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
    items = [(i, text(rnd.randrange(0, 9))) for i in range(25)] + [(90, None), (91, ""), (92, "Zß z1"), (93, "zß-Z1"), (None, "q r s t u")]
    docs = [(i, text(rnd.randrange(0, 40))) for i in range(60)] + [(70, None), (71, ""), (72, "x,ZSS Zß... Z1!"), (None, "p q r s t u v")]
    left = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, items long")
    right = spark.createDataFrame(items, "item_id long, text string")
    named = [(i, t) for i, t in items]
    for shard_words in (1_000, 7):
        found = decontaminate.find_items(left, right, window=4, shard_words=shard_words)
        assert as_dict(decontaminate.report(found)) == brute(docs, named, 4)
    nothing = decontaminate.find_items(left, right.limit(0), window=4)
    assert not nothing.where("size(spans) > 0").count()
    assert decontaminate.find_items(left.limit(0), right, window=4).count() == 0


def test_removal_keeps_the_rest_and_drops_covered_documents(spark):
    docs = spark.createDataFrame(
        [(1, "Keep this. One two three, FOUR! And this."), (2, "one two three four"), (3, "clean"), (4, None), (5, "one two three four " * 3 + "é ü")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    kept = decontaminate.decontaminated(docs.withColumn("spans", decontaminate.F.lit(1)), items, window=3)
    assert kept.columns == ["doc_id", "text", "spans"]
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "Keep this. ! And this.", 3: "clean", 4: None}
