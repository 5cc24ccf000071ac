"""Operator 10: scores recomputed by plain searches, word by word and place by place."""

import math
import random

import numpy as np

from srcpulse.llm import toxicity

LETTERS = {"а": "a", "е": "e", "о": "o", "с": "c"}


def plain_readings(text):
    """Every character on its own: what it stands for inside a word, and at the end of one."""
    chars = [LETTERS.get(c, c) for c in text.lower()]
    inside = list(chars)
    for i, c in enumerate(chars):
        if c in toxicity.STAND_INS:
            rest = "".join(chars[i + 1 : i + 6])
            run = len(rest) - len(rest.lstrip("0123456789@$"))
            letter_follows = run <= 4 and len(rest) > run and "a" <= rest[run] <= "z"
            lone_zero = c == "0" and i and "a" <= chars[i - 1] <= "z" and not (rest[:1].isdigit() or "a" <= rest[:1] <= "z")
            if letter_follows or lone_zero:
                inside[i] = toxicity.STAND_INS[c]
    ends, i = list(inside), 0
    while i < len(inside):
        j = i
        while j < len(inside) and inside[j] in "0123456789@$":
            j += 1
        if j > i and j - i <= 4 and i and "a" <= inside[i - 1] <= "z" and not (j < len(inside) and "a" <= inside[j] <= "z"):
            ends[i:j] = [toxicity.STAND_INS.get(c, c) for c in inside[i:j]]
        i = max(j, i + 1)
    return ["".join(inside), "".join(ends)]


def plain_total(model, text):
    spared, marks = set(), {}
    for reading in plain_readings(text):
        for word, weight in [*model.weights.items(), *((e, None) for e in model.exceptions)]:
            for start in range(len(reading) - len(word) + 1):
                end = start + len(word)
                alone = not (start and reading[start - 1].isalnum()) and not (end < len(reading) and reading[end].isalnum())
                if reading[start:end] == word and alone:
                    if weight is None:
                        spared.add((start, end))
                    else:
                        marks.setdefault((start, end), weight)
    return sum(w for (a, b), w in marks.items() if not any(x <= a and b <= y for x, y in spared)), len(text.split())


def random_text(rnd):
    words = ["idiot", "1d1ot", "1dio7", "loser", "loser5", "l0ser$", "losers", "trash", "trash$$$", "tr@sh", "trash can", "grumb0", "grumbo", "аss", "a55", "a5", "x1", "99", "0", "$5", "clean", "idiots"]
    return rnd.choice([" ", ", ", "-", "."]).join(rnd.choice(words) + rnd.choice(["", "", "0", "s", "7t", "!"]) for _ in range(rnd.randrange(0, 14)))


def test_hits_are_those_of_plain_searches():
    weights = {"idiot": 1.5, "loser": 1.0, "losers": 2.0, "trash": 0.5, "grumbo": 3.0, "ass": 0.25}
    model = toxicity.Model(weights, ("trash can", "sore loser rule"))
    found, rnd, seen = model.automaton(), random.Random(6), 0
    for _ in range(3000):
        text = random_text(rnd)
        total, words = model.hits(text, found)
        want, n = plain_total(model, text)
        assert math.isclose(total, want) and words == n, text
        seen += total > 0
    assert seen > 1000
    for text in ("you 1dio7", "a55 indeed", "loser5", "that loser5.", "TRASH$ here"):
        assert model.hits(text, found)[0] > 0, text


def test_scores_of_the_query_are_recomputed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(toxicity.F.col("doc_id"))))
    assert model.weights
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = toxicity.report(docs, labels).collect()
    assert len(rows) == len(text)
    for r in rows:
        low = "".join(plain_readings(text[r.doc_id])) if len(text[r.doc_id]) < 4000 else None
        if low is None or not any(w in low for w in model.weights):
            continue  # long texts are left to the test above; a text without any word has the score of an empty one
        total, words = plain_total(model, text[r.doc_id])
        score = model.curve(np.array([total]), np.array([float(words)]))[0]
        assert math.isclose(r.score, score, rel_tol=1e-9) and r.predicted == int(score >= 0.5), r.doc_id
