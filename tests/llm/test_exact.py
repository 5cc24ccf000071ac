"""Operator 7 against grouping by the normalised text itself."""

import hashlib
import random
import re

from srcpulse.llm import exact


def brute(rows):
    norm = [re.sub("[ \t-\r]+", " ", t or "") for _, t in rows]
    groups = {}
    for (doc, _), n in zip(rows, norm, strict=True):
        groups.setdefault(n, []).append(doc)
    keep = {n: min((d for d in g if d is not None), default=None) for n, g in groups.items()}
    return sorted(
        (str(doc), str(keep[n]), len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for (doc, _), n in zip(rows, norm, strict=True)
    )


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, name string")
    got = exact.exact_groups(docs, **options).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)
    stay = exact.without_copies(docs, **options)
    assert stay.columns == docs.columns and stay.count() == len(kept)


def test_texts_of_all_lengths_and_a_hot_group(spark):
    rnd = random.Random(1)
    some = ["".join(rnd.choice("ab \n\té") for _ in range(rnd.randrange(0, 40))) for _ in range(60)]
    rows = [(i, rnd.choice(some)) for i in range(200)] + [(1000 + i, "the hot text of a third of the rows " * 3) for i in range(100)]
    check(spark, rows, block_chars=4)


def test_nulls_blanks_ties_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "\t\n"), (5, "a\r\n b"), (6, "a b"), (7, "a b "), (7, "a b "), (None, "z"), (None, "z"), (None, "a b"), (8, "é" * 3000)]
    check(spark, rows)
    check(spark, rows[:1])
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_groups(docs).count() == 0


def test_equal_hashes_do_not_make_copies(spark, monkeypatch):
    monkeypatch.setattr(exact.F, "xxhash64", lambda *_: exact.F.lit(0))
    check(spark, [(1, "abcd"), (2, "abdc"), (3, "abcd"), (4, "dcba"), (5, "xbcd" * 9), (6, "abcx" * 9), (7, "abcx" * 9)], block_chars=2)
