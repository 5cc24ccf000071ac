"""Operators 5, 8 and 10: SQL on the small corpus, a plain re-statement of the patterns, held-out accuracy."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np

from srcpulse.llm import pii, toxicity, url_templates
from srcpulse.llm.queries import ORACLE, QUERIES, RULES


def test_urls_and_items_and_copies_by_sql(spark, sf):
    for name, table in (("op5_url_templates", "pages"), ("op6_decontaminate", "documents"), ("op7_exact_dedup", "documents")):
        tables = {t: f"'{sf}/{t}.parquet'" for t in (table, "benchmark")}
        got = QUERIES[name](spark, sf)
        con = duckdb.connect()
        for t, source in tables.items():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM {source}")
        found = con.execute(ORACLE[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(str(r) for r in found.fetchall()) == sorted(str(tuple(r[n] for n in names)) for r in got.collect()), name


def test_url_parts_rules_and_odd_urls(spark):
    rows = [
        (1, "HTTP://Sub.Example.ORG/es/1?x#y"), (2, "https://example.org/en/17"), (3, "x://example.org"), (4, "a://b.com/de/://c.org/"), (5, None),
        (6, ""), (7, "no scheme/de/"), (8, "://ÄB.COM/fr/x"), (9, "http://notexample.org/es/"), (10, "http://myorg/"), (10, "http://myorg/"), (None, "http://a.com?/de/"),
    ]
    pages = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.judge(pages, RULES).collect()}
    assert got[1] == ("sub.example.org", "/es/1", "example.org/es/", "block")
    assert got[2][2:] == ("example.org/en/1", "block") and got[3][:3] == ("example.org", "", None)
    assert got[4][:3] == ("b.com", "/de/://c.org/", "com/de/") and got[5][:3] == ("", "", None) == got[7][:3]
    assert got[8][:3] == ("Äb.com", "/fr/x", "com/fr/") and got[9][2] == "org/" and got[10][2] is None and got[None][1] == ""
    assert url_templates.judge(pages, RULES).count() == len(rows)
    assert url_templates.judge(pages.limit(0), RULES).count() == 0


def test_templates_of_blocked_siblings_are_rejected(spark):
    rows = [(i, f"http://h.net/spam/{i}/x") for i in range(60)] + [(100 + i, f"http://h.net/good/{i}/x") for i in range(60)]
    rules = [("block", "h.net", f"/spam/{i}/") for i in range(40)] + [("allow", "h.net", f"/good/{i}/") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_templates.judge(pages, rules).collect()}
    assert all(got[i] == (None, "block") for i in range(40, 60)) and all(got[i] == (None, "allow") for i in range(140, 160))


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if [True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and plain_luhn(d), 9 <= len(d) <= 15][kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_of_random_texts():
    rnd = random.Random(9)
    for alphabet in ("a@.b-", "0123456789. -", "+1(2)-. 5", "a1@.+-5 é"):
        for _ in range(4000):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 40)))
            assert pii.base_spans(text) == plain_spans(text), text
    for text in ("4111 1111 1111 1111", "5500-0000-0000-0004 x 4111111111111112", "a" * 50_000 + "@", "1" * 50_000, "0" * 300 + ".1.2.3"):
        assert pii.base_spans(text) == ([] if len(text) > 5000 else plain_spans(text))


def test_base_columns_of_the_small_corpus(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op8_pii"](spark, sf).collect():
        spans = plain_spans(docs[r.doc_id])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        n = Counter(k for _, k, _ in spans)
        assert tuple(r)[1:6] == (n[0], n[1], n[2], n[3], hashlib.sha256(text.encode()).hexdigest())
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))


def test_disclosing_terms_are_found_and_replaced(spark):
    rows = [(i, f"Zorbo called ann@x.org about the thing number {i}") for i in range(5)]
    rows += [(10 + i, f"the thing about nothing called item {i}") for i in range(60)] + [(90, None), (91, ""), (None, "Zorbo alone")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, base long")
    report = {r.doc_id: r.spans for r in pii.report(pii.spans(docs, near=3, least_bits=3)).collect()}
    assert report[0] == "term:0:5,email:13:22" and report[91] == "" == report[None] and len(report) == len(rows)
    clean = {r.doc_id: r.text for r in pii.sanitised(docs, near=3, least_bits=3, remove_bits=99).collect()}
    assert clean[1] == "<TERM> called <EMAIL> about the thing number 1" and clean[10] == "the thing about nothing called item 0" and clean[90] == ""
    gone = {r.doc_id: r.text for r in pii.sanitised(docs, near=3, least_bits=3, remove_bits=0).collect()}
    assert gone[1] == " called <EMAIL> about the thing number 1"
    assert pii.report(pii.spans(docs.limit(0))).count() == 0


def toxic_corpus(n, offset=0):
    rnd = random.Random(n + offset)
    word = lambda: rnd.choice("alpha beta gamma delta eps zeta eta theta".split())
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randrange(5, 60))]
        bad = i % 4 == 0
        if bad:
            words[rnd.randrange(len(words))] = rnd.choice(["grumbo", "SNARF", "grumb0", "grumbо"])
        rows.append((offset + i, " ".join(words)))
        labels.append((offset + i, int(bad)))
    return rows, labels


def test_scores_of_held_out_rows_folding_and_exceptions(spark):
    rows, labels = toxic_corpus(400)
    odd = [(900, None), (901, ""), (None, "grumbo"), (902, "grumbo alpha"), (903, "safe grumbo zone"), (904, "megagrumbos"), (902, "grumbo alpha")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (12345, 1)], "doc_id long, toxic int")
    got = toxicity.report(docs, marks, exceptions=("safe grumbo zone",)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    label = dict(labels)
    assert np.mean([r.predicted == label[r.doc_id] for r in got if r.held_out and r.doc_id in label]) == 1
    score = {r.doc_id: r.score for r in got}
    assert score[902] > 0.5 > score[903] == score[900] == score[901] == score[904]
    kept = toxicity.accepted(docs, marks)
    assert kept.columns == docs.columns and kept.where("doc_id < 400").count() == 300


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.report(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.report(docs.limit(0), none).count() == 0
    assert toxicity.report(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")).count() == 2


def test_folds_are_crc32_of_the_id_as_text(spark):
    import zlib

    got = spark.range(200).select("id", toxicity.held_out(toxicity.F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
