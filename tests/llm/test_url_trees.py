"""Operator 5: trees of any depth against the same in SQL, and slugs below a blocked branch."""

import random

import duckdb

from srcpulse.llm import url_templates

RULES = [("block", "h.net", f"/de/blog/{word}") for word in ("a", "b", "c")] + [("allow", "h.net", f"/de/news/{word}") for word in ("a", "b", "c")]


def judged(spark, rows, rules):
    return {r.page_id: r for r in url_templates.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}


def by_sql(rows, rules):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    return {r[0]: r for r in con.execute(url_templates.judge_sql(rules)).fetchall()}


def test_slugs_below_a_blocked_branch_are_blocked(spark):
    rnd = random.Random(1)
    slug = lambda first: first + "".join(rnd.choice("klmnop") for _ in range(9))
    rows = []
    for i in range(300):
        branch = "blog" if i % 2 else "news"
        rows.append((i, f"http://h.net/de/{branch}/{slug('abcz'[i % 8 // 2])}/{slug('y')}"))
    got = judged(spark, rows, RULES)
    free = [i for i in range(300) if i % 8 // 2 == 3]
    assert all(got[i].rule is None for i in free) and len(free) > 60
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in free)
    assert {got[i].template for i in free} == {"/*/blog/*/*", "/*/news/*/*"}


def test_deep_and_odd_paths_by_sql(spark):
    rnd = random.Random(2)
    hosts = ["h.net"] * 6 + ["x.h.net", "other.org", "", "q"]
    word = lambda: rnd.choice(["de", "fr", "blog", "news", "a1", "b22", "", f"s{rnd.randrange(10**6)}x", "tag"])
    rows = [(i, f"http://{rnd.choice(hosts)}/" + "/".join(word() for _ in range(rnd.randrange(0, 8)))) for i in range(1500)]
    rows += [(5000, None), (5001, "no"), (5002, "http://h.net"), (5003, "http://h.net/"), (5004, "http://h.net//"), (5005, "http://h.net/de//"), (5006, "http://h.net/?q")]
    rules = [("block", "h.net", "/de/"), ("allow", "h.net", "/fr/"), ("block", "h.net", "/blog/de/a"), ("allow", "h.net", "/blog/fr/"), ("block", "org", "/news/")]
    got, want = judged(spark, rows, rules), by_sql(rows, rules)
    assert len(got) == len(rows) and {i: tuple(r) for i, r in got.items()} == want
    assert max(r.template.count("/") for r in got.values()) >= 6 and len({r.template for r in got.values()}) > 20
