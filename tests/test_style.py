"""Lines for every rule, and the order, counts and gate over them."""

import pytest
from pyspark.sql import functions as F

from srcpulse.functions import style
from srcpulse.operators import style as so


@pytest.fixture
def check(spark):
    def run(files, **options):
        df = spark.createDataFrame(list(files.items()), "file_path string, content string")
        rows = so.style_check(df, **options).collect()
        return {r.file_path: [(i["type"], i["line"]) for i in r.issues] for r in rows}

    return run


def test_line_rules(check):
    got = check(
        {
            "bare.py": "try:\n    x()\nexcept:\n    log()\n",
            "bare_ok.py": "except:  # ok\nexcept: pass\n",
            "empty.py": "except ValueError:\n    pass\nexcept KeyError:\n\nexcept A as b:\n  # why\nexcept B:\n    log()\n",
            "last.py": "x\nexcept ValueError:",
            "catch.js": "try { a } catch (e) {}\n",
            "catch.jsx": "try { a } catch (e) {}\n",
            "todo.go": "# TODO x\nnot  implemented\nTODOS\n",
            "secret.rb": "password = \"a\"\nAPI-KEY='b'\nBearer abc\nsecret=''\n",
            "notes.md": "password = \"a\"\n",
        }
    )
    assert got["bare.py"] == [("bare_except", 3)]
    assert got["bare_ok.py"] == []
    assert got["empty.py"] == [("empty_except", 2), ("empty_except", 4), ("empty_except", 6)]
    assert got["last.py"] == []
    assert got["catch.js"] == [("empty_catch", 1)]
    assert got["catch.jsx"] == []
    assert got["todo.go"] == [("placeholder_comment", 1), ("placeholder_comment", 2)] * 2
    assert got["secret.rb"] == [("hardcoded_secret", 1), ("hardcoded_secret", 2), ("hardcoded_secret", 3)]
    assert got["notes.md"] == []


def test_first_label_wins(spark):
    df = spark.createDataFrame([("a.py", "# FIXME then TODO and password='a' secret='b'\n")], "file_path string, content string")
    rows = so.style_issue_rows(so.style_check(df)).collect()
    assert [r.message.split(" left")[0] for r in rows if r.type == "placeholder_comment"] == ["'TODO'"] * 2
    assert [r.message for r in rows if r.type == "hardcoded_secret"] == [
        "Possible hardcoded password. Use environment variables or a secrets manager before commit."
    ]


def test_file_and_pair_rules(check):
    same = "y" * 21
    code = "\n".join(f"l{c}" for c in "abcdefghij")
    got = check(
        {
            "magic.py": "7 8 9 3 4", "small.py": "10 11 12 13 14", "big.go": "100 1000 234 5 6",
            "broad.py": "except Exception:\n  password\n", "broad.js": "except Exception:\n pass\n",
            "ratio7.go": code + "\n" + "# n\n" * 7, "ratio6.go": code + "\n" + "# n\n" * 6, "short.go": "x\n# a\n# b\n",
            "generic.py": "data = 1\nresult = 2\nvalue=3\nthing = 4\n", "generic3.py": "data = 1\nresult = 2\nvalue=3\n",
            "dup3.go": f"{same}\n  {same}\nz\n", "dup2.go": f"{same}\n{same}\n", "dup20.go": "\n".join(["x" * 20] * 3),
        }
    )
    assert got["magic.py"] == [("magic_numbers", 0)] and got["small.py"] == [] and got["big.go"] == [("magic_numbers", 0)]
    assert got["broad.py"] == [("broad_except_pass", 0)] and got["broad.js"] == []
    assert got["ratio7.go"] == [("high_comment_ratio", 0)] and got["ratio6.go"] == [] and got["short.go"] == []
    assert got["generic.py"] == [("generic_names", 0)] and got["generic3.py"] == []
    assert got["dup3.go"] == [("duplicate_lines", 1)] and got["dup2.go"] == [] and got["dup20.go"] == []


def test_order_score_and_cuts(spark):
    text = "# TODO\n" * 30 + "password='x'\nexcept:\n"
    row = so.style_check(spark.createDataFrame([("a.py", text)], "file_path string, content string")).first()
    orders = [i["rule_ord"] for i in row.issues]
    assert orders == sorted(orders) and row.issue_count == 62
    assert row.style_risk_score == 100 and len(row.style_warnings) == 10
    checked = so.style_check(spark.createDataFrame([("a.py", text)], "file_path string, content string"))
    kept = so.issues_per_file(checked, 25).first()
    assert len(kept.style_issues) == 25 and kept.issue_count == 62 and len(so.issues_per_file(checked).first().style_issues) == 62


def test_risk_by_severity(spark):
    one = "array(" + ",".join(f"named_struct('severity','{s}')" for s in ("critical", "high", "medium", "low")) + ")"
    five = "array(" + ",".join(["named_struct('severity','critical')"] * 5) + ")"
    row = spark.range(1).select(style.style_risk(F.expr(one)).alias("a"), style.style_risk(F.expr(five)).alias("b")).first()
    assert (row.a, row.b) == (51, 100)


def test_own_rules_and_single_placeholder(check):
    rule = style.regex_rule("tabs", r"^\t", "low", style.AI_STYLE, "Indented by a tab.")
    assert check({"a.txt": "x\n\ty\n"}, rules=[rule], extensions=None) == {"a.txt": [("tabs", 2)]}
    assert check({"a.py": "# TODO\n"}, rules=style.single_placeholder_rules()) == {"a.py": [("placeholder_comment", 1)]}
    with pytest.raises(ValueError):
        style.regex_rule("x", "x", "low", "c", "m", scope="pair")


def test_unreadable_and_empty_gate(spark):
    df = spark.createDataFrame([("a.py", None), ("b.md", None), ("c.py", "x = 1\n")], "file_path string, content string")
    row = so.gate_report(so.style_check(df, report_unreadable=True)).first()
    assert (row.ok, row.files_checked, row.files_with_issues, row.medium) == (True, 3, 1, 1)
    assert so.gate_report(so.style_check(df)).first().total_issues == 0
    none = so.gate_report(so.style_check(df.limit(0))).first()
    assert (none.ok, none.files_checked, none.message) == (True, 0, so.NO_FILES)


def test_counts_add_up_and_do_not_depend_on_partitions(spark, sf):
    from srcpulse.sources import adapters as A

    files = A.source_files(spark, sf)
    report = so.gate_report(so.style_check(files)).first()
    assert report.critical + report.high + report.medium + report.low == report.total_issues
    again = so.gate_report(so.style_check(files.repartition(13))).first()
    assert report == again
    rollup = {(r.dimension, r.value): r.issues for r in so.style_rollup(so.style_issue_rows(so.style_check(files))).collect()}
    assert rollup[("total", "all")] == report.total_issues
    assert sum(v for (d, _), v in rollup.items() if d == "category") == report.total_issues


def test_style_plan_has_no_shuffle(spark):
    df = spark.createDataFrame([("a.py", "x")], "file_path string, content string")
    plan = so.style_issue_rows(so.style_check(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_words_are_found_as_the_pattern_finds_them(values):
    """ASCII texts by plain search, others with all of Unicode's cases (long s, Kelvin sign, dotted capital I)."""
    texts = ["ToDo", "x FIXME", "none", "", None, "Key api-KEY", "haK hacK", "paſsword", "İmplement", "café todo", "café", "API_key", "Apikey", "api--key"]
    for words, pattern in (
        (style.PLACEHOLDER_WORDS, r"(?iU)todo|fixme|xxx|hack|placeholder|implement"), (style.SECRET_WORDS, r"(?iU)password|api[_-]?key|secret|bearer"),
    ):
        rows = values([(t,) for t in texts], "t string", style.has_word(F.col("t"), words), F.col("t").rlike(pattern))
        assert [a for a, _ in rows] == [b for _, b in rows] and {a for a, _ in rows} == {True, False, None}
