import math
import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from srcpulse.functions import imports as imp, text as t
from srcpulse.operators import metrics

C = F.col
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def test_extension(values):
    rows = [
        (".bashrc", ""), ("foo.", ""), ("d.d/file", ""), ("a/.x.py", ".py"), ("m.tar.gz", ".gz"), ("a.PY", ".PY"), ("a/b.ts", ".ts"), ("", ""),
    ]
    for got, want in values(rows, "p string, w string", t.extension(C("p")), "w"):
        assert got == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \t#/\x1f\xa0" + BREAKS, max_size=12), min_size=20, max_size=40))
def test_lines_and_strip_equal_python(spark, texts):
    df = spark.createDataFrame([(x,) for x in texts], "c string")
    lines = t.split_lines(C("c"))
    for r in df.select("c", lines.alias("l"), t.strip_lines(lines, C("c")).alias("s")).collect():
        assert r.l == r.c.splitlines()
        assert r.s == [x.strip() for x in r.c.splitlines()]


def test_universal_newlines_and_sample(values):
    rows = [("a\r\nb\rc",), ("1\n2\n3",), ("1\n2\n",), ("1\n2",), ("",)]
    got = values(rows, "c string", t.universal_newlines(C("c")), t.code_sample(C("c"), 2))
    assert [g[0] for g in got] == ["a\nb\nc", "1\n2\n3", "1\n2\n", "1\n2", ""]
    assert [g[1] for g in got] == ["a\nb\n", "1\n2\n", "1\n2\n", "1\n2", ""]


def test_short_path(values):
    assert values([("x" * 60,), ("y" * 61,)], "p string", t.short_path(C("p"))) == [("x" * 60,), ("..." + "y" * 57,)]


def test_line_profile(spark):
    df = spark.createDataFrame([("a.py", "# c\n\nx = 1\n  // y\n"), ("e.py", "")], "file_path string, content string")
    rows = {r.file_path: r for r in metrics.line_profile(df).collect()}
    assert (rows["a.py"].line_count, rows["a.py"].nonblank_lines, rows["a.py"].comment_lines) == (4, 3, 2)
    assert rows["a.py"].comment_ratio == 0.5
    assert (rows["e.py"].line_count, rows["e.py"].comment_ratio) == (0, 0.0)


def test_complexity_counts_decisions_per_function(values):
    code = "import a\nif a: pass\ndef f(x):\n    if x and x > 1:\n        return 1\n    return 0\n\nasync def g():\n    for i in x:\n        pass\n"
    assert values([(code,), ("x = 1\n",)], "c string", t.mean_block_complexity(C("c"))) == [(2.5,), (0.0,)]


def test_maintainability_formula(values):
    got = values([(40, 20, 2.0, 10, 1)], "n int, d int, cc double, l int, m int", t.maintainability_index(C("n"), C("d"), C("cc"), C("l"), C("m")))
    volume = 40 * math.log2(20)
    raw = 171 - 5.2 * math.log(volume) - 0.23 * 2 - 16.2 * math.log(10) + 50 * math.sin(math.sqrt(2.4 * math.radians(10)))
    assert abs(got[0][0] - round(raw * 100 / 171, 2)) < 1e-9


def test_file_metrics_uses_given_columns_and_marks_unsupported(spark):
    rows = [("a.py", "x = 1\n", 7.0, 55.0), ("b.md", "text", 7.0, 55.0), ("c.py", None, 7.0, 55.0), ("d.go", "x\n\ny\n", None, None)]
    df = spark.createDataFrame(rows, "file_path string, content string, cyclomatic_complexity double, maintainability_index double")
    got = {r.file_path: r for r in metrics.file_metrics(df).collect()}
    assert (got["a.py"].status, got["a.py"].cyclomatic_complexity, got["a.py"].maintainability_index) == ("completed", 7.0, 55.0)
    assert (got["b.md"].status, got["b.md"].reason, got["b.md"].cyclomatic_complexity) == ("unsupported_file", "extension", None)
    assert (got["c.py"].status, got["c.py"].reason) == ("unsupported_file", "unreadable")
    assert got["d.go"].lines_of_code == 2


def test_imports(values):
    py = "import os\nfrom a.b.c import d\n  import os\nx = 'import z'\nfrom . import q\n# import n\n"
    js = "import a from \"./x/y.z\"\nimport {b} from 'lib'\nconst c = require('d')\n"
    got = values(
        [(py, ".py"), (js, ".ts"), (js, ".go"), (None, ".py")], "c string, e string", imp.extract_imports(C("c"), C("e")),
        imp.dependency_depth(imp.extract_imports(C("c"), C("e"))),
    )
    assert set(got[0][0]) == set(re.findall(r"^\s*(?:from|import)\s+([\w\.]+)", py, re.M))
    assert got[0][1] == 2
    assert got[1] == (["./x/y.z", "lib"], 2)
    assert got[2] == ([], 0) and got[3] == ([], 0)
