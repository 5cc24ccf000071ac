"""Token-wise complexity against Python's own tokens and syntax tree, over this package's sources and odd texts."""

import ast
import io
import pathlib
import tokenize

from pyspark.sql import functions as F

from srcpulse.functions import lexed, text

WORDS = {"if", "elif", "for", "while", "except", "with", "assert", "and", "or"}


def plain_complexity(source):
    tree = ast.parse(source)
    inside = {id(n) for f in ast.walk(tree) if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef) for n in ast.walk(f) if n is not f}
    every = [f for f in ast.walk(tree) if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef)]
    outer = [f for f in every if id(f) not in inside]
    found, depth = [], 0
    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        depth += (t.type == tokenize.FSTRING_START) - (t.type == tokenize.FSTRING_END)
        if t.type == tokenize.NAME and t.string in WORDS and not depth:  # a formatted string is a string as a whole
            found.append(t.start[0])
    covered = lambda line: any(f.lineno <= line <= f.end_lineno for f in outer)
    return round((len(every) + sum(map(covered, found))) / len(outer), 2) if outer else 0.0


def test_own_sources(values):
    sources = [p.read_text() for p in sorted(pathlib.Path("srcpulse").rglob("*.py"))]
    got = values([(s,) for s in sources], "content string", lexed.block_complexity(F.col("content")))
    assert [g[0] for g in got] == [plain_complexity(s) for s in sources] and max(g[0] for g in got) > 5


def test_odd_texts(values):
    cases = [
        ("", 0.0), ("x = 1 if y else 2\n", 0.0), ("def f(): pass", 1.0), ("def f():\n# if\n    x = 'a if b' or \"c and d\"\n", 2.0),
        ("def f():\n    '''if\nand\n'''\n    return 1\n", 1.0), ("def f():\n\tif a:\n\t\treturn b and c\n\nif d: pass\n", 3.0),
        ("def f():\n    def g():\n        if a: pass\n    return g\ndef h(): return a or b\n", 2.5), ("def f(a,\n):\n    while a: pass\n", 2.0),
        ("def f():\n    x = 'no end if\n    if a: pass\n", 2.0), ('def f():\n    """no end\nif and or\n', 1.0), ("def f():\n    x = r'\\'' # if\n", 1.0),
        ("def f():\n    x = '" + "\\\\" * 100_000 + "if" * 100_000 + "'\n    if a: pass\n", 2.0), ('def f():\n    """' + '"" \\" if\n' * 3_000 + '"""\n    if a: pass\n', 2.0),
    ]
    got = values([(c,) for c, _ in cases], "content string", lexed.block_complexity(F.col("content")))
    assert [g[0] for g in got] == [w for _, w in cases]


def test_token_classes(values):
    source = "a = b + 'b + c' ** 2 # x + y\nif a is not b and a <= 0x1F: c //= 1.5; f(a)[b] -> z\n"
    got = values([(source,), ("",), (None,)], "content string", lexed.token_classes(F.col("content")))
    # + ** is not and <= //=  |  a b 'b + c' 2 a b a 0x1F c 1 5 f a b z
    assert tuple(got[0][0]) == (7, 7, 15, 10) and tuple(got[1][0]) == (0, 0, 0, 0)
    volume = values([(5, 2), (0, 0)], "n int, d int", text.token_volume(F.col("n"), F.col("d")))
    assert volume == [(5.0,), (0.0,)]
