"""Complexity and token statistics of Python texts by their tokens, inside the row that holds the text.

One pattern takes strings and comments whole, leftmost first, so a word in them is no word of the code, and a quote in a
comment opens no string. Its loops are possessive and unrolled: long strings need no deep recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from srcpulse.functions.numbers import bind, round_half_even
from srcpulse.functions.text import DECISION_WORDS

# --- fixed values: words and signs of the language ------------------------------------------------
KEYWORDS = (
    "False", "None", "True", "as", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif", "else",
    "except", "finally", "for", "from", "global", "if", "import", "lambda", "nonlocal", "pass", "raise", "return", "try", "while",
    "with", "yield",
)
OPERATOR_WORDS = ("and", "in", "is", "not", "or")
OPERATOR_SIGNS = r"\*\*=?|//=?|<<=?|>>=?|[<>!=]=|[-+*/%&|^@]=|[-+*/%&|^~<>@]"
# ------------------------------------------------------------------------------------------------
_TRIPLE = r"{0}{0}{0}[^{0}\\]*+(?:(?:\\[\s\S]|{0}(?!{0}{0}))[^{0}\\]*+)*+(?:{0}{0}{0}|\z)"
_SINGLE = r"{0}[^{0}\\\n]*+(?:\\[\s\S][^{0}\\\n]*+)*+{0}?"
STRING = "|".join(form.format(mark) for form in (_TRIPLE, _SINGLE) for mark in ('"', "'"))
COMMENT = r"#[^\n]*+"
WORD = r"\w++"
TOKENS = f"{STRING}|{COMMENT}|{WORD}|->|:=|{OPERATOR_SIGNS}"
TAB = " " * 8


def bare_code(content: Column) -> Column:
    """The text without strings and comments; each leaves a blank, so a line that holds nothing else is blank."""
    return F.regexp_replace(content, f"{STRING}|{COMMENT}", " ")


def block_complexity(content: Column) -> Column:
    """Mean over the functions of a text of 1 + the decisions in them, rounded; 0 without a function.

    A function reaches as far as lines are indented more than its start; blank lines and lines that open with a closing
    bracket belong to what is around them. A function inside another one adds its own path to that one, and decisions outside of
    functions count for none.
    """
    lines = F.transform(F.split(bare_code(content), "\n"), lambda x: F.replace(x, F.lit("\t"), F.lit(TAB)))
    code = F.filter(lines, lambda x: ~x.rlike(r"^\s*(?:[)\]}].*)?$"))

    def measured(line: Column) -> Column:
        return F.struct(
            (F.length(line) - F.length(F.ltrim(line))).alias("indent"), line.rlike(r"^\s*(?:async\s+)?def\s").alias("starts"),
            F.regexp_count(line, F.lit(DECISION_WORDS)).alias("words"),
        )

    def step(state: Column, line: Column) -> Column:
        inside = (state["within"] >= 0) & (line["indent"] > state["within"])
        opens = ~inside & line["starts"]
        return F.struct(
            F.when(inside, state["within"]).when(opens, line["indent"]).otherwise(-1).alias("within"),
            (state["functions"] + opens.cast("int")).alias("functions"),
            (state["paths"] + F.when(inside | opens, line["words"]).otherwise(0) + line["starts"].cast("int")).alias("paths"),
        )

    start = F.struct(F.lit(-1).alias("within"), F.lit(0).alias("functions"), F.lit(0).alias("paths"))
    total = F.aggregate(F.transform(code, measured), start, step)
    # Every start adds a path: that of its own function, or of the function around it.
    return bind(total, lambda t: F.coalesce(round_half_even(F.try_divide(t["paths"].cast("double"), t["functions"])), F.lit(0.0)))


def token_classes(content: Column) -> Column:
    """``struct<operators, distinct_operators, operands, distinct_operands>`` of a text.

    Operators are signs of arithmetic, comparison and bits with or without ``=``, and the words for logic and membership. Operands
    are names, numbers and whole strings. Keywords, brackets, separators, plain ``=`` and comments are neither.
    """
    tokens = F.filter(F.regexp_extract_all(content, F.lit(TOKENS), F.lit(0)), lambda t: ~t.startswith("#") & ~t.isin("->", ":="))

    def classes(found: Column) -> Column:
        operators = F.filter(found, lambda t: t.isin(*OPERATOR_WORDS) | ~t.rlike(r"^[\w\"']"))
        operands = F.filter(found, lambda t: t.rlike(r"^[\w\"']") & ~t.isin(*OPERATOR_WORDS, *KEYWORDS))
        return F.struct(
            F.size(operators).alias("operators"), F.size(F.array_distinct(operators)).alias("distinct_operators"),
            F.size(operands).alias("operands"), F.size(F.array_distinct(operands)).alias("distinct_operands"),
        )

    return bind(tokens, classes)
