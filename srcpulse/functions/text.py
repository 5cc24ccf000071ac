"""Paths, lines and text metrics of one file, all computed inside the row that holds the text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from srcpulse.functions.numbers import bind, round_half_even

# --- fixed values: file extensions --------------------------------------------------------------
SUPPORTED_EXTENSIONS = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".cpp", ".c", ".go", ".rs", ".php", ".rb", ".swift", ".kt",
)
STYLE_EXTENSIONS = (".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rs", ".rb")
# --- fixed values: what counts as a line break and as white space -------------------------------
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
RARE_WHITE_SPACE = r"[\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# --- fixed values: constructs that add one path, and what starts a function ---------------------
DECISION_WORDS = r"\b(?:if|elif|for|while|except|with|assert|and|or)\b"
FUNCTION_START = r"(?m)^\s*(?:async\s+)?def\s"
TOKEN = r"\w+|[^\w\s]"
# ------------------------------------------------------------------------------------------------


def extension(path: Column) -> Column:
    """Text from the last dot of the file name; empty for ``.bashrc``, ``name.`` and ``dir.d/name``."""
    return F.regexp_extract(path, r"[^/](\.[^/.]+)$", 1)


def is_supported(path: Column, extensions=SUPPORTED_EXTENSIONS) -> Column:
    return extension(path).isin(*extensions)


def universal_newlines(content: Column) -> Column:
    """What a text-mode read does: ``\\r\\n`` and a lone ``\\r`` become ``\\n``."""
    return F.when(F.contains(content, F.lit("\r")), F.regexp_replace(content, r"\r\n?", "\n")).otherwise(content)


def split_lines(content: Column) -> Column:
    """Lines without their breaks; a break at the very end opens no further line, empty text has none."""

    def lines(pieces: Column) -> Column:
        n = F.size(pieces)
        return F.when(F.get(pieces, n - 1) == "", F.slice(pieces, F.lit(1), n - 1)).otherwise(pieces)

    return bind(F.split(content, LINE_BREAK, -1), lines)


def strip(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE_SPACE))


def strip_lines(lines: Column, content: Column) -> Column:
    """Every line without white space at its ends. Texts with none but blanks and tabs, so nearly all, go the short way."""
    return F.when(content.rlike(RARE_WHITE_SPACE), F.transform(lines, strip)).otherwise(
        F.transform(lines, lambda x: F.btrim(x, F.lit(" \t")))
    )


def short_path(path: Column, width: int = 60) -> Column:
    return F.when(F.length(path) > width, F.concat(F.lit("..."), F.right(path, F.lit(width - 3)))).otherwise(path)


def code_sample(content: Column, n_lines: int | None = None) -> Column:
    """The text, or its first ``n_lines`` lines with their breaks: the query text of the similarity search."""
    text = universal_newlines(content)
    if n_lines is None:
        return text
    head = F.substring_index(text, "\n", n_lines)
    return F.when(head == text, text).otherwise(F.concat(head, F.lit("\n")))


def is_comment_line(stripped: Column) -> Column:
    return stripped.startswith("#") | stripped.startswith("//")


def line_counts(bare_lines: Column) -> Column:
    """``struct<line_count, nonblank_lines, comment_lines>`` of stripped lines."""
    return F.struct(
        F.size(bare_lines).alias("line_count"),
        F.size(F.filter(bare_lines, lambda x: x != "")).alias("nonblank_lines"),
        F.size(F.filter(bare_lines, is_comment_line)).alias("comment_lines"),
    )


def ratio3(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, round_half_even(part.cast("double") / whole, 3)).otherwise(F.lit(0.0))


def mean_block_complexity(content: Column) -> Column:
    """Mean over the functions of a text of 1 + its decision words; 0 without a function.

    A word count that stands in for a syntax tree. As every block starts at one, the mean is
    1 + (decision words after the first function start) / functions: two pattern counts, no array.
    """
    blocks = F.regexp_count(content, F.lit(FUNCTION_START))
    body = F.split(content, FUNCTION_START, 2).getItem(1)
    words = F.regexp_count(body, F.lit(DECISION_WORDS))
    mean = round_half_even(F.try_divide((blocks + words).cast("double"), blocks))
    return F.coalesce(mean, F.lit(0.0))


def token_volume(tokens: Column, distinct_tokens: Column) -> Column:
    """Bits that a text of so many tokens, so many of them distinct, needs; 0 for none."""
    return F.when(distinct_tokens > 0, tokens * F.log2(distinct_tokens.cast("double"))).otherwise(F.lit(0.0))


def maintainability_index(
    tokens: Column, distinct_tokens: Column, complexity: Column, lines: Column, comment_lines: Column
) -> Column:
    """The published maintainability formula over token volume, complexity, lines and comment share, 0-100."""
    volume = tokens * F.log2(distinct_tokens.cast("double"))
    comment_share = comment_lines * 100.0 / lines
    raw = (
        F.lit(171.0)
        - F.log(volume) * 5.2
        - complexity * 0.23
        - F.log(lines.cast("double")) * 16.2
        + F.sin(F.sqrt(F.radians(comment_share) * 2.4)) * 50.0
    )
    scaled = F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw * 100.0 / 171.0))
    return F.when((lines <= 0) | (distinct_tokens < 2), F.lit(100.0)).otherwise(F.round(scaled, 2))
