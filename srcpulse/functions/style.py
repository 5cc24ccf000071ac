"""Text checks of one file. Rules are data: pass your own list to add, drop or replace checks.

All checks run inside the row that holds the text and give one array of findings in rule order, so no
line ever leaves its row and nothing is shuffled to bring the findings of a file back together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from srcpulse.functions.text import STYLE_EXTENSIONS
from srcpulse.schemas import ISSUE

ISSUES = f"array<{ISSUE}>"


@dataclass(frozen=True)
class Rule:
    """One check.

    ``finding`` gives the message, or null where the check does not apply. Its arguments depend on
    ``scope``: ``line`` gets the line; ``pair`` gets the line and the next one (null after the last);
    ``file`` gets the whole text and the array of lines and is reported at line 0. Lines come without white
    space at their ends, which is taken off once for all rules, or as they are with ``raw_lines``.
    ``guard`` is a cheap test of the whole text that must hold wherever the check can hit; it saves
    the pass over the lines. ``shift`` moves the reported line, ``skip_last`` leaves out that many
    lines at the end.
    """

    type: str
    severity: str
    category: str
    scope: str
    finding: Callable[..., Column]
    extensions: tuple[str, ...] | None = None
    guard: Callable[[Column], Column] | None = None
    shift: int = 0
    skip_last: int = 0
    raw_lines: bool = False


def regex_rule(
    type: str, regex: str, severity: str, category: str, message: str, scope: str = "line",
    extensions: Sequence[str] | None = None,
) -> Rule:
    """A rule from plain values: a finding for every line (or text) the regular expression matches."""
    if scope not in ("line", "file"):
        raise ValueError("a regular-expression rule has scope 'line' or 'file'")

    def finding(subject, *_):
        return F.when(subject.rlike(regex), F.lit(message))

    return Rule(type, severity, category, scope, finding, tuple(extensions) if extensions else None, raw_lines=True)


def first_label(line: Column, patterns: Iterable[tuple[str, str]]) -> Column:
    """Label of the first pattern, in list order, that the line matches; null without a match."""
    out = F
    for regex, label in patterns:
        out = out.when(line.rlike(regex), F.lit(label))
    return out


def has_word(text: Column, words: Sequence[str]) -> Column:
    """Whether a text holds one of the words in any case: by plain search in ASCII, elsewhere by a pattern with all of Unicode's cases."""
    low = F.lower(text)
    plain = reduce(or_, [low.contains(w) for w in words])
    return F.when(F.octet_length(text) == F.length(text), plain).otherwise(text.rlike(f"(?iU){'|'.join(words)}"))


# --- fixed values: patterns, messages, severities, weights ---------------------------------------
BUG_PRONE = "bug_prone_style"
AI_STYLE = "ai_style"
SYSTEM = "system"

PLACEHOLDERS = (
    (r"(?iU)\bTODO\b", "TODO"),
    (r"(?iU)\bFIXME\b", "FIXME"),
    (r"(?iU)\bXXX\b", "XXX"),
    (r"(?iU)\bHACK\b", "HACK"),
    (r"(?iU)placeholder", "placeholder"),
    (r"(?iU)implement\s+later", "implement later"),
    (r"(?iU)not\s+implemented", "not implemented"),
)
PLACEHOLDER_WORDS = ("todo", "fixme", "xxx", "hack", "placeholder", "implement")

SECRETS = (
    (r"(?iU)password\s*=\s*['\"][^'\"]+['\"]", "hardcoded password"),
    (r"(?iU)api[_-]?key\s*=\s*['\"][^'\"]+['\"]", "hardcoded API key"),
    (r"(?iU)secret\s*=\s*['\"][^'\"]+['\"]", "hardcoded secret"),
    (r"(?iU)Bearer\s+[a-zA-Z0-9_\-\.]+", "hardcoded Bearer token"),
)
SECRET_WORDS = ("password", "apikey", "api_key", "api-key", "secret", "bearer")

MAGIC_NUMBER = r"(?U)\b(?:[2-9]|[1-9]\d{2,})\b"
MAGIC_NUMBER_LIMIT = 5
COMMENT_RATIO_LIMIT = 0.6
COMMENT_RATIO_MIN_LINES = 10
GENERIC_NAMES = (
    r"(?U)\bdata\s*=",
    r"(?U)\bresult\s*=",
    r"(?U)\bvalue\s*=",
    r"(?U)\bthing\s*=",
    r"(?U)\bstuff\s*=",
    r"(?U)def\s+process\s*\(",
    r"(?U)def\s+handle\s*\(",
    r"(?U)def\s+do_something\s*\(",
)
GENERIC_WORDS = ("data", "result", "value", "thing", "stuff", "process", "handle", "do_something")
GENERIC_NAME_LIMIT = 4
DUPLICATE_MIN_LENGTH = 20

BARE_EXCEPT_TEXT = "Bare 'except:' catches everything and can hide bugs. Use 'except Exception:' or specific exception."
EMPTY_EXCEPT_TEXT = "Empty or pass-only except block hides errors. Log or re-raise."
EMPTY_CATCH_TEXT = "Empty catch block hides errors. Log or handle."
PLACEHOLDER_TEXT = ("'", "' left in code. Fix before commit to avoid incomplete behavior.")
MAGIC_NUMBER_TEXT = "Many literal numbers in code. Consider named constants to avoid bugs when changing values."
BROAD_EXCEPT_TEXT = "Catching Exception and passing can hide real bugs. Prefer specific exceptions or log."
SECRET_TEXT = ("Possible ", ". Use environment variables or a secrets manager before commit.")
COMMENT_RATIO_TEXT = (
    "Very high comment-to-code ratio. Common in AI-generated code; ensure logic is correct and comments are accurate."
)
GENERIC_NAME_TEXT = (
    "Many generic names (data, result, process). Consider descriptive names to avoid confusion and bugs."
)
DUPLICATE_TEXT = "Duplicate consecutive lines. May be copy-paste; verify logic."
UNREADABLE_TEXT = "file content could not be read"

SEVERITY_WEIGHTS = (("critical", 25), ("high", 15), ("medium", 8), ("low", 3))
SEVERITIES = ("critical", "high", "medium", "low")
CATEGORIES = (BUG_PRONE, AI_STYLE, SYSTEM)
# -------------------------------------------------------------------------------------------------


def _bare_except(line):
    hit = line.rlike(r"(?U)\bexcept\s*:") & ~line.contains("pass") & ~line.contains("#")
    return F.when(hit, F.lit(BARE_EXCEPT_TEXT))


def _empty_except(line, following):
    idle = following.isin("pass", "") | following.startswith("#")
    return F.when(following.isNotNull() & line.rlike(r"(?U)^except\s+.*:$") & idle, F.lit(EMPTY_EXCEPT_TEXT))


def _empty_catch(line):
    return F.when(line.contains("catch") & line.contains("{}"), F.lit(EMPTY_CATCH_TEXT))


def _placeholder(line):
    label = F.when(has_word(line, PLACEHOLDER_WORDS), first_label(line, PLACEHOLDERS))
    return F.concat(F.lit(PLACEHOLDER_TEXT[0]), label, F.lit(PLACEHOLDER_TEXT[1]))


def _magic_numbers(content, lines):
    many = F.regexp_count(content, F.lit(MAGIC_NUMBER)) >= MAGIC_NUMBER_LIMIT
    return F.when(many, F.lit(MAGIC_NUMBER_TEXT))


def _broad_except(content, lines):
    return F.when(
        content.contains("pass") & content.rlike(r"(?U)except\s+Exception\s*:"), F.lit(BROAD_EXCEPT_TEXT)
    )


def _secret(line):
    label = F.when(has_word(line, SECRET_WORDS), first_label(line, SECRETS))
    return F.concat(F.lit(SECRET_TEXT[0]), label, F.lit(SECRET_TEXT[1]))


def _comment_ratio(content, lines):
    code = F.size(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")))
    comments = F.size(F.filter(lines, lambda x: x.startswith("#") | x.contains("//")))
    ratio = F.try_divide(comments.cast("double"), code)
    marked = content.contains("#") | content.contains("//")
    return F.when(marked & (ratio > COMMENT_RATIO_LIMIT) & (code >= COMMENT_RATIO_MIN_LINES), F.lit(COMMENT_RATIO_TEXT))


def _generic_names(content, lines):
    def found(word: str, pattern: str) -> Column:
        return (content.contains(word) & content.rlike(pattern)).cast("int")

    seen = sum((found(w, p) for w, p in zip(GENERIC_WORDS, GENERIC_NAMES)), F.lit(0))
    return F.when(seen >= GENERIC_NAME_LIMIT, F.lit(GENERIC_NAME_TEXT))


def _duplicate(line, following):
    same = (line == following) & (F.length(line) > DUPLICATE_MIN_LENGTH)
    return F.when(same, F.lit(DUPLICATE_TEXT))


PLACEHOLDER_RULE = Rule(
    "placeholder_comment", "low", AI_STYLE, "line", _placeholder, guard=lambda c: has_word(c, PLACEHOLDER_WORDS)
)

# The order is the order of findings. Placeholders come twice: every such line is listed and scored twice.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("bare_except", "high", BUG_PRONE, "line", _bare_except, (".py",), lambda c: c.contains("except")),
    Rule("empty_except", "medium", BUG_PRONE, "pair", _empty_except, (".py",), lambda c: c.contains("except"), shift=1),
    Rule("empty_catch", "medium", BUG_PRONE, "line", _empty_catch, (".js", ".ts"), lambda c: c.contains("catch")),
    PLACEHOLDER_RULE,
    Rule("magic_numbers", "low", BUG_PRONE, "file", _magic_numbers),
    Rule("broad_except_pass", "medium", BUG_PRONE, "file", _broad_except, (".py",)),
    Rule("hardcoded_secret", "critical", BUG_PRONE, "line", _secret, guard=lambda c: has_word(c, SECRET_WORDS)),
    Rule("high_comment_ratio", "low", AI_STYLE, "file", _comment_ratio),
    PLACEHOLDER_RULE,
    Rule("generic_names", "low", AI_STYLE, "file", _generic_names),
    Rule("duplicate_lines", "medium", BUG_PRONE, "pair", _duplicate, skip_last=2),
)


def single_placeholder_rules() -> tuple[Rule, ...]:
    """The default rules with the placeholder check once."""
    second = len(DEFAULT_RULES) - 1 - DEFAULT_RULES[::-1].index(PLACEHOLDER_RULE)
    return DEFAULT_RULES[:second] + DEFAULT_RULES[second + 1 :]


def rules_of(*types: str) -> tuple[Rule, ...]:
    return tuple(r for r in DEFAULT_RULES if r.type in types)


def for_all_extensions(rule: Rule) -> Rule:
    return replace(rule, extensions=None)


def _issue(rule: Rule, order: int, line: Column, message: Column) -> Column:
    return F.struct(
        F.lit(order).alias("rule_ord"),
        F.lit(rule.type).alias("type"),
        F.lit(rule.severity).alias("severity"),
        line.cast("int").alias("line"),
        message.alias("message"),
        F.lit(rule.category).alias("category"),
    )


def _findings(rule: Rule, order: int, content: Column, raw: Column, bare: Column, ext: Column, empty: Column) -> Column:
    lines = raw if rule.raw_lines else bare
    if rule.scope == "file":
        message = rule.finding(content, lines)
        found = F.when(message.isNotNull(), F.array(_issue(rule, order, F.lit(0), message)))
    elif rule.scope in ("line", "pair"):

        def at(line, pos):
            message = rule.finding(line, F.get(lines, pos + 1)) if rule.scope == "pair" else rule.finding(line)
            inside = message.isNotNull()
            if rule.skip_last:
                inside = (pos < F.size(lines) - rule.skip_last) & inside
            return F.when(inside, _issue(rule, order, pos + 1 + rule.shift, message))

        found = F.array_compact(F.transform(lines, at))
    else:
        raise ValueError(f"unknown scope {rule.scope!r}")
    if rule.guard is not None:
        found = F.when(rule.guard(content), found)
    if rule.extensions is not None:
        found = F.when(ext.isin(*rule.extensions), found)
    return F.coalesce(found, empty)


def style_issues(
    content: Column, lines: Column, bare_lines: Column, ext: Column, rules: Sequence[Rule] = DEFAULT_RULES,
    extensions: Sequence[str] | None = STYLE_EXTENSIONS,
) -> Column:
    """All findings of one text as an array in rule order; none out of scope or for unreadable text."""
    empty = F.array().cast(ISSUES)
    found = F.flatten(
        F.array(*[_findings(r, i + 1, content, lines, bare_lines, ext, empty) for i, r in enumerate(rules)])
    )
    in_scope = content.isNotNull()
    if extensions is not None:
        in_scope = in_scope & ext.isin(*extensions)
    return F.when(in_scope, found).otherwise(empty)


def unreadable_issue() -> Column:
    """The one finding of a file that could not be read."""
    rule = Rule("check_error", "medium", SYSTEM, "file", lambda *_: F.lit(UNREADABLE_TEXT))
    return F.array(_issue(rule, 0, F.lit(0), F.lit(UNREADABLE_TEXT))).cast(ISSUES)


def count_where(issues: Column, field: str, value: str) -> Column:
    return F.size(F.filter(issues, lambda i: i[field] == value))


def style_risk(issues: Column) -> Column:
    """Weights by severity summed, at most 100."""
    weighted = sum((count_where(issues, "severity", s) * w for s, w in SEVERITY_WEIGHTS), F.lit(0))
    return F.least(F.lit(100), weighted).cast("int")


def style_warnings(issues: Column, keep: int | None = 10) -> Column:
    """Messages of the first ``keep`` findings, or of all."""
    return F.transform(issues if keep is None else F.slice(issues, 1, keep), lambda i: i["message"])
