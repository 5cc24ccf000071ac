"""Style findings over a corpus: per file, as rows, as a gate and as rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from srcpulse.functions import style
from srcpulse.functions.text import STYLE_EXTENSIONS, extension, split_lines, strip_lines, universal_newlines


def with_lines(files: DataFrame) -> DataFrame:
    """Adds ``ext``, ``lines`` and ``bare_lines``; ``content`` gets the line ends a text-mode read gives."""
    text = files.withColumns({"ext": extension(F.col("file_path")), "content": universal_newlines(F.col("content"))})
    lines = text.withColumn("lines", split_lines(F.col("content")))
    return lines.withColumn("bare_lines", strip_lines(F.col("lines"), F.col("content")))


def style_check(
    files: DataFrame, rules: Sequence[style.Rule] = style.DEFAULT_RULES,
    extensions: Sequence[str] | None = STYLE_EXTENSIONS, report_unreadable: bool = False, keep: Sequence[str] = (),
) -> DataFrame:
    """One row per file: its findings in rule order, their number, risk and first warnings. No shuffle.

    Text without content has no findings, or one ``check_error`` with ``report_unreadable``.
    """
    text = with_lines(files)
    found = style.style_issues(F.col("content"), F.col("lines"), F.col("bare_lines"), F.col("ext"), rules, extensions)
    if report_unreadable:
        unread = F.col("content").isNull()
        if extensions is not None:
            unread = unread & F.col("ext").isin(*extensions)
        found = F.when(unread, style.unreadable_issue()).otherwise(found)
    issues = F.col("issues")
    return text.select("file_path", *keep, found.alias("issues")).select(
        "file_path", *keep, "issues",
        F.size(issues).alias("issue_count"),
        style.style_risk(issues).alias("style_risk_score"),
        style.style_warnings(issues).alias("style_warnings"),
    )


def style_issue_rows(checked: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per finding.

    The outer form of explode is on purpose: for the plain form the optimizer adds a filter on the array
    below it, which would run all rules again.
    """
    rows = checked.select("file_path", *keep, F.explode_outer("issues").alias("i")).filter(F.col("i").isNotNull())
    return rows.select("file_path", *keep, "i.*")


def issues_per_file(checked: DataFrame, keep: int | None = None) -> DataFrame:
    """The findings of each file in rule order, or the first ``keep``, and the full count."""
    shown = F.col("issues") if keep is None else F.slice("issues", 1, keep)
    return checked.select("file_path", shown.alias("style_issues"), F.col("issue_count"))


def severity_counts(issue_rows: DataFrame) -> DataFrame:
    return issue_rows.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in style.SEVERITIES])


# --- fixed values: gate messages -----------------------------------------------------------------
GATE_FAILED = "Fix critical/high issues before commit."
GATE_PASSED = "No critical or high issues."
NO_FILES = "No files to check."
NO_VALID_FILES = "No valid files to check (outside repo, missing, or too large)."
# -------------------------------------------------------------------------------------------------


def severity_columns(issues="issues") -> list:
    """Small counts by severity and category of a file's findings, for sums further up."""
    col = F.col(issues)
    return [style.count_where(col, "severity", s).cast("bigint").alias(s) for s in style.SEVERITIES] + [
        style.count_where(col, "category", c).cast("bigint").alias(c) for c in style.CATEGORIES
    ]


def gate_report(checked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pass/fail over checked files: sums of per-file counts, combined before the shuffle. No files passes."""
    per_file = checked.select(*by, "issue_count", *severity_columns())
    zero = F.lit(0).cast("bigint")
    sums = per_file.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files_checked"),
        F.count_if(F.col("issue_count") > 0).alias("files_with_issues"),
        F.coalesce(F.sum("issue_count"), zero).alias("total_issues"),
        *[F.coalesce(F.sum(s), zero).alias(s) for s in style.SEVERITIES],
    )
    return with_verdict(sums, by)


def with_verdict(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pass/fail and message for counts of files, findings and severities."""
    ok = (F.col("critical") == 0) & (F.col("high") == 0)
    message = (
        F.when(F.col("files_checked") == 0, F.lit(NO_FILES)).when(ok, F.lit(GATE_PASSED)).otherwise(F.lit(GATE_FAILED))
    )
    return sums.select(*by, ok.alias("ok"), *[c for c in sums.columns if c not in by], message.alias("message"))


def style_rollup(issue_rows: DataFrame) -> DataFrame:
    """Counts by category, by severity and in total, as ``dimension, value, issues``.

    The rows are first counted by (category, severity), a handful of groups; the grouping sets then run
    over those.
    """
    base = issue_rows.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))
    sets = base.groupingSets([["category"], ["severity"], []], "category", "severity").agg(
        F.sum("n").alias("issues"), F.grouping("category").alias("gc"), F.grouping("severity").alias("gs")
    )
    return sets.select(
        F.when(F.col("gc") == 0, F.lit("category")).when(F.col("gs") == 0, F.lit("severity")).otherwise(F.lit("total")).alias(
            "dimension"
        ),
        F.when(F.col("gc") == 0, F.col("category")).when(F.col("gs") == 0, F.col("severity")).otherwise(F.lit("all")).alias(
            "value"
        ),
        F.coalesce("issues", F.lit(0).cast("bigint")).alias("issues"),
    )
