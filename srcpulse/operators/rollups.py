"""Repository-level reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from srcpulse.functions import scoring, style
from srcpulse.functions.numbers import round_half_even
from srcpulse.operators.history import top_n_risky

# --- fixed values: suggestions and their limits --------------------------------------------------
ADD_README = (
    "Add a README with install steps, how to run tests, and a short architecture overview so others can onboard quickly."
)
ADD_LICENSE = "Add a LICENSE file so downstream users know how they may use and redistribute the code."
ADD_GITIGNORE = (
    "Add a .gitignore for build artifacts, virtualenvs, and editor files to keep clones clean for collaborators."
)
ADD_CONTRIBUTING = "Consider CONTRIBUTING.md with PR expectations, coding style, and how to report issues."
FIX_CRITICAL = (
    "Address critical style findings (e.g. possible secrets in source) before sharing the repository publicly."
)
TIGHTEN_STYLE = (
    "Several AI-style signals (heavy comments, placeholders, generic names) were detected; tighten naming and trim "
    "redundant comments so intent is obvious to human reviewers."
)
HIGH_RISK_FILES = (
    " file(s) scored high or critical decay risk; prioritize refactors or tests in those areas before external "
    "contributions spike."
)
ELEVATED_RISK = (
    "Average decay risk is elevated; schedule focused refactors and add regression tests to stabilize areas new "
    "contributors will touch."
)
TIGHTEN_ERRORS = (
    "Multiple bug-prone patterns (broad exception handling, magic numbers, etc.) suggest tightening error handling and "
    "extracting constants for safer collaboration."
)
AI_STYLE_LIMIT = 5
BUG_PRONE_LIMIT = 8
ELEVATED_MEAN = 50
HYGIENE_FLAGS = ("has_readme", "has_license", "has_gitignore", "has_contributing", "has_code_of_conduct")
# -------------------------------------------------------------------------------------------------


def top_predicted_types(predictions: DataFrame, n: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Predicted issue types with their counts, per ``by`` if given; the ``n`` most common ones where ``n`` is given.

    Equal counts are in order of the type.
    """
    kinds = predictions.select(*by, F.explode_outer("predicted_issues").alias("i")).filter(F.col("i").isNotNull())
    counts = kinds.groupBy(*by, F.coalesce("i.type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    if n is None:
        return counts
    if not by:
        return counts.orderBy(F.desc("n"), "type").limit(n)
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "type")
    return counts.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def mean_decay(score: Column) -> Column:
    """Mean score with a missing score as 0 and no rows as 0, not rounded.

    Summed as decimals, so the result does not depend on the order in which tasks finish.
    """
    total = F.sum(F.coalesce(score, F.lit(0.0)).cast("decimal(20,10)"))
    return F.coalesce(F.try_divide(total.cast("double"), F.count(F.lit(1))), F.lit(0.0))


def avg_decay(predictions: DataFrame) -> DataFrame:
    return predictions.agg(round_half_even(mean_decay(F.col("decay_score"))).alias("avg_decay_score"))


def repo_hygiene(listing: DataFrame, below_root: bool = False) -> DataFrame:
    """Five flags from the names at the top of each repository, which may be files or folders.

    Paths start with the repository's name, or with ``below_root``, as ``scan_corpus`` gives them, right below it.
    """
    below = F.col("file_path")
    if not below_root:
        below = F.substring(below, F.length("repo") + 2, F.length("file_path"))
    name = F.lower(F.split(below, "/", 2).getItem(0))
    top = listing.select("repo", name.alias("n"))
    n = F.col("n")
    flags = (
        (n == "readme") | n.startswith("readme."),
        n.startswith("license") | (n == "copying"),
        n == ".gitignore",
        n.startswith("contributing"),
        n.contains("code_of_conduct") | (n == "conduct.md"),
    )
    return top.groupBy("repo").agg(*[F.bool_or(f).alias(name) for f, name in zip(flags, HYGIENE_FLAGS)])


def shareability(has_readme, has_license, has_gitignore, has_contributing, critical, ai_style, bug_prone, risky, mean) -> Column:
    """Up to eight suggestions for a repository, from its flags, counts and mean score."""
    return F.array_compact(
        F.array(
            F.when(~has_readme, F.lit(ADD_README)),
            F.when(~has_license, F.lit(ADD_LICENSE)),
            F.when(~has_gitignore, F.lit(ADD_GITIGNORE)),
            F.when(~has_contributing, F.lit(ADD_CONTRIBUTING)),
            F.when(critical > 0, F.lit(FIX_CRITICAL)),
            F.when(ai_style >= AI_STYLE_LIMIT, F.lit(TIGHTEN_STYLE)),
            F.when(risky > 0, F.concat(risky.cast("string"), F.lit(HIGH_RISK_FILES))).when(
                mean >= ELEVATED_MEAN, F.lit(ELEVATED_RISK)
            ),
            F.when(bug_prone >= BUG_PRONE_LIMIT, F.lit(TIGHTEN_ERRORS)),
        )
    )


def select_bounded(files: DataFrame, max_files: int | None = None, focus: Column | None = None) -> DataFrame:
    """All files, or the first ``max_files`` of each repository: a focus file first, then by path.

    Give it rows without the text: the choice needs keys only.
    """
    if max_files is None:
        return files
    lead = F.when(focus, 0).otherwise(1) if focus is not None else F.lit(0)
    order = Window.partitionBy("repo").orderBy(lead, "file_path")
    return files.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= max_files).drop("_r")


def skipped_counts(files: DataFrame, max_files: int | None = None) -> DataFrame:
    total = F.count(F.lit(1))
    skipped = F.greatest(total - max_files, F.lit(0)) if max_files is not None else F.lit(0)
    return files.groupBy("repo").agg(skipped.cast("bigint").alias("files_skipped"))


def repo_report(
    selected: DataFrame, skipped: DataFrame, listing: DataFrame, top_files: int | None = 15, top_types: int | None = 20, below_root: bool = False
) -> DataFrame:
    """One row per repository.

    ``selected``: a row per analysed file with ``repo, file_path, decay_score, risk_level, predicted_issues,
    recommendations`` and the small style counts of ``severity_columns``. Sums combine before the shuffle;
    the two lists are cut to their n rows by a row number before they are collected, so no list grows with
    the repository; with None for n a list holds all of its repository. The per-file rows stay their own table (``selected``).
    """
    zero = F.lit(0).cast("bigint")
    counts = [F.coalesce(F.sum(c), zero).alias(c) for c in (*style.SEVERITIES, *style.CATEGORIES)]
    sums = selected.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files_analyzed"),
        mean_decay(F.col("decay_score")).alias("_mean"),
        F.count_if(scoring.is_reportable(F.col("risk_level"))).alias("high_risk_count"),
        F.coalesce(F.sum("issue_count"), zero).alias("total_issues"),
        *counts,
    )
    entry = F.struct("risk_rank", "file_path", "decay_score", "risk_level", "recommendations")
    risky = top_n_risky(selected, top_files).groupBy("repo").agg(F.sort_array(F.collect_list(entry)).alias("highest_risk_files"))
    kinds = (
        top_predicted_types(selected, top_types, by=["repo"])
        .groupBy("repo")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "type"))).alias("_k"))
        .select(
            "repo",
            F.transform("_k", lambda k: F.struct(k["type"].alias("type"), (-k["neg"]).alias("n"))).alias("predicted_issue_types"),
        )
    )
    # Listings start the join: a repository without a source file still has its hygiene row.
    joined = repo_hygiene(listing, below_root)
    for part in (sums, skipped, risky, kinds):
        joined = joined.join(part, "repo", "left")
    numbers = ("files_analyzed", "files_skipped", "high_risk_count", "total_issues", *style.SEVERITIES, *style.CATEGORIES)
    joined = joined.withColumns({c: F.coalesce(c, zero) for c in numbers}).withColumn("_mean", F.coalesce("_mean", F.lit(0.0)))
    c = F.col
    return joined.select(
        "repo", "files_analyzed", "files_skipped", round_half_even(c("_mean")).alias("avg_decay_score"),
        "high_risk_count", "highest_risk_files", *HYGIENE_FLAGS, "predicted_issue_types", "total_issues",
        *style.CATEGORIES, *style.SEVERITIES,
        shareability(
            c("has_readme"), c("has_license"), c("has_gitignore"), c("has_contributing"), c("critical"), c("ai_style"),
            c("bug_prone_style"), c("high_risk_count"), c("_mean"),
        ).alias("shareability_recommendations"),
    )
