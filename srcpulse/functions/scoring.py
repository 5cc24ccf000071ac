"""Risk scores, levels, warnings and predictions as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from srcpulse.functions.numbers import round_half_even
from srcpulse.schemas import PREDICTED_ISSUE


# --- fixed values: thresholds, weights and steps -------------------------------------------------
@dataclass(frozen=True)
class ScoreConfig:
    complexity_high: float = 20
    complexity_very_high: float = 30
    complexity_high_points: float = 25
    complexity_very_high_points: float = 40
    complexity_linear_points: float = 15
    trend_up_points: float = 25
    trend_down_points: float = 10
    low_maintainability: float = 20
    churn_steps: tuple = ((20, 30.0), (10, 20.0), (5, 10.0))
    author_steps: tuple = ((5, 20.0), (3, 10.0))
    gap_short_days: float = 7
    gap_short_points: float = 25
    gap_medium_days: float = 14
    gap_medium_points: float = 15
    hotspot_commits: int = 10
    import_steps: tuple = ((30, 30.0), (20, 20.0), (10, 10.0))
    depth_steps: tuple = ((5, 25.0), (3, 15.0))
    decay_pattern_points: float = 20
    bug_pattern_points: float = 30
    weight_complexity: float = 0.30
    weight_velocity: float = 0.25
    weight_dependency: float = 0.20
    weight_pattern: float = 0.25
    level_steps: tuple = ((80, "critical"), (60, "high"), (40, "medium"))
    level_floor: str = "low"
    many_commits: int = 15
    many_authors: int = 4
    very_many_commits: int = 20
    very_many_authors: int = 5
    many_imports: int = 15
    very_many_imports: int = 25
    trimmed_imports: int = 20
    refactor_now_score: float = 70
    refactor_later_score: float = 50
    refactor_steps: tuple = ((60, 60), (40, 90))
    refactor_now_days: int = 30
    refactor_now_gap_days: float = 14
    refactor_floor_days: int = 180
    confidence: float = 0.75
    default_gap_days: float = 30


DEFAULT = ScoreConfig()

VERY_HIGH_COMPLEXITY = ("Very high complexity (", "). Consider refactoring.")
HIGH_COMPLEXITY = ("High complexity (", "). Monitor closely.")
LOW_MAINTAINABILITY = ("Very low maintainability index (", "). Refactor recommended.")
RISING_COMPLEXITY = "Complexity is increasing over time."
HIGH_CHURN = ("High churn: ", " changes in 90 days.")
MANY_AUTHORS = ("Multiple authors (", ") may indicate coordination issues.")
CHURN_AND_AUTHORS = "Critical: High churn + many authors = high risk."
VERY_MANY_IMPORTS = ("Very high import count (", "). Consider modularization.")
MANY_IMPORTS = ("High import count (", "). Monitor dependencies.")
SIMILAR_BUGS = ("Similar to ", " known bug patterns.")
CRITICAL_BUG = "Matches critical bug pattern - immediate review recommended."
GROWTH_ISSUE = ("complexity_growth", "Complexity is increasing - may become unmaintainable", 0.7, "3-6 months")
CHURN_ISSUE = ("high_churn", "High change frequency indicates instability", 0.65, "1-3 months")
BUG_ISSUE = (("Similar to known ", " pattern"), 0.6, "2-4 months")
SPLIT_HOTSPOT = "Consider splitting this frequently-changed file into smaller modules"
TRIM_IMPORTS = "High dependency count - review and remove unused imports"
REFACTOR_NOW = "CRITICAL: Schedule refactoring within next sprint"
REFACTOR_LATER = "Add to technical debt backlog for next quarter"
REPORTABLE_LEVELS = ("high", "critical")
# -------------------------------------------------------------------------------------------------


def _steps(value: Column, steps, floor=0.0) -> Column:
    """Points of the first step the value is above."""
    out = F
    for above, points in steps:
        out = out.when(value > above, F.lit(points))
    return out.otherwise(F.lit(floor))


def _clamp(score: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))


def _around(words: tuple, value: Column) -> Column:
    return F.concat(F.lit(words[0]), value.cast("string"), F.lit(words[1]))


def _present(*messages: Column) -> Column:
    return F.array_compact(F.array(*messages))


def complexity_risk(cc: Column, trend: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    level = (
        F.when(cc >= cfg.complexity_very_high, F.lit(float(cfg.complexity_very_high_points)))
        .when(cc >= cfg.complexity_high, F.lit(float(cfg.complexity_high_points)))
        .otherwise(cc / float(cfg.complexity_high) * float(cfg.complexity_linear_points))
    )
    shift = (
        F.when(trend == "increasing", F.lit(float(cfg.trend_up_points)))
        .when(trend == "decreasing", F.lit(-float(cfg.trend_down_points)))
        .otherwise(F.lit(0.0))
    )
    return _clamp(level + shift)


def complexity_warnings(cc: Column, mi: Column, trend: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    return _present(
        F.when(cc >= cfg.complexity_very_high, _around(VERY_HIGH_COMPLEXITY, cc)).when(
            cc >= cfg.complexity_high, _around(HIGH_COMPLEXITY, cc)
        ),
        F.when(mi < cfg.low_maintainability, _around(LOW_MAINTAINABILITY, mi)),
        F.when(trend == "increasing", F.lit(RISING_COMPLEXITY)),
    )


def churn_risk(commits: Column, authors: Column, gap: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    """``gap`` is the mean gap in days, already rounded to two decimals."""
    rhythm = (
        F.when((gap > 0) & (gap < cfg.gap_short_days), F.lit(float(cfg.gap_short_points)))
        .when(gap < cfg.gap_medium_days, F.lit(float(cfg.gap_medium_points)))
        .otherwise(F.lit(0.0))
    )
    return F.least(F.lit(100.0), _steps(commits, cfg.churn_steps) + _steps(authors, cfg.author_steps) + rhythm)


def is_hotspot(commits: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    return commits > cfg.hotspot_commits


def churn_warnings(commits: Column, authors: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    return _present(
        F.when(commits > cfg.many_commits, _around(HIGH_CHURN, commits)),
        F.when(authors > cfg.many_authors, _around(MANY_AUTHORS, authors)),
        F.when((commits > cfg.very_many_commits) & (authors > cfg.very_many_authors), F.lit(CHURN_AND_AUTHORS)),
    )


def dependency_risk(imports: Column, depth: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    return F.least(F.lit(100.0), _steps(imports, cfg.import_steps) + _steps(depth, cfg.depth_steps))


def dependency_warnings(imports: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    return _present(
        F.when(imports > cfg.very_many_imports, _around(VERY_MANY_IMPORTS, imports)).when(
            imports > cfg.many_imports, _around(MANY_IMPORTS, imports)
        )
    )


def similarity(distance: Column) -> Column:
    return F.lit(1.0) - F.least(distance, F.lit(1.0))


def pattern_risk(decay: Column, bugs: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    """Points for near decay and bug patterns; the arrays hold at most k neighbours, nearest first."""
    after_decay = F.aggregate(
        decay, F.lit(0.0), lambda acc, n: acc + similarity(n["distance"]) * float(cfg.decay_pattern_points)
    )
    total = F.aggregate(
        bugs, after_decay, lambda acc, n: acc + similarity(n["distance"]) * float(cfg.bug_pattern_points)
    )
    return F.least(F.lit(100.0), total)


def similar_issues(bugs: Column, keep: int | None = 3) -> Column:
    """Bug type and severity of the ``keep`` nearest bug patterns, or of all given; missing metadata reads ``unknown``."""
    return F.transform(
        bugs if keep is None else F.slice(bugs, 1, keep),
        lambda n: F.struct(
            F.coalesce(n["bug_type"], F.lit("unknown")).alias("type"),
            F.coalesce(n["severity"], F.lit("unknown")).alias("severity"),
            F.lit("historical_bug_pattern").alias("source"),
        ),
    )


def pattern_warnings(bugs: Column) -> Column:
    return _present(
        F.when(F.size(bugs) > 0, _around(SIMILAR_BUGS, F.size(bugs))),
        F.when(F.exists(bugs, lambda n: n["severity"] == "critical"), F.lit(CRITICAL_BUG)),
    )


def decay_score(c: Column, v: Column, d: Column, p: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    """The weighted blend, not rounded. Missing signals count as 0."""
    zero = F.lit(0.0)
    return _clamp(
        F.coalesce(c, zero) * cfg.weight_complexity
        + F.coalesce(v, zero) * cfg.weight_velocity
        + F.coalesce(d, zero) * cfg.weight_dependency
        + F.coalesce(p, zero) * cfg.weight_pattern
    )


def risk_level(score: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    out = F
    for least, level in cfg.level_steps:
        out = out.when(score >= least, F.lit(level))
    return out.otherwise(F.lit(cfg.level_floor))


def is_reportable(level: Column) -> Column:
    return level.isin(*REPORTABLE_LEVELS)


def predicted_issues(trend: Column, hotspot: Column, similar: Column) -> Column:
    """Issues to expect: growth, churn, then one per similar bug pattern."""

    def issue(kind, text, probability, when):
        return F.struct(
            kind.alias("type"), text.alias("description"), F.lit(probability).alias("probability"),
            F.lit(when).alias("timeframe"),
        )

    def fixed(values):
        return issue(F.lit(values[0]), F.lit(values[1]), values[2], values[3])

    own = _present(
        F.when(trend == "increasing", fixed(GROWTH_ISSUE)), F.when(hotspot, fixed(CHURN_ISSUE))
    ).cast(f"array<{PREDICTED_ISSUE}>")
    words, probability, when = BUG_ISSUE
    bugs = F.transform(similar, lambda s: issue(s["type"], _around(words, s["type"]), probability, when)).cast(
        f"array<{PREDICTED_ISSUE}>"
    )
    return F.concat(own, F.coalesce(bugs, F.array().cast(f"array<{PREDICTED_ISSUE}>")))


def refactor_days(score: Column, gap: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    gap = F.coalesce(gap, F.lit(float(cfg.default_gap_days)))
    out = F.when((score >= cfg.refactor_now_score) & (gap < cfg.refactor_now_gap_days), F.lit(cfg.refactor_now_days))
    for least, days in cfg.refactor_steps:
        out = out.when(score >= least, F.lit(days))
    return out.otherwise(F.lit(cfg.refactor_floor_days))


def optimal_refactor_date(score: Column, gap: Column, as_of: Column, cfg: ScoreConfig = DEFAULT) -> Column:
    return as_of + F.make_dt_interval(refactor_days(score, gap, cfg))


def recommendations(
    warnings: Column, hotspot: Column, imports: Column, score: Column, cfg: ScoreConfig = DEFAULT
) -> Column:
    return F.concat(
        F.coalesce(warnings, F.array().cast("array<string>")),
        _present(
            F.when(hotspot, F.lit(SPLIT_HOTSPOT)),
            F.when(imports > cfg.trimmed_imports, F.lit(TRIM_IMPORTS)),
            F.when(score >= cfg.refactor_now_score, F.lit(REFACTOR_NOW)).when(
                score >= cfg.refactor_later_score, F.lit(REFACTOR_LATER)
            ),
        ),
    )


def stored_score(score: Column) -> Column:
    return round_half_even(score, 2)
