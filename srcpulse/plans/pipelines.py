"""From source files, commits, history and patterns to scores, gates and reports."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from srcpulse.functions import imports as imp, scoring, style
from srcpulse.functions.numbers import round_half_even
from srcpulse.operators import churn, history as hist, metrics, rollups, similarity, style as style_ops, urls, validation
from srcpulse.session import compiled_only, materialize
from srcpulse.sources import corpus, store, tree

COMPLEXITY, MAINTAINABILITY = "cyclomatic_complexity", "maintainability_index"
#: Distinct folders that URLs ask for, up to which all tasks get them and no file is shuffled once per folder above it.
BROADCAST_ROOTS = 100_000


def text_signals(
    files: DataFrame, keep: Sequence[str] = (), rules: Sequence[style.Rule] | None = None, first_imports: int | None = None,
    findings: bool = False,
) -> DataFrame:
    """Everything that comes from the text of a file, in one pass without a shuffle; the text ends here.

    With ``rules`` the small style counts per severity and category come along, with ``findings`` the findings too.
    """
    also = [imp.extract_imports(F.col("content"), F.col("ext")).alias("_imports")]
    if rules is not None:
        also.append(style.style_issues(F.col("content"), F.col("lines"), F.col("bare_lines"), F.col("ext"), rules).alias("issues"))
    rows = metrics.file_metrics(files, keep, also)
    names = F.col("_imports")
    extra = [
        F.size(names).alias("import_count"), imp.dependency_depth(names).alias("dependency_depth"),
        (names if first_imports is None else F.slice(names, 1, first_imports)).alias("imports"),
    ]
    if rules is not None:
        extra += [F.size("issues").cast("bigint").alias("issue_count"), *style_ops.severity_columns("issues")]
    left = ("_imports",) if findings else ("_imports", "issues")
    return rows.select(*[c for c in rows.columns if c not in left], *extra)


def predict_decay(signals: DataFrame, as_of: datetime, cfg: scoring.ScoreConfig = scoring.DEFAULT) -> DataFrame:
    """Score, level, issues, refactor date and recommendations; null where the file is unsupported."""
    done = F.col("status") == "completed"

    def if_done(col: Column) -> Column:
        return F.when(done, col)

    c = F.col
    cc = c(COMPLEXITY)
    mi = F.coalesce(c(MAINTAINABILITY), F.lit(100.0))
    trend = c(f"{COMPLEXITY}_trend")
    n, authors, gap = c("change_frequency"), c("authors_count"), c("avg_days_between_changes")
    risks = signals.withColumns(
        {
            "complexity_risk_score": if_done(scoring.complexity_risk(cc, trend, cfg)),
            "complexity_warnings": if_done(scoring.complexity_warnings(cc, mi, trend, cfg)),
            "churn_risk_score": if_done(scoring.churn_risk(n, authors, gap, cfg)),
            "is_hotspot": if_done(scoring.is_hotspot(n, cfg)),
            "dependency_risk_score": if_done(scoring.dependency_risk(c("import_count"), c("dependency_depth"), cfg)),
            "pattern_risk_score": if_done(scoring.pattern_risk(c("decay_neighbours"), c("bug_neighbours"), cfg)),
            "pattern_matches": if_done(F.size("decay_neighbours")),
            "bug_pattern_matches": if_done(F.size("bug_neighbours")),
            "similar_issues": if_done(scoring.similar_issues(c("bug_neighbours"))),
        }
    )
    scored = risks.withColumn(
        "_score",
        if_done(
            scoring.decay_score(
                c("complexity_risk_score"), c("churn_risk_score"), c("dependency_risk_score"), c("pattern_risk_score"), cfg
            )
        ),
    )
    score = c("_score")
    moment = F.lit(str(as_of)).cast("timestamp")
    return scored.withColumns(
        {
            "decay_score": scoring.stored_score(score),
            "risk_level": if_done(scoring.risk_level(score, cfg)),
            "confidence": if_done(F.lit(cfg.confidence)),
            "predicted_issues": if_done(scoring.predicted_issues(trend, c("is_hotspot"), c("similar_issues"))),
            "optimal_refactor_date": if_done(scoring.optimal_refactor_date(score, gap, moment, cfg)),
            "recommendations": if_done(
                scoring.recommendations(c("complexity_warnings"), c("is_hotspot"), c("import_count"), score, cfg)
            ),
            "ts": moment,
        }
    ).drop("_score", "decay_neighbours", "bug_neighbours")


def stored_signals(
    commits: DataFrame, history: DataFrame, as_of: datetime, *, days_back: int = 90, trend_order: str = "reference", trend_rows: int = 10,
    newest_is_current: bool = False, history_tie_break: Sequence[Column] = (),
) -> tuple[DataFrame, DataFrame]:
    """What a score takes from commits and history, one row per file each."""
    compiled_only(commits.sparkSession)
    return churn.change_stats(commits, as_of, days_back), hist.metric_trend(
        history, (COMPLEXITY, MAINTAINABILITY), order=trend_order, n=trend_rows, tie_break=history_tie_break, newest_is_current=newest_is_current
    )


def analyze_files(
    files: DataFrame, commits: DataFrame, history: DataFrame, neighbours: DataFrame, as_of: datetime, *,
    days_back: int = 90, trend_order: str = "reference", trend_rows: int = 10, newest_is_current: bool = False,
    history_tie_break: Sequence[Column] = (), keep: Sequence[str] = (), rules: Sequence[style.Rule] | None = None,
    findings: bool = False, cfg: scoring.ScoreConfig = scoring.DEFAULT, signals: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Score every file. ``neighbours`` is ``file_path, decay_neighbours, bug_neighbours``.

    With ``newest_is_current`` the newest history row of a file holds its measured complexity and
    maintainability of now; without it they are columns of ``files`` or estimated from the text.

    The text is read once and dropped; the four signals meet in left joins on ``file_path``, each side with
    one small row per file. Commits and history are reduced before they are shuffled. The expressions are wide, so the
    session fuses operators only as far as the JVM compiles them (``compiled_only``). ``signals`` are those of
    ``stored_signals`` with the same options, where several scans share them.
    """
    compiled_only(files.sparkSession)
    measured = (COMPLEXITY, MAINTAINABILITY)
    if newest_is_current:
        files = files.withColumns({m: F.lit(None).cast("double") for m in measured})
    text = text_signals(files, keep, rules, findings=findings)
    if newest_is_current:
        text = text.drop(*measured)
    stats, trends = signals or stored_signals(
        commits, history, as_of, days_back=days_back, trend_order=trend_order, trend_rows=trend_rows, newest_is_current=newest_is_current,
        history_tie_break=history_tie_break,
    )
    empty = F.array().cast(similarity._FOUND)
    joined = text.join(stats, "file_path", "left").join(trends, "file_path", "left").join(neighbours, "file_path", "left")
    filled = joined.withColumns(
        {
            COMPLEXITY: F.when(F.col("status") == "completed", F.coalesce(COMPLEXITY, F.lit(0.0))),
            "change_frequency": F.coalesce("change_frequency", F.lit(0).cast("bigint")),
            "authors_count": F.coalesce("authors_count", F.lit(0).cast("bigint")),
            "avg_days_between_changes": F.coalesce("avg_days_between_changes", F.lit(float(days_back))),
            **{
                f"{m}_trend": F.coalesce(f"{m}_trend", F.lit("insufficient_data")) for m in measured
            },
            "decay_neighbours": F.coalesce("decay_neighbours", empty),
            "bug_neighbours": F.coalesce("bug_neighbours", empty),
        }
    )
    return predict_decay(filled, as_of, cfg)


def _valid_files(looked_at: DataFrame, files: DataFrame, below_root: bool) -> DataFrame:
    """Files that a valid request names. Requests name their repository, so both join on it where paths lie below it."""
    keys = ["repo", "file_path"] if below_root else ["file_path"]
    asked = looked_at.filter("outcome = 'valid'").withColumnRenamed("requested_path", "file_path").select(*keys).distinct()
    return files.join(asked, keys, "left_semi")


def check_changes(
    requests: DataFrame, files: DataFrame, max_files: int | None = None, max_bytes: int = validation.MAX_BYTES,
    rules: Sequence[style.Rule] = style.DEFAULT_RULES, report_unreadable: bool = False, below_root: bool = False,
) -> DataFrame:
    """One gate row per batch of requested paths; every request counts.

    With ``max_files`` a batch of more than twice that number is refused. Text that cannot be read has no finding, or a
    ``check_error`` with ``report_unreadable``. Only files that a request names are checked.
    """
    sized = validation.batch_status(requests, max_files)
    # A short row per request, read three times below.
    looked_at = materialize(validation.validate_paths(requests, files, max_files, max_bytes, below_root=below_root), "requests")
    rejected = validation.path_counts(looked_at)
    keys = ["repo", "requested_path"] if below_root else ["requested_path"]
    valid = looked_at.filter("outcome = 'valid'").select("batch_id", *keys)
    checked = style_ops.style_check(
        _valid_files(looked_at, files, below_root), rules, report_unreadable=report_unreadable, keep=keys[:-1]
    ).select(*keys[:-1], F.col("file_path").alias("requested_path"), "issue_count", *style_ops.severity_columns())
    valid = valid.join(checked, keys)
    zero = F.lit(0).cast("bigint")
    sums = valid.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("files_checked"),
        F.count_if(F.col("issue_count") > 0).alias("files_with_issues"),
        F.sum("issue_count").alias("total_issues"),
        *[F.sum(s).alias(s) for s in style.SEVERITIES],
    )
    numbers = ("files_checked", "files_with_issues", "total_issues", *style.SEVERITIES, "paths_rejected")
    report = sized.join(rejected, "batch_id", "left").join(sums, "batch_id", "left").withColumns(
        {n: F.coalesce(n, zero) for n in numbers}
    )
    refused = F.col("batch_status") != "accepted"
    ok = (F.col("critical") == 0) & (F.col("high") == 0)
    message = (
        F.when(F.col("files_checked") == 0, F.lit(style_ops.NO_VALID_FILES)).when(ok, F.lit(style_ops.GATE_PASSED))
        .otherwise(F.lit(style_ops.GATE_FAILED))
    )
    return report.select(
        "batch_id", "batch_status", F.when(~refused, ok).alias("ok"),
        *[F.when(~refused, F.col(n)).alias(n) for n in numbers], F.when(~refused, message).alias("message"),
    )


def check_changes_issues(
    requests: DataFrame, files: DataFrame, max_files: int | None = None, max_bytes: int = validation.MAX_BYTES,
    rules: Sequence[style.Rule] = style.DEFAULT_RULES, report_unreadable: bool = False, below_root: bool = False,
) -> DataFrame:
    """The findings behind ``check_changes``: a row per batch, file and finding."""
    looked_at = materialize(validation.validate_paths(requests, files, max_files, max_bytes, below_root=below_root), "requests")
    keys = ["repo", "file_path"] if below_root else ["file_path"]
    checked = style_ops.style_check(
        _valid_files(looked_at, files, below_root), rules, report_unreadable=report_unreadable, keep=keys[:-1]
    )
    issues = style_ops.style_issue_rows(checked, keys[:-1])
    asked = looked_at.filter("outcome = 'valid'").withColumnRenamed("requested_path", "file_path").select("batch_id", *keys)
    return asked.join(issues, keys)


REPORT_COLUMNS = (
    "repo", "file_path", "status", "decay_score", "risk_level", "predicted_issues", "recommendations", "issue_count",
    *style.SEVERITIES, *style.CATEGORIES,
)


def repo_report(
    analysed: DataFrame, listing: DataFrame, max_files: int | None = None, focus: Column | None = None, below_root: bool = False,
    top_files: int | None = 15, top_types: int | None = 20,
) -> DataFrame:
    """One row per repository from ``analyze_files(..., keep=["repo"], rules=...)``; no history is stored.

    Give it the files of the report only: ``corpus.analyzable`` and, for a limit, ``rollups.select_bounded`` cut the
    source files before they are analysed. ``max_files`` here is for rows that are analysed anyway.

    Four rollups read the per-file rows, so these are written once to the shared folder: the texts are read
    and checked once, and a lost executor does not bring that work back.
    """
    focus_column = [] if focus is None else [focus.alias("_focus")]
    rows = materialize(analysed.select(*REPORT_COLUMNS, *focus_column), "report")
    lead = F.col("_focus") if focus_column else None
    selected = rollups.select_bounded(rows, max_files, lead)
    return rollups.repo_report(selected, rollups.skipped_counts(rows, max_files), listing, top_files, top_types, below_root)


def project_scan(
    spark: SparkSession, root: str, commits: DataFrame, history: DataFrame, neighbours: DataFrame, as_of: datetime,
    metrics_path: str, predictions_path: str, extensions: Sequence[str] = corpus.PROJECT_EXTENSIONS,
    max_bytes: int = corpus.MAX_BYTES, run_id: str | None = None, **options,
) -> DataFrame:
    """Scan a folder tree, score it and store the completed rows; an unreadable or oversized file is a row, never a failed job.

    With a ``run_id`` the rows are stored once however often the scan is repeated or breaks off. Commits and measurements of
    paths that the scan leaves out are dropped before they are counted or sorted.
    """
    files = tree.scan_tree(spark, root, extensions, max_bytes)
    scanned = tree.scanned_path(root, extensions)
    return store.persist_completed(
        analyze_files(files, commits.where(scanned), history.where(scanned), neighbours, as_of, **options), metrics_path, predictions_path, run_id
    )


def url_reports(
    targets: DataFrame, listing: DataFrame, scored: DataFrame, extensions: Sequence[str] = corpus.REPOSITORY_EXTENSIONS,
    skip_dirs: Sequence[str] = corpus.REPOSITORY_SKIP,
) -> DataFrame:
    """One row per URL: what it points at, and the files below that with their score, a focus file first.

    ``targets(repo, path_in_repo, is_raw_file, ...)`` as from ``classify_source_urls``, ``listing(repo, file_path)`` and
    ``scored(repo, file_path, decay_score, risk_level)`` with paths below the repository. Folders that are left out count
    below the walk root only. Each distinct (repository, walk root) is answered once: a file is looked up by the folders above
    it, so the listing is read once however many URLs there are, and only folders that someone asks for go on.

    Folders and focus files both look at the scores, so these are written once to the shared folder: what they come from is analysed once.
    """
    placed = materialize(urls.focus_or_walk(targets, listing), "targets")
    scored = materialize(scored.select("repo", "file_path", "decay_score", "risk_level"), "scores")
    asked = materialize(placed.select("repo", F.coalesce("walk_root", F.lit("")).alias("root")).distinct(), "roots")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROOTS else asked
    path, parts = F.col("file_path"), F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    named = scored.where(corpus.analyzable(path, F.lit(0), extensions, skip_dirs=()))
    # Many roots of one repository meet many of its files: the folders that are asked for are few beside the files.
    within = named.withColumn("root", F.explode(above)).join(asked, ["repo", "root"])
    below = F.when(F.col("root") == "", path).otherwise(F.expr("substring(file_path, length(root) + 2)"))
    left_out = "|".join([*map(re.escape, skip_dirs), r"\.[^/]*"])
    within = within.where(~below.rlike(f"(?:^|/)(?:{left_out})/"))
    score = F.coalesce("decay_score", F.lit(0.0)).cast("decimal(20,10)")
    risky = F.coalesce(scoring.is_reportable(F.col("risk_level")), F.lit(False))
    sums = within.groupBy("repo", "root").agg(
        F.count(F.lit(1)).alias("n"), F.sum(score).alias("total"), F.count_if(risky).alias("risky"), F.min("file_path").alias("first")
    )
    focus = scored.select("repo", path.alias("focus_path"), score.alias("focus_score"), risky.alias("focus_risky"), "file_path")
    inside = within.where("root = ''").select("repo", path.alias("focus_path"), F.lit(True).alias("counted"))
    wanted = placed.where("focus_path IS NOT NULL").select("repo", "focus_path").distinct()
    focus = wanted.join(focus, ["repo", "focus_path"]).join(inside, ["repo", "focus_path"], "left")
    joined = placed.withColumn("root", F.coalesce("walk_root", F.lit(""))).join(sums, ["repo", "root"], "left").join(
        focus.drop("file_path"), ["repo", "focus_path"], "left"
    )
    more = F.col("focus_score").isNotNull() & F.col("counted").isNull()  # a focus file is read whatever its suffix or folder
    n = F.coalesce("n", F.lit(0)) + more.cast("int")
    total = F.coalesce("total", F.lit(0)) + F.when(more, F.col("focus_score")).otherwise(0)
    mean = round_half_even(F.coalesce(F.try_divide(total.cast("double"), n), F.lit(0.0)))
    return joined.select(
        *targets.columns, "focus_path", "walk_root", n.alias("files_analyzed"), mean.alias("avg_decay_score"),
        (F.coalesce("risky", F.lit(0)) + F.when(more & F.col("focus_risky"), 1).otherwise(0)).alias("high_risk_count"),
        F.coalesce("focus_path", "first").alias("first_file"),
    )
