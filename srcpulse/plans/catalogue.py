"""The registered queries: every operator over the shipped tables, in a flat shape that can be compared."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from srcpulse.functions import scoring, style, text
from srcpulse.operators import churn, history as hist, metrics, model, rollups, similarity, style as so, urls, validation
from srcpulse.plans import pipelines
from srcpulse.schemas import ISSUE, NEIGHBOUR
from srcpulse.session import materialize, shared_dir
from srcpulse.sources import adapters as A, corpus, patterns as pat, store, tree
from srcpulse.streaming import churn_state, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHIP_AS_OF = datetime.fromisoformat(A.SHIP_AS_OF)
EVENTS_AS_OF = datetime.fromisoformat(A.EVENTS_AS_OF)
PREDICTION_COLUMNS = ("prediction_id", "file_path", "ts", "decay_score", "risk_level")
ISSUE_COLUMNS = ("file_path", "rule_ord", "type", "severity", "line", "message", "category")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(col: str | Column, by: str = " | ") -> Column:
    return F.array_join(col, by)


def ntz(col: str) -> Column:
    return F.col(col).cast("timestamp_ntz").alias(col)


# --- shared inputs -------------------------------------------------------------------------------
def _predictions(spark, sf):
    return A.view(A.table(spark, sf, "orders"), A.PREDICTIONS)


def _metrics(spark, sf, columns=A.METRICS):
    return A.view(A.table(spark, sf, "lineitem"), columns)


def _metrics_order():
    return [F.desc(c) for c in A.METRICS_ORDER]


def _commits(spark, sf, columns):
    return A.view(A.table(spark, sf, "lineitem"), columns)


def _event_commits(spark, sf):
    return A.view(A.table(spark, sf, "events"), A.COMMITS_EVENTS)


def _latest_tie_break():
    return [F.col("decay_score").desc(), F.col("prediction_id")]


def _neighbours(spark, sf):
    """Neighbours of each corpus file, which takes the vectors in turn: searched once per vector, then joined by vector."""
    vectors = A.table(spark, sf, "embeddings").selectExpr("vec_id AS query_id", "embedding")
    found = similarity.nearest_patterns(vectors, A.patterns(spark, sf), metric="cosine")
    turn = F.expr("p_partkey") % F.lit(vectors.count())
    files = A.table(spark, sf, "part").select(F.expr(A.corpus_path("p_partkey")).alias("file_path"), turn.alias("query_id"))
    return files.join(found, "query_id").drop("query_id")


def _report_files(files: DataFrame) -> DataFrame:
    """Source files that a repository report lists: by suffix, without folders of tools and hidden ones."""
    keep = corpus.analyzable(
        F.col("file_path"), F.lit(0), corpus.REPOSITORY_EXTENSIONS, skip_dirs=corpus.REPOSITORY_SKIP, skip_hidden=True
    )
    return files.filter(keep)


def analysed(spark, sf, rules=None, files=None, findings=False) -> DataFrame:
    """The whole score over the corpus, or over other files."""
    return pipelines.analyze_files(
        A.source_files(spark, sf) if files is None else files, _commits(spark, sf, A.COMMITS_CORPUS), _metrics(spark, sf, A.METRICS_CORPUS),
        _neighbours(spark, sf), SHIP_AS_OF, days_back=1095, newest_is_current=True, history_tie_break=_metrics_order(),
        keep=["repo"], rules=rules, findings=findings,
    )


def _issues(spark, sf):
    return so.style_issue_rows(so.style_check(A.source_files(spark, sf)))


# --- predictions ---------------------------------------------------------------------------------
@query
def high_risk_latest(spark, sf):
    return hist.high_risk_list(_predictions(spark, sf), 70).select(*PREDICTION_COLUMNS)


@query
def high_risk_report(spark, sf):
    return hist.high_risk_report(_predictions(spark, sf), 70)


@query
def high_risk_with_count(spark, sf):
    return hist.high_risk_with_count(_predictions(spark, sf), 70).select(*PREDICTION_COLUMNS, "threshold", "count")


@query
def latest_predictions(spark, sf):
    return hist.latest_predictions(_predictions(spark, sf)).select(*PREDICTION_COLUMNS)


@query
def latest_one_per_file(spark, sf):
    return hist.latest_one(_predictions(spark, sf), _latest_tie_break()).select(*PREDICTION_COLUMNS)


@query
def prediction_status(spark, sf):
    requests = A.view(A.table(spark, sf, "customer"), A.STATUS_REQUESTS)
    return hist.prediction_status(requests, _predictions(spark, sf), _latest_tie_break())


@query
def summary_reference(spark, sf):
    return hist.summary_reference(hist.latest_predictions(_predictions(spark, sf)))


@query
def risk_summary(spark, sf):
    return hist.risk_summary(hist.latest_predictions(_predictions(spark, sf)))


# --- history -------------------------------------------------------------------------------------
@query
def history_last_n(spark, sf):
    return hist.metrics_view(hist.last_n(_metrics(spark, sf), 10, _metrics_order()))


def _trend(spark, sf, order):
    return hist.metric_trend(
        _metrics(spark, sf), (pipelines.COMPLEXITY, pipelines.MAINTAINABILITY), order=order, tie_break=_metrics_order()
    )


@query
def trend_reference(spark, sf):
    return _trend(spark, sf, "reference")


@query
def trend_chronological(spark, sf):
    return _trend(spark, sf, "chronological")


@query
def current_with_trend(spark, sf):
    both = hist.metric_trend(
        _metrics(spark, sf), (pipelines.COMPLEXITY, pipelines.MAINTAINABILITY), order="reference",
        tie_break=_metrics_order(), newest_is_current=True,
    )
    cc, mi, trend = F.coalesce(pipelines.COMPLEXITY, F.lit(0.0)), F.col(pipelines.MAINTAINABILITY), F.col("complexity_trend")
    return both.withColumnRenamed("cyclomatic_complexity_trend", "complexity_trend").select(
        "file_path", cc.alias("current_complexity"), trend, scoring.complexity_risk(cc, trend).alias("complexity_risk_score"),
        joined(scoring.complexity_warnings(cc, mi, trend)).alias("complexity_warnings"),
    )


@query
def current_with_stored_trend(spark, sf):
    """Text metrics of the corpus files with the trend of their stored rows."""
    current = metrics.branch_complexity(A.source_files(spark, sf))
    trends = hist.metric_trend(
        _metrics(spark, sf, A.METRICS_CORPUS), [pipelines.MAINTAINABILITY], order="chronological", tie_break=_metrics_order()
    )
    return hist.current_with_history(current, trends)


# --- churn ---------------------------------------------------------------------------------------
def _stats_supp(spark, sf):
    return churn.change_stats(_commits(spark, sf, A.COMMITS_SUPP), SHIP_AS_OF, 90)


@query
def commit_gaps(spark, sf):
    recent = churn.in_window(_commits(spark, sf, A.COMMITS_SUPP), SHIP_AS_OF, 90)
    return churn.commit_gaps(recent).select("file_path", "day", "commits", "gap_days")


@query
def change_stats_90d(spark, sf):
    return _stats_supp(spark, sf)


@query
def change_stats_all_files(spark, sf):
    stats = churn.change_stats(_commits(spark, sf, A.COMMITS_CORPUS), SHIP_AS_OF, 90)
    return churn.with_missing_files(stats, A.source_files(spark, sf, A.CORPUS[:3]), 90)


@query
def change_stats_events(spark, sf):
    return churn.change_stats(_event_commits(spark, sf), EVENTS_AS_OF, 90)


@query
def churn_risk(spark, sf):
    return churn.with_churn_risk(_stats_supp(spark, sf)).select(
        "file_path", "churn_risk_score", joined("churn_warnings").alias("churn_warnings")
    )


@query
def hotspots(spark, sf):
    return churn.with_churn_risk(_stats_supp(spark, sf)).filter("is_hotspot").select("file_path", "change_frequency")


@query
def recent_changed_paths(spark, sf):
    return churn.recent_changed_paths(_commits(spark, sf, A.COMMITS_PART), SHIP_AS_OF, 30)


# --- text ----------------------------------------------------------------------------------------
@query
def support_status(spark, sf):
    return metrics.with_support(A.source_files(spark, sf, A.CORPUS_WITH_GAPS)).select("file_path", "reason", "status")


@query
def line_profile(spark, sf):
    return metrics.line_profile(A.source_files(spark, sf))


@query
def line_profile_docs(spark, sf):
    return metrics.line_profile(A.documents(spark, sf).withColumnRenamed("text", "content"), ["doc_id"])


@query
def branch_complexity(spark, sf):
    return metrics.branch_complexity(A.source_files(spark, sf))


@query
def branch_complexity_lexed(spark, sf):
    return metrics.with_lexed(A.source_files(spark, sf, A.TEXT_CORPUS)).select("file_path", "cyclomatic_complexity")


@query
def token_classes(spark, sf):
    found = metrics.token_classes(A.source_files(spark, sf, A.TEXT_CORPUS))
    return found.withColumn("volume", F.round("volume", 6))


@query
def maintainability(spark, sf):
    return metrics.file_metrics(A.source_files(spark, sf)).drop("reason")


@query
def import_stats(spark, sf):
    return metrics.import_stats(A.source_files(spark, sf)).withColumn("imports", joined("imports", ","))


@query
def dependency_risk(spark, sf):
    return metrics.with_dependency_risk(metrics.import_stats(A.source_files(spark, sf))).select(
        "file_path", "dependency_risk_score", joined("dependency_warnings").alias("dependency_warnings")
    )


@query
def code_sample(spark, sf):
    sampled = A.documents(spark, sf).select("doc_id", text.code_sample(F.col("text")).alias("s"))
    return sampled.select("doc_id", F.md5("s").alias("sample_md5"), F.length("s").alias("sample_length"))


@query
def code_sample_first10(spark, sf):
    sampled = A.documents(spark, sf).select("doc_id", text.code_sample(F.col("text"), 10).alias("s"))
    return sampled.select("doc_id", F.md5("s").alias("sample_md5"), F.length("s").alias("sample_length"))


@query
def short_path(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", text.short_path(F.col("url"), 30).alias("short_url"))


# --- style ---------------------------------------------------------------------------------------
@query
def style_issues(spark, sf):
    return _issues(spark, sf).select(*ISSUE_COLUMNS)


@query
def style_risk(spark, sf):
    return so.style_check(A.source_files(spark, sf)).select("file_path", "issue_count", "style_risk_score")


@query
def style_issues_top25(spark, sf):
    first = so.issues_per_file(so.style_check(A.source_files(spark, sf)), 25)
    rows = first.select("file_path", F.posexplode_outer("style_issues").alias("p", "i"), "issue_count")
    return rows.filter("i IS NOT NULL").select(
        "file_path", (F.col("p") + 1).alias("issue_no"), "i.type", "i.line", F.col("issue_count").alias("style_issue_count")
    )


@query
def style_warnings_top10(spark, sf):
    return so.style_check(A.source_files(spark, sf)).select("file_path", joined("style_warnings").alias("style_warnings"))


def _documents(spark, sf):
    return A.documents(spark, sf).selectExpr("doc_id", "concat('doc/', doc_id) AS file_path", "text AS content")


def _document_issues(spark, sf, rules):
    checked = so.style_check(_documents(spark, sf), rules, extensions=None, keep=["doc_id"])
    return so.style_issue_rows(checked, ["doc_id"])


@query
def duplicate_lines_docs(spark, sf):
    return _document_issues(spark, sf, style.rules_of("duplicate_lines")).select("doc_id", "line")


@query
def magic_numbers_docs(spark, sf):
    return _document_issues(spark, sf, style.rules_of("magic_numbers")).select("doc_id")


@query
def user_rule_docs(spark, sf):
    rule = style.regex_rule(
        "token_in_text", r'(?U)token\s*=\s*"[0-9a-f]{40}"', "critical", style.BUG_PRONE, "A token is part of the text."
    )
    return _document_issues(spark, sf, [rule]).select("doc_id", "line", "type", "severity")


@query
def gate_report(spark, sf):
    return so.gate_report(so.style_check(A.source_files(spark, sf)))


@query
def severity_counts(spark, sf):
    return so.severity_counts(_issues(spark, sf))


@query
def style_rollup(spark, sf):
    return so.style_rollup(_issues(spark, sf))


@query
def check_errors(spark, sf):
    return so.gate_report(so.style_check(A.source_files(spark, sf, A.CORPUS_WITH_GAPS), report_unreadable=True))


# --- change sets and paths -----------------------------------------------------------------------
@query
def change_set(spark, sf):
    return validation.change_set(A.source_files(spark, sf, A.CHANGE_STATUS))


def _path_inputs(spark, sf):
    part = A.table(spark, sf, "part")
    return A.view(part, A.PATH_REQUESTS), A.view(part, A.SIZED_FILES)


@query
def paths_in_repo(spark, sf):
    requests, files = _path_inputs(spark, sf)
    known = validation.paths_in_repo(requests, files).withColumn("known", F.lit(True))
    unknown = validation.paths_not_in_repo(requests, files).withColumn("known", F.lit(False))
    return known.unionByName(unknown).select("batch_id", "requested_path", "known")


@query
def validate_paths(spark, sf):
    return validation.validate_paths(*_path_inputs(spark, sf))


@query
def validate_paths_first60(spark, sf):
    """What a batch of at most 60 files looks at."""
    return validation.validate_paths(*_path_inputs(spark, sf), max_files=60)


@query
def path_counts(spark, sf):
    return validation.path_counts(validation.validate_paths(*_path_inputs(spark, sf)))


@query
def validate_repos(spark, sf):
    requests = A.source_files(spark, sf, A.REPO_REQUESTS)
    return validation.validate_repos(requests, A.source_files(spark, sf, A.CORPUS[1:2])).select(
        "request_id", F.length("repo_path").alias("path_length").cast("bigint"), "repo_status"
    )


@query
def check_changes(spark, sf):
    requests, sizes = _path_inputs(spark, sf)
    files = A.source_files(spark, sf, (*A.CORPUS_WITH_GAPS, A.SIZED_FILES[1]))
    return pipelines.check_changes(requests, files)


@query
def check_changes_issues(spark, sf):
    requests, sizes = _path_inputs(spark, sf)
    files = A.source_files(spark, sf, (*A.CORPUS_WITH_GAPS, A.SIZED_FILES[1]))
    return pipelines.check_changes_issues(requests, files).select("batch_id", *ISSUE_COLUMNS)


# --- similarity ----------------------------------------------------------------------------------
def _knn_rows(found):
    return similarity.neighbour_rows(found).withColumn("distance", F.round("distance", 6))


@query
def knn_patterns(spark, sf):
    return _knn_rows(similarity.nearest_patterns(A.query_vectors(spark, sf), A.patterns(spark, sf), metric="cosine"))


@query
def knn_patterns_cells(spark, sf):
    return _knn_rows(
        similarity.nearest_patterns(
            A.query_vectors(spark, sf), A.patterns(spark, sf), metric="cosine", max_broadcast_bytes=0, large="cells"
        )
    )


@query
def knn_patterns_codes(spark, sf):
    return _knn_rows(
        similarity.nearest_patterns(A.query_vectors(spark, sf), A.patterns(spark, sf), metric="cosine", max_broadcast_bytes=0)
    )


@query
def knn_patterns_squared_codes(spark, sf):
    return _knn_rows(similarity.nearest_patterns(A.query_vectors(spark, sf), A.patterns(spark, sf), metric="l2", max_broadcast_bytes=0))


@query
def knn_patterns_squared(spark, sf):
    return _knn_rows(similarity.nearest_patterns(A.query_vectors(spark, sf), A.patterns(spark, sf), metric="l2"))


@query
def pattern_risk(spark, sf):
    found = similarity.nearest_patterns(A.query_vectors(spark, sf), A.patterns(spark, sf), metric="cosine")
    return similarity.with_pattern_risk(found).select(
        "query_id", F.round("pattern_risk_score", 6).alias("pattern_risk_score"),
        joined(F.transform("similar_issues", lambda s: F.concat_ws("/", s["type"], s["severity"])), ",").alias("similar_issues"),
        joined("pattern_warnings").alias("pattern_warnings"),
    )


# --- the whole score -----------------------------------------------------------------------------
@query
def decay_scores(spark, sf):
    return analysed(spark, sf).select(
        "file_path", "status", "complexity_risk_score", "churn_risk_score", "dependency_risk_score",
        F.round("pattern_risk_score", 6).alias("pattern_risk_score"), "decay_score", "risk_level", "confidence",
        ntz("optimal_refactor_date"),
    )


@query
def decay_scores_text(spark, sf):
    """The whole score from the texts as they are now, with all stored rows as the past."""
    files = metrics.with_lexed(A.source_files(spark, sf, A.TEXT_CORPUS))
    scored = pipelines.analyze_files(
        files, _commits(spark, sf, A.COMMITS_CORPUS), _metrics(spark, sf, A.METRICS_CORPUS), _neighbours(spark, sf), SHIP_AS_OF,
        days_back=1095, history_tie_break=_metrics_order(),
    )
    return scored.select(
        "file_path", "status", "cyclomatic_complexity", "complexity_risk_score", "churn_risk_score", "dependency_risk_score", "decay_score", "risk_level",
    )


@query
def decay_recommendations(spark, sf):
    return analysed(spark, sf).filter("status = 'completed'").select(
        "file_path", joined("recommendations").alias("recommendations")
    )


@query
def dashboard_cards(spark, sf):
    done = analysed(spark, sf).filter("status = 'completed'")
    return hist.dashboard_cards(done, 40).withColumn("recommendations", joined("recommendations"))


@query
def predicted_issues(spark, sf):
    return analysed(spark, sf).select("file_path", F.explode_outer("predicted_issues").alias("i")).filter("i IS NOT NULL").select(
        "file_path", "i.*"
    )


@query
def top_predicted_types(spark, sf):
    return rollups.top_predicted_types(analysed(spark, sf), 20)


@query
def avg_decay(spark, sf):
    return rollups.avg_decay(analysed(spark, sf))


@query
def top_risky_files(spark, sf):
    return hist.top_n_risky(analysed(spark, sf)).select("repo", "risk_rank", "file_path", "decay_score", "risk_level")


@query
def top_risky_predictions(spark, sf):
    stored = A.view(A.table(spark, sf, "orders"), (*A.PREDICTIONS, A.PREDICTION_GROUP))
    newest = hist.latest_one(stored, _latest_tie_break())
    return hist.top_n_risky(newest).select("repo", "risk_rank", "file_path", "decay_score", "risk_level")


@query
def decay_features(spark, sf):
    return model.decay_features(analysed(spark, sf).filter("status = 'completed'"))


@query
def rf_train_score(spark, sf):
    """Train on the features of the whole corpus with the score as target, save, load, and score the same files.

    A forest's trees are its library's own; what must hold of any is returned: predictions lie in the range of the
    targets, and their squared error is below that of the mean.
    """
    done = analysed(spark, sf).filter("status = 'completed'").withColumn("target", F.col("decay_score"))
    features = materialize(model.decay_features(done, keep=("file_path", "target")), "features")
    path = shared_dir(spark, "forest")
    model.save_model(model.train_decay_model(features), path)
    scored = model.score_decay(model.load_or_train(path, features), features).select("file_path", "target", "prediction")
    low, high, mean = features.agg(F.min("target"), F.max("target"), F.avg("target")).first()
    squared = lambda by: F.sum((by - F.col("target")) ** 2)
    own, of_mean = scored.agg(squared(F.col("prediction")), squared(F.lit(mean))).first()
    inside = F.col("prediction").between(low - 1e-9, high + 1e-9)
    return scored.select("file_path", "target", inside.alias("in_range"), F.lit(own < of_mean).alias("beats_mean"))


@query
def rf_out_of_fold(spark, sf):
    """Each file by a forest that has not seen its fold: range, error against the mean's on the fold, and the same prediction
    by a forest before it is saved and after it is loaded."""
    done = analysed(spark, sf).filter("status = 'completed'").withColumn("target", F.col("decay_score"))
    features = materialize(model.with_folds(model.decay_features(done, keep=("file_path", "target"))), "features")
    predicted = materialize(model.out_of_fold(features, trees=20), "folds")
    errors = model.fold_errors(predicted).select("fold", (F.col("error") < F.col("error_of_mean")).alias("beats_mean"))
    path = shared_dir(spark, "forest")
    forest = model.train_decay_model(features, trees=20)
    model.save_model(forest, path)
    once = model.score_decay(forest, features).select("file_path", F.col("prediction").alias("before"))
    again = model.score_decay(model.load_model(path), features).select("file_path", F.col("prediction").alias("after"))
    same = once.join(again, "file_path").select("file_path", (F.col("before") == F.col("after")).alias("same_after_load"))
    low, high = features.agg(F.min("target"), F.max("target")).first()
    inside = F.col("prediction").between(low - 1e-9, high + 1e-9).alias("in_range")
    return predicted.join(F.broadcast(errors), "fold").join(same, "file_path").select("file_path", "fold", "target", inside, "beats_mean", "same_after_load")


# --- repositories --------------------------------------------------------------------------------
@query
def repo_hygiene(spark, sf):
    return rollups.repo_hygiene(A.repo_listing(spark, sf))


def _report(spark, sf):
    files = _report_files(A.source_files(spark, sf))
    return pipelines.repo_report(analysed(spark, sf, style.DEFAULT_RULES, files), A.repo_listing(spark, sf))


@query
def shareability(spark, sf):
    return _report(spark, sf).select("repo", joined("shareability_recommendations").alias("suggestions"))


@query
def repo_report(spark, sf):
    report = _report(spark, sf)
    kinds = F.transform("predicted_issue_types", lambda k: F.concat_ws("=", k["type"], k["n"].cast("string")))
    flat = {"shareability_recommendations": "suggestions", "predicted_issue_types": "predicted_issue_types"}
    return report.select(
        *[c for c in report.columns if c not in flat and c != "highest_risk_files"],
        F.coalesce(joined(F.col("highest_risk_files.file_path"), ","), F.lit("")).alias("highest_risk_files"),
        joined("shareability_recommendations").alias("suggestions"),
        F.coalesce(joined(kinds, ","), F.lit("")).alias("predicted_issue_types"),
    )


@query
def repo_report_lists(spark, sf):
    """The lists of a report without a limit."""
    files = _report_files(A.source_files(spark, sf))
    scored = analysed(spark, sf, style.DEFAULT_RULES, files)
    report = pipelines.repo_report(scored, A.repo_listing(spark, sf), top_files=None, top_types=None)
    kinds = F.transform("predicted_issue_types", lambda k: F.concat_ws("=", k["type"], k["n"].cast("string")))
    return report.select(
        "repo", F.coalesce(joined(F.col("highest_risk_files.file_path"), ","), F.lit("")).alias("highest_risk_files"),
        F.coalesce(joined(F.array_sort(kinds), ","), F.lit("")).alias("predicted_issue_types"),
    )


@query
def repo_file_results(spark, sf):
    """Every file of a report with its status, expected issues, recommendations and findings."""
    files = _report_files(A.source_files(spark, sf))
    scored = analysed(spark, sf, style.DEFAULT_RULES, files, findings=True)
    found = F.transform(F.coalesce("issues", F.array().cast(f"array<{ISSUE}>")), lambda i: F.concat_ws(":", i["type"], i["line"]))
    return scored.select(
        "repo", "file_path", "status", "decay_score", "risk_level", joined(F.col("predicted_issues.type"), ",").alias("predicted_issue_types"),
        joined("recommendations").alias("recommendations"), F.col("issue_count").alias("style_issue_count"), joined(found, ",").alias("findings"),
    )


@query
def select_bounded(spark, sf):
    files = A.source_files(spark, sf, A.CORPUS[:3])
    kept = rollups.select_bounded(files, 60, F.col("file_id") % 50 == 7).select("repo", "file_path")
    return kept.join(rollups.skipped_counts(files, 60), "repo")


# --- URLs, catalogue, scans ----------------------------------------------------------------------
@query
def source_urls(spark, sf):
    return urls.classify_source_urls(A.source_urls(spark, sf))


@query
def source_url_triage(spark, sf):
    return urls.reason_counts(urls.classify_source_urls(A.source_urls(spark, sf)))


@query
def url_targets(spark, sf):
    listing = A.source_files(spark, sf, A.LISTING[:1]).withColumn("repo", F.lit("mono"))
    found = urls.focus_or_walk(A.source_files(spark, sf, A.URL_TARGETS), listing)
    return found.select("url_id", "path_in_repo", "focus_path", "walk_root")


@query
def url_reports(spark, sf):
    """From URLs to a report of each: the folder or file that it names, and the scores of what lies below."""
    listing = A.source_files(spark, sf, A.LISTING[:1]).withColumn("repo", F.lit("mono"))
    scores = analysed(spark, sf).select(F.col("file_path").alias("corpus_path"), "decay_score", "risk_level")
    paths = A.source_files(spark, sf, (A.LISTING[0], (A.CORPUS[2][0], "corpus_path")))
    scored = paths.join(scores, "corpus_path").withColumn("repo", F.lit("mono")).drop("corpus_path")
    return pipelines.url_reports(A.source_files(spark, sf, A.URL_TARGETS), listing, scored).drop("repo", "is_raw_file")


@query
def pattern_catalogue(spark, sf):
    """The seeds, then the patterns of the embeddings table twice: ids that are there are not added again."""
    reviewed = F.when(F.expr("label >= 2 AND vec_id % 3 = 0"), F.create_map(F.lit("severity"), F.lit("reviewed")))
    added = A.view(
        A.table(spark, sf, "embeddings"), (*A.PATTERNS, ("vec_id", "vec_id"), ("label", "label"))
    ).select("collection", "pattern_id", "embedding", "bug_type", "severity", reviewed.alias("meta"), F.lit("").alias("text"))
    once = pat.with_patterns(pat.seed_patterns(spark), added)
    full = pat.with_patterns(once, added.unionByName(added))
    return full.select("collection", "pattern_id", "bug_type", "severity", F.col("meta")["severity"].alias("meta_severity"))


@query
def corpus_scan(spark, sf):
    keep = corpus.analyzable(F.col("file_path"), F.col("size_bytes"))
    return A.source_files(spark, sf, A.LISTING).filter(keep)


@query
def corpus_scan_repository(spark, sf):
    keep = corpus.analyzable(
        F.col("file_path"), F.col("size_bytes"), corpus.REPOSITORY_EXTENSIONS, skip_dirs=corpus.REPOSITORY_SKIP,
        skip_hidden=True, walk_root="src",
    )
    return A.source_files(spark, sf, A.LISTING).filter(keep)


@query
def tree_scan(spark, sf):
    """The texts of the corpus as files in a tree, read back under both lists of folders that are left out."""
    root = shared_dir(spark, "tree")
    tree.write_tree(A.source_files(spark, sf, A.TREE_FILES), root)
    project = tree.read_tree(spark, root, max_bytes=A.TREE_MAX_BYTES)
    repository = tree.read_tree(
        spark, root, corpus.REPOSITORY_EXTENSIONS, A.TREE_MAX_BYTES, corpus.REPOSITORY_SKIP, skip_hidden=True, walk_root="src"
    )
    both = project.withColumn("scan", F.lit("project")).unionByName(repository.withColumn("scan", F.lit("repository")))
    return both.select("scan", "file_path", "size_bytes", "reason", F.md5("content").alias("content_md5"))


# --- stores --------------------------------------------------------------------------------------
def _stored(spark, sf):
    base = shared_dir(spark, "store")
    store.persist_completed(analysed(spark, sf), f"{base}/metrics", f"{base}/predictions")
    return base


@query
def metrics_append(spark, sf):
    stored = store.read_metrics(spark, f"{_stored(spark, sf)}/metrics")
    return stored.select(
        "file_path", ntz("ts"), "cyclomatic_complexity", "change_frequency", "authors_count", "import_count", "dependency_depth"
    )


@query
def predictions_append(spark, sf):
    stored = store.read_predictions(spark, f"{_stored(spark, sf)}/predictions")
    return stored.select("file_path", ntz("ts"), "decay_score", "risk_level", "confidence")


@query
def project_scan_runs(spark, sf):
    """Scans of a tree in runs: one is repeated, one breaks off and is done again, one breaks off for good."""
    base = shared_dir(spark, "project")
    tree.write_tree(A.source_files(spark, sf, A.TREE_FILES), f"{base}/mono")
    paths = {"metrics": f"{base}/metrics", "predictions": f"{base}/predictions"}
    none = spark.range(0).select(F.lit("").alias("file_path"), *[F.array().cast(f"array<{NEIGHBOUR}>").alias(n) for n in ("decay_neighbours", "bug_neighbours")])
    options = {"days_back": 1095, "newest_is_current": True, "history_tie_break": _metrics_order()}
    scanned = tree.scanned_path(f"{base}/mono")
    commits, history = (d.where(scanned) for d in (_commits(spark, sf, A.COMMITS_TREE), _metrics(spark, sf, A.METRICS_TREE)))
    # All runs look at the same commits and history, which are counted once.
    signals = tuple(materialize(s, "signals") for s in pipelines.stored_signals(commits, history, SHIP_AS_OF, **options))

    def scan(run_id):
        return pipelines.project_scan(
            spark, f"{base}/mono", commits, history, none, SHIP_AS_OF, paths["metrics"], paths["predictions"], max_bytes=A.TREE_MAX_BYTES, run_id=run_id,
            signals=signals, **options,
        )

    scan("nightly-1")
    whole = scan("nightly-1")
    part = store.read_metrics(spark, paths["metrics"]).limit(50)
    for run_id in ("nightly-2", "nightly-3"):  # some rows of one table are written, and no run is finished
        store.stage(part.drop("ts_date"), paths["metrics"], run_id)
    scan("nightly-2")
    stored = [
        store.read_metrics(spark, paths["metrics"]).groupBy("file_path").agg(F.count("*").alias("copies"), F.max("change_frequency").cast("bigint").alias("commits"))
        .withColumn("stored", F.lit("metrics")),
        store.read_predictions(spark, paths["predictions"]).groupBy("file_path").agg(F.count("*").alias("copies"), F.lit(None).cast("bigint").alias("commits"))
        .withColumn("stored", F.lit("predictions")),
        whole.where("status <> 'completed'").select("file_path", F.lit(0).cast("bigint").alias("copies"), F.lit(None).cast("bigint").alias("commits"), F.col("reason").alias("stored")),
    ]
    return stored[0].unionByName(stored[1]).unionByName(stored[2])


@query
def commit_log_rejects(spark, sf):
    """Exports of a commit log with broken lines: the lines per reason, and the files and days of the good ones."""
    base, lines = shared_dir(spark, "log"), A.table(spark, sf, "lineitem")
    out = None
    for kind, line in (("csv", A.CSV_LINE), ("json", A.JSON_LINE)):
        lines.selectExpr(f"{line} AS value").write.text(f"{base}/{kind}")
        checked = store.checked_commits(spark, f"{base}/{kind}", kind)
        good = store.good_commits(checked)
        numbers = good.agg(F.count_distinct("file_path").alias("files"), F.count_distinct("ts").alias("days"))
        counts = store.reject_counts(checked).withColumn("export", F.lit(kind)).join(
            numbers.withColumn("reason", F.lit("accepted")), "reason", "left"
        )
        out = counts if out is None else out.unionByName(counts)
    return out


# --- streams -------------------------------------------------------------------------------------
def _drain(spark, rows, name):
    base = shared_dir(spark, name)
    live.start_table(rows, f"{base}/table", f"{base}/checkpoint", available_now=True).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/table")


@query
def stream_churn(spark, sf):
    commits = A.view(A.table_stream(spark, sf, "events"), A.COMMITS_EVENTS)
    commits = live.closed(commits, shared_dir(spark, "stream-end"))
    done = _drain(spark, live.windowed_churn(commits), "stream-churn")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def _sliding_churn(spark, commits, days_back, slide_days):
    commits = live.closed(commits, shared_dir(spark, "stream-end"))
    with churn_state.keyed_state(spark):
        done = _drain(spark, churn_state.sliding_churn(commits, days_back, slide_days), "stream-churn-risk")
    done = done.withColumn("churn_warnings", joined("churn_warnings"))
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_end", "last_modified", "latest_change")})


@query
def stream_churn_risk(spark, sf):
    """Gap, risk and hotspots of the commits to each file over windows of 90 days that end every 30 days."""
    return _sliding_churn(spark, A.view(A.table_stream(spark, sf, "lineitem"), A.COMMITS_SUPP), 90, 30)


@query
def stream_churn_risk_events(spark, sf):
    """The same over commits at any time of the day, in windows of a week that end every three days."""
    return _sliding_churn(spark, A.view(A.table_stream(spark, sf, "events"), A.COMMITS_EVENTS), 7, 3)


@query
def stream_progress(spark, sf):
    events = A.table_stream(spark, sf, "events").select("ts", F.col("event_type").alias("step"))
    events = live.closed(events, shared_dir(spark, "stream-end"))
    done = _drain(spark, live.progress_counts(events), "stream-progress")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query
def stream_latest(spark, sf):
    base = shared_dir(spark, "stream-latest")
    rows = A.view(A.table_stream(spark, sf, "orders"), A.PREDICTIONS)
    live.start_latest(rows, f"{base}/table", f"{base}/checkpoint", available_now=True).awaitTermination()
    return live.read_latest(spark, f"{base}/table").select(*PREDICTION_COLUMNS)


@query
def stream_latest_upsert(spark, sf):
    """The same in eight batches that arrive out of order, then all of them once more through another query."""
    base = shared_dir(spark, "stream-upsert")
    rows = A.view(A.table(spark, sf, "orders"), A.PREDICTIONS)
    rows.repartition(8, "prediction_id").write.parquet(f"{base}/in")
    for name in ("first", "again"):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        live.start_latest(stream, f"{base}/table", f"{base}/{name}", available_now=True, buckets=16).awaitTermination()
    return live.read_latest(spark, f"{base}/table").distinct().select(*PREDICTION_COLUMNS)


@query
def stream_style_gate(spark, sf):
    base = shared_dir(spark, "stream-gate")
    files = A.view(A.spread_stream(A.table_stream(spark, sf, "part")), A.CORPUS)
    live.start_style_gate(files, f"{base}/table", f"{base}/checkpoint", available_now=True).awaitTermination()
    return live.read_gate(spark, f"{base}/table")
