"""Text metrics and imports of a corpus. Every operator is narrow: one scan, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from srcpulse.functions import imports as imp, lexed, scoring, text
from srcpulse.operators.style import with_lines

UNSUPPORTED = "unsupported_file"


def with_support(files: DataFrame, extensions=text.SUPPORTED_EXTENSIONS) -> DataFrame:
    """Adds ``status`` and ``reason``: a wrong extension and an unreadable text are both unsupported.

    A ``reason`` that a scan has given already, such as ``oversized``, stays."""
    ext = text.extension(F.col("file_path"))
    given = F.col("reason") if "reason" in files.columns else F.lit(None).cast("string")
    reason = F.when(~ext.isin(*extensions), F.lit("extension")).when(F.col("content").isNull(), F.lit("unreadable"))
    return files.withColumn("reason", F.coalesce(given, reason)).withColumn(
        "status", F.when(F.col("reason").isNotNull(), F.lit(UNSUPPORTED)).otherwise(F.lit("supported"))
    )


def line_profile(files: DataFrame, keys=("file_path",)) -> DataFrame:
    """Line, non-blank and comment line counts and the comment ratio of each text."""
    lines = files.withColumn("lines", text.split_lines(F.col("content")))
    bare = lines.select(*keys, text.strip_lines(F.col("lines"), F.col("content")).alias("bare"))
    counted = bare.select(*keys, text.line_counts(F.col("bare")).alias("c")).select(*keys, "c.*")
    return counted.withColumn("comment_ratio", text.ratio3(F.col("comment_lines"), F.col("line_count")))


def branch_complexity(files: DataFrame) -> DataFrame:
    """Mean complexity of the functions of each Python file, 0 for other languages."""
    ext = text.extension(F.col("file_path"))
    value = F.when(ext == ".py", text.mean_block_complexity(text.universal_newlines(F.col("content")))).otherwise(F.lit(0.0))
    return files.select("file_path", value.alias("cyclomatic_complexity"))


def token_classes(files: DataFrame, keep=()) -> DataFrame:
    """Operators and operands of each Python text, all and distinct, and their volume; other files have none."""
    ext = text.extension(F.col("file_path"))
    found = files.where(ext == ".py").select("file_path", *keep, lexed.token_classes(text.universal_newlines(F.col("content"))).alias("t"))
    return found.select("file_path", *keep, "t.*").withColumn("volume", text.token_volume(
        F.col("operators") + F.col("operands"), F.col("distinct_operators") + F.col("distinct_operands")
    ))


def with_lexed(files: DataFrame) -> DataFrame:
    """Adds ``cyclomatic_complexity`` and ``maintainability_index`` from the tokens of each Python text; 0 for other languages.

    ``file_metrics`` and ``analyze_files`` take these columns as they are, so a score comes from what the text says now.
    """
    python, content = text.extension(F.col("file_path")) == ".py", text.universal_newlines(F.col("content"))
    lines = text.split_lines(content)
    counted = files.withColumn(
        "_l", F.when(python, F.struct(
            lexed.block_complexity(content).alias("cc"), lexed.token_classes(content).alias("t"),
            text.line_counts(text.strip_lines(lines, content)).alias("c"),
        ))
    )
    index = text.maintainability_index(
        F.col("_l.t.operators") + F.col("_l.t.operands"), F.col("_l.t.distinct_operators") + F.col("_l.t.distinct_operands"),
        F.col("_l.cc"), F.col("_l.c.line_count"), F.col("_l.c.comment_lines"),
    )
    return counted.withColumns({
        "cyclomatic_complexity": F.when(python, F.col("_l.cc")).otherwise(F.lit(0.0)),
        "maintainability_index": F.when(python, index).otherwise(F.lit(0.0)),
    }).drop("_l")


def file_metrics(files: DataFrame, keep=(), also=()) -> DataFrame:
    """Lines, complexity, maintainability and comment ratio of each supported file.

    Columns ``cyclomatic_complexity`` and ``maintainability_index`` that the input already has are used as
    they are. Lines of code are all lines of a Python file and the non-blank lines of any other. ``also`` are
    further columns of the same pass, over ``content``, ``lines`` and ``ext``.
    """
    given = set(files.columns)
    base = with_lines(with_support(files))
    counted = base.withColumn("_c", text.line_counts(F.col("bare_lines")))
    python = F.col("ext") == ".py"
    supported = F.col("status") != UNSUPPORTED
    if "cyclomatic_complexity" not in given:
        counted = counted.withColumn(
            "cyclomatic_complexity", F.when(python, text.mean_block_complexity(F.col("content"))).otherwise(F.lit(0.0))
        )
    if "maintainability_index" not in given:
        counted = counted.withColumn("_tokens", F.when(python, F.regexp_extract_all("content", F.lit(text.TOKEN), F.lit(0))))
        index = text.maintainability_index(
            F.size("_tokens"), F.size(F.array_distinct("_tokens")), F.col("cyclomatic_complexity"),
            F.col("_c.line_count"), F.col("_c.comment_lines"),
        )
        counted = counted.withColumn("maintainability_index", F.when(python, index).otherwise(F.lit(0.0)))
    loc = F.when(python, F.col("_c.line_count")).otherwise(F.col("_c.nonblank_lines"))
    ratio = F.when(python, text.ratio3(F.col("_c.comment_lines"), F.col("_c.line_count"))).otherwise(F.lit(0.0))

    def if_supported(col):
        return F.when(supported, col)

    return counted.select(
        "file_path", *keep, F.when(supported, F.lit("completed")).otherwise(F.col("status")).alias("status"), "reason",
        if_supported(F.col("cyclomatic_complexity").cast("double")).alias("cyclomatic_complexity"),
        if_supported(F.col("maintainability_index").cast("double")).alias("maintainability_index"),
        if_supported(loc).alias("lines_of_code"),
        if_supported(ratio).alias("comment_ratio"),
        *also,
    )


def import_stats(files: DataFrame, keep=(), first: int | None = None) -> DataFrame:
    """Distinct imports of each file: their number, the deepest name and all names, or the ``first`` ones."""
    named = files.select(
        "file_path", *keep,
        imp.extract_imports(text.universal_newlines(F.col("content")), text.extension(F.col("file_path"))).alias("_imports"),
    )
    names = F.col("_imports")
    return named.select(
        "file_path", *keep,
        F.size(names).alias("import_count"),
        imp.dependency_depth(names).alias("dependency_depth"),
        (names if first is None else F.slice(names, 1, first)).alias("imports"),
    )


def with_dependency_risk(stats: DataFrame, cfg: scoring.ScoreConfig = scoring.DEFAULT) -> DataFrame:
    n, depth = F.col("import_count"), F.col("dependency_depth")
    return stats.select(
        "*",
        scoring.dependency_risk(n, depth, cfg).alias("dependency_risk_score"),
        scoring.dependency_warnings(n, cfg).alias("dependency_warnings"),
    )
