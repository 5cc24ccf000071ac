"""Repository URLs of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from srcpulse.functions import urls


def classify_source_urls(df: DataFrame, url: str = "url", allowed_hosts=(urls.PAGE_HOST, urls.RAW_HOST)) -> DataFrame:
    """Adds owner, repo, ref, path_in_repo and is_raw_file, or the reason a URL is refused."""
    parts = df.withColumn("_p", urls.url_parts(F.col(url)))
    return parts.withColumn("_u", urls.source_url(F.col("_p"), allowed_hosts)).select(*df.columns, "_u.*")


def reason_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("urls"))


def folders(listing: DataFrame) -> DataFrame:
    """Every folder that holds a listed file, at any depth: ``repo, folder``."""
    parts = F.split("file_path", "/")
    depth = F.sequence(F.lit(1), F.size(parts) - 1)
    above = F.when(F.size(parts) > 1, F.transform(depth, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return listing.select("repo", F.explode_outer(above).alias("folder")).filter(F.col("folder").isNotNull()).distinct()


def focus_or_walk(targets: DataFrame, listing: DataFrame) -> DataFrame:
    """What the path of a URL points at: a file to put first, or a folder to stay within, or neither.

    ``targets(repo, path_in_repo, is_raw_file, ...)``, ``listing(repo, file_path)`` with paths below the
    repository. A raw file and a path that leaves the repository give neither.
    """
    path = F.regexp_replace(F.regexp_replace("path_in_repo", r"/+", "/"), r"/$", "")
    usable = ~F.col("is_raw_file") & (path != "") & ~path.rlike(r"(^|/)\.\.(/|$)")
    asked = targets.withColumn("_path", F.when(usable, path))
    files = listing.select("repo", F.col("file_path").alias("_path"), F.lit(False).alias("dir"))
    dirs = folders(listing).select("repo", F.col("folder").alias("_path"), F.lit(True).alias("dir"))
    known = files.unionByName(dirs).groupBy("repo", "_path").agg(F.bool_or(~F.col("dir")).alias("_file"), F.bool_or("dir").alias("_dir"))
    # Targets without a path need no lookup, and would all meet in one task there.
    found = asked.filter("_path IS NOT NULL").join(known, ["repo", "_path"], "left")
    rest = asked.filter("_path IS NULL").withColumns({"_file": F.lit(None).cast("boolean"), "_dir": F.lit(None).cast("boolean")})
    return found.select(*rest.columns).unionByName(rest).select(
        *targets.columns,
        F.when(F.col("_file"), F.col("_path")).alias("focus_path"),
        F.when(F.col("_dir"), F.col("_path")).alias("walk_root"),
    )
