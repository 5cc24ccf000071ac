"""Change sets and requested paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# --- fixed values: limits ------------------------------------------------------------------------
MAX_BYTES = 2 * 1024 * 1024
MAX_PATH_LENGTH = 4096
# -------------------------------------------------------------------------------------------------


def change_set(status: DataFrame) -> DataFrame:
    """Staged files of a repository; its modified files where nothing is staged.

    ``status(repo, file_path, status)``. An anti join on the distinct repositories with staged files
    instead of a window over each repository, so a very large repository stays spread over many tasks.
    """
    staged = status.filter("status = 'staged'").select("repo", "file_path")
    with_staged = staged.select("repo").distinct()
    modified = status.filter("status = 'modified'").select("repo", "file_path")
    return staged.withColumn("status", F.lit("staged")).unionByName(
        modified.join(with_staged, "repo", "left_anti").withColumn("status", F.lit("modified"))
    )


def batch_status(requests: DataFrame, max_files: int | None = None) -> DataFrame:
    """Number of requested paths of each batch, and whether it is refused as a whole: over twice ``max_files``, if given."""
    refused = F.lit(False) if max_files is None else F.col("requested") > 2 * max_files
    return requests.groupBy("batch_id").agg(F.count(F.lit(1)).alias("requested")).select(
        "batch_id",
        "requested",
        F.when(refused, F.lit("too_many_paths")).otherwise(F.lit("accepted")).alias(
            "batch_status"
        ),
    )


def validate_paths(
    requests: DataFrame, files: DataFrame, max_files: int | None = None, max_bytes: int = MAX_BYTES,
    max_path_length: int = MAX_PATH_LENGTH, below_root: bool = False,
) -> DataFrame:
    """Requested paths with ``outcome`` valid, oversized or rejected.

    ``requests(batch_id, repo, request_ord, requested_path)``, ``files(file_path, size_bytes)``. Paths start with the
    repository's name, or with ``below_root`` right below it; then ``files`` has ``repo`` too and both must fit.
    Every request is answered. With ``max_files`` only those that a batch of that size looks at: the first ``max_files + 1`` requests of a batch are looked at, and none after ``max_files`` valid ones.
    The first cut is a row number, made before the shuffle, so the running count sees at most
    ``max_files + 1`` rows of a batch.
    """
    order = Window.partitionBy("batch_id").orderBy("request_ord")
    first = requests
    if max_files is not None:
        first = requests.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_files + 1)
    keys = ["repo", "requested_path"] if below_root else ["requested_path"]
    known = files.select(*keys[:-1], F.col("file_path").alias("requested_path"), F.col("size_bytes"))
    path = F.col("requested_path")
    inside = (
        F.col("size_bytes").isNotNull()
        & (path != "")
        & (F.length(path) <= max_path_length)
        & (F.lit(True) if below_root else F.startswith(path, F.concat(F.rtrim(F.col("repo"), F.lit("/")), F.lit("/"))))
    )
    outcome = (
        F.when(~inside, F.lit("rejected")).when(F.col("size_bytes") > max_bytes, F.lit("oversized")).otherwise(F.lit("valid"))
    )
    answered = first.join(known, keys, "left").withColumn("outcome", outcome)
    columns = ("batch_id", "repo", "request_ord", "requested_path", "outcome")
    if max_files is None:
        return answered.select(*columns)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        answered.withColumn("_before", F.coalesce(F.sum((F.col("outcome") == "valid").cast("int")).over(before), F.lit(0)))
        .filter(F.col("_before") < max_files)
        .select(*columns)
    )


def path_counts(looked_at: DataFrame) -> DataFrame:
    return looked_at.groupBy("batch_id").agg(
        F.count_if(F.col("outcome") == "valid").alias("valid_paths"),
        F.count_if(F.col("outcome") != "valid").alias("paths_rejected"),
    )


def paths_in_repo(requests: DataFrame, files: DataFrame) -> DataFrame:
    return requests.join(files.select(F.col("file_path").alias("requested_path")), "requested_path", "left_semi")


def paths_not_in_repo(requests: DataFrame, files: DataFrame) -> DataFrame:
    return requests.join(files.select(F.col("file_path").alias("requested_path")), "requested_path", "left_anti")


def validate_repos(requests: DataFrame, repos: DataFrame, max_path_length: int = MAX_PATH_LENGTH) -> DataFrame:
    """Each requested repository path with ``ok``, ``invalid`` or ``not_found``."""
    known = repos.select(F.col("repo").alias("repo_path")).distinct().withColumn("_known", F.lit(True))
    path = F.col("repo_path")
    bad = path.isNull() | (path == "") | (F.length(path) > max_path_length) | path.rlike("^/+$")
    return requests.join(known, "repo_path", "left").select(
        *requests.columns,
        F.when(bad, F.lit("invalid")).when(F.col("_known").isNull(), F.lit("not_found")).otherwise(F.lit("ok")).alias(
            "repo_status"
        ),
    )
