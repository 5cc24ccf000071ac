"""Source files from a folder tree."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Sequence

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Functions sent to tasks travel with their code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values: limits and folders left out ---------------------------------------------------
MAX_BYTES = 2 * 1024 * 1024
PROJECT_EXTENSIONS = (".py", ".js", ".ts")
REPOSITORY_EXTENSIONS = (".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".rs", ".java")
PROJECT_SKIP = (".git", "node_modules", "__pycache__", "venv", ".venv")
REPOSITORY_SKIP = (".git", "node_modules", "__pycache__", "venv", ".venv", "dist", "build")
# -------------------------------------------------------------------------------------------------


def _inside(walk_root: str | None) -> str:
    """The sub-tree as a prefix; empty, so the whole tree, where it leads outside."""
    parts = [p for p in (walk_root or "").split("/") if p not in ("", ".")]
    return "" if ".." in parts or (walk_root or "").startswith("/") else "/".join(parts)


def analyzable(
    path: Column, size_bytes: Column, extensions: Sequence[str] = PROJECT_EXTENSIONS, max_bytes: int = MAX_BYTES,
    skip_dirs: Sequence[str] = PROJECT_SKIP, skip_hidden: bool = False, walk_root: str | None = None,
) -> Column:
    """Whether a file, by its path below the tree's root and its size, belongs to the corpus."""
    root = _inside(walk_root)
    below = F.substring(path, F.lit(len(root) + 2), F.length(path)) if root else path
    named = F.lit(False)
    for ext in extensions:
        named = named | F.endswith(path, F.lit(ext))
    keep = named & (size_bytes <= max_bytes)
    if root:
        keep = keep & F.startswith(path, F.lit(root + "/"))
    if skip_dirs:
        keep = keep & ~below.rlike("(?:^|/)(?:" + "|".join(re.escape(d) for d in skip_dirs) + ")/")
    if skip_hidden:
        keep = keep & ~below.rlike(r"(?:^|/)\.[^/]*/")
    return keep


def _open(root: str) -> tuple[fs.FileSystem, str]:
    """File system and base path of a folder: a local path or a URI such as hdfs:// or s3://."""
    if "://" in root or root.startswith("file:"):
        system, base = fs.FileSystem.from_uri(root)
        return system, base.rstrip("/")
    return fs.LocalFileSystem(), os.path.abspath(root)


def scan_corpus(
    spark: SparkSession, root: str, extensions: Sequence[str] = PROJECT_EXTENSIONS, max_bytes: int = MAX_BYTES,
    skip_dirs: Sequence[str] = PROJECT_SKIP, skip_hidden: bool = False, walk_root: str | None = None,
    repo_is_first_folder: bool = False, focus_path: str | None = None,
) -> DataFrame:
    """Read a folder tree as ``repo, file_path, content, size_bytes``, without its oversized files (``tree.scan_tree`` lists them too).

    ``focus_path`` names one file below ``root`` that is read whatever its suffix or folder.

    Suffix and size are applied before a file is opened. Text that is not UTF-8 comes as null content. ``file_path``
    starts with the repository: ``<repo>/<path below it>``, the layout of all operators, so files of one name in two
    repositories stay apart.
    """
    from srcpulse.sources import tree  # which takes its limits and lists from here

    found = tree.scan_tree(
        spark, root, extensions, max_bytes, skip_dirs, skip_hidden, walk_root, focus_path, repo_is_first_folder=repo_is_first_folder
    )
    return found.where(F.col("size_bytes") <= max_bytes).drop("reason")
