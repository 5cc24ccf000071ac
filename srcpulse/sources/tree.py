"""A folder tree as a data source: one row per file that belongs to the corpus, read by planned tasks.

Planning lists folders from the top until there are enough of them for all tasks, and not further: a partition is a folder
with all below it, or the files of one folder, in several turns where they are many. Tasks walk, filter and read their part, so
neither the planner nor one task sees the whole tree, and nothing is listed twice but the folders near the top.

Filters on ``file_path`` (equal, in, prefix) and ``size_bytes`` (at most) cut folders at planning and files before they are
opened, where ``spark.sql.python.filterPushdown.enabled`` was on when the tree was named; Spark applies all filters again.

A file over ``max_bytes`` is a row without content and the reason ``oversized``; one that is no UTF-8 or is gone while the
tree is read has the reason ``unreadable``. Names that start with ``_`` or ``.`` are files like others, unlike in Spark's own sources.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith,
)

from srcpulse.functions.text import universal_newlines
from srcpulse.sources.corpus import MAX_BYTES, PROJECT_EXTENSIONS, PROJECT_SKIP, _inside, _open

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "source_tree"
OVERSIZED, UNREADABLE = "oversized", "unreadable"
SCHEMA = "file_path string, content string, size_bytes bigint, reason string"
_ARROW = pa.schema([("file_path", pa.string()), ("content", pa.string()), ("size_bytes", pa.int64()), ("reason", pa.string())])
#: Bytes of one batch of rows, and files of one folder that one task takes.
_BATCH_BYTES, _TURN_FILES = 16 * 1024 * 1024, 2_000


class Part(InputPartition):
    """Folders to walk, folders whose own files are read in turn ``i`` of ``n``, and single files."""

    def __init__(self, walk: list[str], own: list[tuple[str, int, int]], single: list[str]) -> None:
        self.walk, self.own, self.single = walk, own, single


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self._root = options["root"]
        self._extensions = tuple(json.loads(options.get("extensions", json.dumps(PROJECT_EXTENSIONS))))
        self._skip = set(json.loads(options.get("skip_dirs", json.dumps(PROJECT_SKIP))))
        self._hidden = options.get("skip_hidden", "false").lower() == "true"
        self._max_bytes = int(options.get("max_bytes", MAX_BYTES))
        self._start, self._focus = _inside(options.get("walk_root")), _inside(options.get("focus_path"))
        self._tasks = max(1, int(options.get("tasks", 8)))
        self._prefixes: list[str] = []
        self._names: set[str] | None = None
        self._most: int | None = None

    def _may_hold(self, folder: str) -> bool:
        """Whether a folder can hold a file that the filters let through."""
        below = f"{folder}/" if folder else ""
        fits = all(p.startswith(below) or below.startswith(p) for p in self._prefixes)
        return fits and (self._names is None or any(n.startswith(below) for n in self._names))

    def _wanted(self, path: str, size: int) -> bool:
        return (
            path.endswith(self._extensions) and path != self._focus and all(path.startswith(p) for p in self._prefixes)
            and (self._names is None or path in self._names) and (self._most is None or size <= self._most)
        )

    def _entries(self, system, base: str, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        """Folders to go on with, and files with their sizes, of one folder."""
        folders, files = [], []
        for info in system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=True)):
            name = info.path.rsplit("/", 1)[-1]
            path = f"{folder}/{name}" if folder else name
            if info.type == fs.FileType.Directory:
                if name not in self._skip and not (self._hidden and name.startswith(".")) and self._may_hold(path):
                    folders.append(path)
            elif self._wanted(path, info.size):
                files.append((path, info.size))
        return folders, files

    def partitions(self) -> list[Part]:
        system, base = _open(self._root)
        ahead, own = [self._start] if self._may_hold(self._start) else [], []
        while ahead and len(ahead) < 4 * self._tasks and len(own) < 16 * self._tasks:
            folder = ahead.pop(0)
            folders, files = self._entries(system, base, folder)
            ahead += folders
            turns = -(-len(files) // _TURN_FILES)
            own += [(folder, i, turns) for i in range(turns)]
        # Folders that were listed already go in a few partitions; what is ahead may be large, so each is on its own.
        parts = [Part([], own[i :: self._tasks], []) for i in range(min(self._tasks, len(own)))]
        parts += [Part([folder], [], []) for folder in ahead]
        if self._focus:
            parts.append(Part([], [], [self._focus]))
        return parts or [Part([], [], [])]

    def _files(self, system, base: str, part: Part) -> Iterator[tuple[str, int]]:
        for path in part.single:
            info = system.get_file_info(f"{base}/{path}")
            if info.type == fs.FileType.File:
                yield path, info.size
        for folder, turn, turns in part.own:
            yield from (f for f in self._entries(system, base, folder)[1] if zlib.crc32(f[0].encode()) % turns == turn)
        ahead = list(part.walk)
        while ahead:
            folders, files = self._entries(system, base, ahead.pop())
            ahead += folders
            yield from files

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, base = _open(self._root)
        rows, held = [], 0
        for path, size in self._files(system, base, partition):
            content, reason = None, OVERSIZED
            if size <= self._max_bytes:
                try:
                    with system.open_input_stream(f"{base}/{path}") as stream:
                        content, reason = stream.read().decode("utf-8"), None
                except (OSError, UnicodeDecodeError):
                    reason = UNREADABLE
                held += size
            rows.append((path, content, size, reason))
            if held >= _BATCH_BYTES or len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class FilteringTreeReader(TreeReader):
    """The same where Spark hands filters over; it refuses a reader that asks for them where it does not."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            match one:
                case StringStartsWith(("file_path",), value):
                    self._prefixes.append(value)
                case EqualTo(("file_path",), value):
                    self._names = {value} if self._names is None else self._names & {value}
                case In(("file_path",), values):
                    self._names = set(values) if self._names is None else self._names & set(values)
                case LessThanOrEqual(("size_bytes",), value) | LessThan(("size_bytes",), value):
                    self._most = value if self._most is None else min(self._most, value)
            yield one


class TreeSource(DataSource):
    """``spark.read.format("source_tree").option("root", ...)`` after ``spark.dataSource.register(TreeSource)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        kind = FilteringTreeReader if self.options.get("pushdown") == "true" else TreeReader
        return kind(dict(self.options))


def read_tree(
    spark: SparkSession, root: str, extensions: Sequence[str] = PROJECT_EXTENSIONS, max_bytes: int = MAX_BYTES,
    skip_dirs: Sequence[str] = PROJECT_SKIP, skip_hidden: bool = False, walk_root: str | None = None, focus_path: str | None = None,
) -> DataFrame:
    """``file_path`` (below ``root``), ``content`` as it is, ``size_bytes`` and ``reason`` of the files of a tree."""
    spark.dataSource.register(TreeSource)
    options = {
        "root": root, "extensions": json.dumps(list(extensions)), "max_bytes": str(max_bytes), "skip_dirs": json.dumps(list(skip_dirs)),
        "skip_hidden": str(skip_hidden), "walk_root": walk_root or "", "focus_path": focus_path or "", "tasks": str(spark.sparkContext.defaultParallelism),
        "pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"),
    }
    return spark.read.format(FORMAT).options(**options).load()


def _repo_name(root: str) -> str:
    return root.rstrip("/").rsplit("/", 1)[-1]


def scanned_path(
    root: str, extensions: Sequence[str] = PROJECT_EXTENSIONS, skip_dirs: Sequence[str] = PROJECT_SKIP, file_path: str = "file_path"
) -> Column:
    """Whether ``scan_tree`` can give a row of that path, by its name alone. One pattern, as a path may be an expression of its own."""
    left_out = f"(?!(?:.*/)?(?:{'|'.join(map(re.escape, skip_dirs))})/)" if skip_dirs else ""
    return F.col(file_path).rlike(rf"(?s)\A{re.escape(_repo_name(root))}/{left_out}.*(?:{'|'.join(map(re.escape, extensions))})\z")


def scan_tree(spark: SparkSession, root: str, *args, repo_is_first_folder: bool = False, **options) -> DataFrame:
    """``repo, file_path, content, size_bytes, reason``: paths start with the repository, line ends are those of Python's text mode."""
    rows = read_tree(spark, root, *args, **options)
    path = F.col("file_path")
    repo = F.split(path, "/", 2).getItem(0) if repo_is_first_folder else F.lit(_repo_name(root))
    path = path if repo_is_first_folder else F.concat_ws("/", repo, path)
    return rows.select(repo.alias("repo"), path.alias("file_path"), universal_newlines(F.col("content")).alias("content"), "size_bytes", "reason")


def write_tree(files: DataFrame, root: str) -> int:
    """Write ``content`` of each row to ``file_path`` below ``root``; the number of files. A repeated task writes the same files."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _open(root)
        made = ""
        for batch in batches:
            for path, content in sorted(zip(batch["file_path"], batch["content"], strict=True), key=lambda f: f[0]):
                if (folder := f"{base}/{path}".rsplit("/", 1)[0]) != made:
                    system.create_dir(folder, recursive=True)
                    made = folder
                with system.open_output_stream(f"{base}/{path}") as stream:
                    stream.write(content.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    return files.where("content IS NOT NULL").select("file_path", "content").mapInPandas(write, "n bigint").agg(F.sum("n")).first()[0] or 0
