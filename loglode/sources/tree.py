"""File listings of source trees as a Spark data source, and their contents.

Names that start with ``_`` or ``.`` are listed (``binaryFile`` would hide them),
links are not followed. A partition is one directory slice: big flat directories
are cut by a hash of the file name, so no task gets a directory whole.
"""

from __future__ import annotations

import os
import stat
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loglode.functions.text import decode_lossy

FORMAT = "source_tree"
LISTING = "root string, path string, type string, length bigint, is_symlink boolean, link_target string, error string"
_COLUMNS = [f.split()[0] for f in LISTING.split(", ")]
PLAN_DIRS = 512
FILES_PER_SLICE = 5000


@dataclass
class Slice(InputPartition):
    """Part of one directory, or everything below it when ``deep``."""

    root: str
    directory: str
    deep: bool
    number: int = 0
    of: int = 1


def _entry(root: str, full: str, pruned: bool = False) -> tuple:
    path = os.path.relpath(full, root).replace(os.sep, "/")
    try:
        info = os.lstat(full)
    except OSError as e:
        return (root, path, "file", None, False, None, f"stat_failed: {e}")
    if stat.S_ISLNK(info.st_mode):
        target = os.readlink(full).replace("\\", "/")
        length = os.stat(full).st_size if os.path.isfile(full) else None
        kind = "symlink_dir" if os.path.isdir(full) else "symlink"
        return (root, path, kind, length, True, target, None)
    if stat.S_ISDIR(info.st_mode):
        return (root, path, "excluded_dir" if pruned else "dir", None, False, None, None)
    return (root, path, "file", info.st_size, False, None, None)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r for r in options.get("path", "").split("\x1f") if r]
        self.excluded = {d for d in options.get("exclude", "").split("\x1f") if d}

    def partitions(self) -> list[Slice]:
        """Open directories breadth first until there are enough slices; the rest is walked by tasks."""
        slices: list[Slice] = []
        for root in self.roots:
            if not os.path.isdir(root):
                continue
            queue, at = [root], 0
            while at < len(queue) and at < PLAN_DIRS:
                n_files, subdirs = 0, []
                try:
                    with os.scandir(queue[at]) as entries:
                        for e in entries:
                            if e.is_dir(follow_symlinks=False):
                                if e.name not in self.excluded:
                                    subdirs.append(e.path)
                            else:
                                n_files += 1
                except OSError:
                    pass
                of = 1 + n_files // FILES_PER_SLICE
                slices += [Slice(root, queue[at], False, i, of) for i in range(of)]
                queue += sorted(subdirs)
                at += 1
            slices += [Slice(root, d, True) for d in queue[at:]]
        return slices or [Slice("", "", False)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in self._rows(part):
            rows.append(row)
            if len(rows) >= 4096:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _rows(self, part: Slice) -> Iterator[tuple]:
        if not part.directory:
            return
        pending = [part.directory]
        while pending:
            here = pending.pop()
            try:
                names = sorted(os.listdir(here))
            except OSError:
                continue
            for name in names:
                full = os.path.join(here, name)
                if part.of > 1 and zlib.crc32(name.encode("utf-8", "replace")) % part.of != part.number:
                    continue
                is_dir = os.path.isdir(full) and not os.path.islink(full)
                pruned = is_dir and name in self.excluded
                if is_dir and part.deep and not pruned:
                    pending.append(full)
                yield _entry(part.root, full, pruned)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
        arrays = [pa.array(c, type=t) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays(arrays, names=_COLUMNS)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def _read_bytes(paths: pa.Array) -> pa.Array:
    out = []
    for p in paths.to_pylist():
        try:
            with open(p, "rb") as f:
                out.append(f.read())
        except OSError:
            out.append(None)
    return pa.array(out, type=pa.binary())


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def list_tree(spark: SparkSession, roots: list[str], excluded_dirs: list[str] = ()) -> DataFrame:
    """Entries below the roots; excluded directories (by name, never a root) appear as one row each."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format(FORMAT).option("exclude", "\x1f".join(excluded_dirs))
    return reader.load("\x1f".join(os.path.abspath(r) for r in roots))


def with_content(listing: DataFrame) -> DataFrame:
    """Add ``content``, null where a file cannot be read. Filter the listing before."""
    full = F.concat_ws("/", "root", "path")
    return listing.withColumn("content", F.arrow_udf(_read_bytes, "binary")(full))


def with_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Lossy text instead of bytes; unreadable files drop out, counted by ``scan_stats``."""
    return files.filter(F.col(content).isNotNull()).withColumn("text", decode_lossy(F.col(content))).drop(content)


def read_binary(spark: SparkSession, paths: list[str], pattern: str | None = None) -> DataFrame:
    """Fast path for object stores: Spark's own reader, which hides ``_`` and ``.`` names and follows links."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(paths).select("path", "length", F.lit(False).alias("is_symlink"), "content")


def scan_reason(reason: Column) -> Column:
    """Reason of a listing row, directories pruned by the walk included."""
    return F.when(F.col("type") == "excluded_dir", "excluded_dir").otherwise(reason)
