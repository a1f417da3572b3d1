"""Source discovery: a walk over directories and globs, level by level, with a table of directories as frontier.

A frontier row is a directory and what is still to match below it: the remaining segments of a glob, or nothing, where
the whole tree below counts. Each level is one job: its tasks list their directories, hand on accepted files and give the
next frontier. So neither one process nor one directory level lists the whole tree, and a directory is listed by one task.

Segments follow the usual rules of globs: ``*`` and ``?`` stay inside a name, ``[...]`` is a set (``[!...]`` its complement),
``**`` stands for any number of directories, and none of them matches a name that begins with a dot unless the segment
does so itself. A directory that a glob matches is walked whole, names with dots included, as is a directory given by name.
Links to directories are followed where a pattern matches them, and not in a tree that counts whole. A file is listed once,
however many entries or patterns find it.
"""
from __future__ import annotations

import fnmatch
import glob
import os
import posixpath
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SOURCE_SUFFIXES
from ..session import scratch_path

_MAGIC = re.compile(r"[*?\[]")
#: ``kind`` is ``file`` for an accepted file, ``dir`` for a frontier row, ``other`` for a file of another ending.
_SCHEMA = "kind string, entry int, path string, length long, todo array<string>"
_ARROW = pa.schema([("kind", pa.string()), ("entry", pa.int32()), ("path", pa.string()), ("length", pa.int64()),
                    ("todo", pa.list_(pa.string()))])
#: name, is it a directory, is that a link, length
Child = tuple[str, bool, bool, int]


def qualify(path: str) -> str:
    """Local paths in the URI form that Spark reports in ``_metadata.file_path`` and listings."""
    if path.startswith("file:"):
        return "file:" + posixpath.normpath("/" + path[5:].lstrip("/"))
    return path if "://" in path else "file:" + posixpath.abspath(path)


class PythonFiles:
    """Directories as Python tasks see them: local or mounted folders, and the stores that Arrow knows."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.local = root.startswith("file:")
        self.prefix = root.rstrip("/")
        self.fs, base = (fs.LocalFileSystem(), "") if self.local else fs.FileSystem.from_uri(root)
        self.base = base.rstrip("/")

    def _own(self, path: str) -> str:
        return self.base + path[len(self.prefix):]

    def children(self, path: str) -> list[Child]:
        from pyarrow import fs

        try:
            found = self.fs.get_file_info(fs.FileSelector(self._own(path) or "/", recursive=False))
        except (FileNotFoundError, NotADirectoryError):  # a name before a pattern that is no directory
            return []
        return [(x.base_name, x.type == fs.FileType.Directory, self.local and os.path.islink(x.path), x.size or 0)
                for x in found if x.type != fs.FileType.NotFound]

    def open(self, path: str):
        return self.fs.open_input_file(self._own(path))

    def stat(self, path: str) -> Child | None:
        from pyarrow import fs

        x = self.fs.get_file_info(self._own(path) or "/")
        return None if x.type == fs.FileType.NotFound else (x.base_name, x.type == fs.FileType.Directory, False, x.size or 0)


class HadoopFiles:
    """Directories of a store that only Spark's own file systems reach; on the driver, a directory at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _child(self, status) -> Child:
        return status.getPath().getName(), status.isDirectory(), False, status.getLen()

    def children(self, path: str) -> list[Child]:
        at = self.path(path)
        return [self._child(x) for x in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def stat(self, path: str) -> Child | None:
        at = self.path(path)
        return self._child(self.fs.getFileStatus(at)) if self.fs.exists(at) else None


@lru_cache(maxsize=16)
def _python_files(prefix: str) -> PythonFiles:
    return PythonFiles(prefix)


def _scheme(uri: str) -> str:
    """What tells file systems apart: scheme and authority, with a slash behind them."""
    if uri.startswith("file:"):
        return "file:/"
    scheme, _, rest = uri.partition("://")
    return f"{scheme}://{rest.partition('/')[0]}/"


def in_tasks(prefix: str) -> bool:
    """Can Python tasks list this store by themselves?"""
    try:
        _python_files(prefix)
    except Exception:  # noqa: BLE001 - Arrow has many ways to say that it doesn't know a store
        return False
    return True


def _fits(name: str, segment: str) -> bool:
    return fnmatch.fnmatchcase(name, segment) and (segment.startswith(".") or not name.startswith("."))


def step(files, entry: int, path: str, todo: list[str] | None) -> Iterator[tuple]:
    """Rows that one frontier row gives: accepted files and the frontier below it."""
    def reached(at: str, child: Child, rest: list[str] | None) -> Iterator[tuple]:
        """``child`` is at ``at``, and ``rest`` is still to match below it."""
        name, is_dir, _, length = child
        if is_dir:
            yield "dir", entry, at, None, rest or None
        elif not rest:
            yield "file" if at.endswith(tuple(SOURCE_SUFFIXES)) else "other", entry, at, length, None

    if todo is None:  # a directory that counts whole
        for child in files.children(path):
            if not (child[1] and child[2]):
                yield from reached(f"{path.rstrip('/')}/{child[0]}", child, None)
        return
    segment, rest = todo[0], todo[1:]
    if segment == "**":
        # the directory itself is a match, and at the end of a pattern all that lies in it counts
        yield ("dir", entry, path, None, rest) if rest else ("other", entry, path, None, None)
        for child in files.children(path):
            at = f"{path.rstrip('/')}/{child[0]}"
            if child[1] and not child[0].startswith("."):
                yield "dir", entry, at, None, todo
            elif not rest and not (child[1] and child[2]):
                yield from reached(at, child, None)
    elif _MAGIC.search(segment):
        for child in files.children(path):
            if _fits(child[0], segment):
                yield from reached(f"{path.rstrip('/')}/{child[0]}", child, rest)
    else:
        at = f"{path.rstrip('/')}/{segment}"
        child = files.stat(at)
        if child is not None:
            yield from reached(at, child, rest)


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            made = list(step(_python_files(row["store"]), row["entry"], row["path"], row["todo"]))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), _ARROW.types)], schema=_ARROW)


def _levels(spark: SparkSession, store: str, frontier: list[tuple]) -> Iterator[DataFrame]:
    """The rows found at each level below the first frontier, each level written once."""
    rows = spark.createDataFrame([(*x, None, t) for *x, t in frontier], _SCHEMA)
    while True:
        found = (rows.filter("kind = 'dir'").select("entry", "path", "todo", F.lit(store).alias("store"))
                 .dropDuplicates(["entry", "path", "todo"]).repartition("path").mapInArrow(_by_task, _SCHEMA))
        path = scratch_path(spark, "frontier")
        found.write.parquet(path)
        rows = spark.read.schema(_SCHEMA).parquet(path)
        yield rows
        if rows.filter("kind = 'dir'").isEmpty():
            return


def _driver_levels(spark: SparkSession, store: str, frontier: list[tuple]) -> Iterator[DataFrame]:
    """The same rows for a store that Python tasks don't reach."""
    files, level = HadoopFiles(spark, store), [(e, p, t) for _, e, p, t in frontier]
    while level:
        found = [x for e, p, t in level for x in step(files, e, p, t)]
        if found:
            yield spark.createDataFrame(found, _SCHEMA)
        level = list({(e, p, tuple(t or ())): (e, p, t) for kind, e, p, _, t in found if kind == "dir"}.values())


def _start(number: int, entry: str, literal: bool = False) -> tuple[str, tuple]:
    """The store of an entry, and the frontier row that it begins with. ``literal``: nothing in it is a pattern."""
    uri = qualify(entry.rstrip("/") or "/")
    store = _scheme(uri)
    segments = [s for s in uri[len(store):].split("/") if s]
    magic = [i for i, s in enumerate(segments) if _MAGIC.search(s)]
    # the last name is looked at like a pattern, so that a file given by name is found as one
    plain = len(segments) - 1 if literal or not magic else magic[0]
    todo = [glob.escape(s) if literal else s for s in segments[max(0, plain):]]
    return store, ("dir", number, store + "/".join(segments[:max(0, plain)]), todo or None)


def _found(spark: SparkSession, starts: list[tuple[str, tuple]]) -> DataFrame:
    found = spark.createDataFrame([], _SCHEMA)
    for store in dict.fromkeys(s for s, _ in starts):
        walk: Callable = _levels if in_tasks(store) else _driver_levels
        for rows in walk(spark, store, [row for s, row in starts if s == store]):
            found = found.unionByName(rows)
    return found


def list_sources(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Accepted source files below all entries (files, directories, globs): ``path, length``, sorted by path.

    Files of other endings are left out, empty directories give nothing. A pattern that matches nothing is taken as a
    plain name; an entry that names nothing raises.
    """
    entries = [paths] if isinstance(paths, str) else list(paths)
    found = _found(spark, [_start(i, e) for i, e in enumerate(entries)])

    def missing() -> list[int]:
        # what was reached behind the whole pattern is a match, an empty directory too
        there = {r[0] for r in found.filter("kind <> 'dir' or todo is null").select("entry").distinct().collect()}
        return [i for i in range(len(entries)) if i not in there]

    plain = [i for i in missing() if _MAGIC.search(entries[i])]
    if plain:
        found = found.unionByName(_found(spark, [_start(i, entries[i], literal=True) for i in plain]))
    for i in missing():
        raise FileNotFoundError(f"no file at {entries[i]}")
    return found.filter("kind = 'file'").groupBy("path").agg(F.max("length").alias("length")).orderBy("path")
