"""A live listing of a folder as a Spark data source that takes filters and deals a tree out by what it holds."""

from __future__ import annotations

import json
import operator
import os
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as d
from pyspark.sql import functions as F

from stowage.session import reachable, stored

LISTING = "relative_path string, name string, entity_type string, size long, last_modified timestamp_ntz, inode string, links int, target string, real string"
#: Folders that a walk is dealt out by, about; so many times as many are opened for that at most.
PIECES, OPENED = 256, 4
#: Opened folders whose own entries one task lists.
TOGETHER = 16
#: Linked folders of one round that the driver names to the reader; more is an error.
MOST_LINKED = 100_000
#: What can be pushed: the comparison of a row's value with the filter's.
_TESTS: dict[type, Callable] = {
    d.EqualTo: operator.eq, d.In: lambda x, values: x in values, d.GreaterThan: operator.gt, d.GreaterThanOrEqual: operator.ge, d.LessThan: operator.lt, d.LessThanOrEqual: operator.le,
    d.StringStartsWith: str.startswith, d.StringEndsWith: str.endswith, d.StringContains: operator.contains,
}
_COLUMNS = [c.split()[0] for c in LISTING.split(", ")]


@dataclass
class Piece(d.InputPartition):
    """Folders (path, path below the root) that one task lists, with all below them or only their own entries."""

    folders: list[tuple[str, str]]
    whole: bool


class FolderReader(d.DataSourceReader):
    """Folders that a pushed prefix rules out are never opened. A walk is cut where it branches, however deep that is."""

    def __init__(self, options: dict):
        path = options["path"].rstrip("/") or "/"
        self.roots = [tuple(r) for r in json.loads(options.get("roots", "null")) or [[path, ""]]]
        self.closed = set(json.loads(options.get("closed", "[]")))
        self.follow = options.get("followsymlinks", "false").lower() == "true"
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.pieces = int(options.get("pieces", PIECES))
        self.tests: list[tuple[int, type, object]] = []
        self.prefixes: list[str] = []

    def _wanted(self, row: tuple) -> bool:
        return all(row[i] is not None and (kind is d.IsNotNull or _TESTS[kind](row[i], value)) for i, kind, value in self.tests)

    def _open(self, path: str, below: str) -> bool:
        """Whether the folder can hold rows that pass the pushed prefixes."""
        start = below + "/" if below else ""
        return path not in self.closed and all(start.startswith(p) or p.startswith(start) for p in self.prefixes)

    def partitions(self) -> list[Piece]:
        todo = deque(r for r in self.roots if self._open(*r))
        if not self.recursive or any(os.path.isfile(path) for path, _ in todo):
            return [Piece([r], False) for r in todo] or [Piece([], False)]
        opened = []
        while todo and len(todo) < self.pieces and len(opened) < OPENED * self.pieces:
            path, below = todo.popleft()
            opened.append((path, below))
            inner = sorted(e.name for e in os.scandir(path) if e.is_dir(follow_symlinks=False))
            todo.extend(x for name in inner if self._open(*(x := (os.path.join(path, name), f"{below}/{name}" if below else name))))
        return [Piece(opened[i : i + TOGETHER], False) for i in range(0, len(opened), TOGETHER)] + [Piece([x], True) for x in todo] or [Piece([], False)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        todo = list(partition.folders)
        while todo:
            path, below = todo.pop()
            if os.path.isfile(path):  # a single object has no path below itself
                s = os.stat(path)
                rows = [("", os.path.basename(path), "File", s.st_size, _moment(s), None, s.st_nlink, None, None)]
                yield from filter(self._wanted, rows)
                continue
            for e in os.scandir(path):
                if e.path in self.closed:
                    continue
                inner = f"{below}/{e.name}" if below else e.name
                row = self._row(e, inner)
                if self._wanted(row):
                    yield row
                if partition.whole and row[2] == "Folder" and self._open(e.path, inner):
                    todo.append((e.path, inner))

    def _row(self, e: os.DirEntry, inner: str) -> tuple:
        link, s = e.is_symlink(), e.stat(follow_symlinks=False)
        target, real = os.readlink(e.path) if link else None, None
        if link and self.follow and os.path.exists(e.path):
            s, real = os.stat(e.path), os.path.realpath(e.path)
            kind = "LinkedFolder" if os.path.isdir(real) else "Hardlink" if s.st_nlink > 1 else "File"
        else:
            kind = "Folder" if e.is_dir(follow_symlinks=False) else "Symlink" if link else "Hardlink" if s.st_nlink > 1 else "File"
        folder = kind in ("Folder", "LinkedFolder")
        return inner, e.name, kind, 0 if folder else s.st_size, _moment(s), str(s.st_ino) if kind == "Hardlink" else None, s.st_nlink, target, real if kind == "LinkedFolder" else None


class FilteringReader(FolderReader):
    """Takes filters from the plan. One plan at a time: Spark keeps what a relation has taken by the relation, not by the plan."""

    def pushFilters(self, filters: list[d.Filter]) -> Iterable[d.Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, d.IsNotNull) and column in _COLUMNS:
                self.tests.append((_COLUMNS.index(column), d.IsNotNull, None))
            elif type(f) in _TESTS and column in _COLUMNS:
                self.tests.append((_COLUMNS.index(column), type(f), f.value))
                if column == "relative_path" and isinstance(f, d.EqualTo | d.StringStartsWith):
                    self.prefixes.append(f.value)
            else:
                yield f


def _moment(s: os.stat_result) -> datetime:
    return datetime.fromtimestamp(s.st_mtime_ns // 1000 / 1e6, UTC).replace(tzinfo=None)


class FolderListing(d.DataSource):
    """``spark.read.format("folder_listing")``: a live listing of a folder that all executors can see. Options: path, recursive, followSymlinks, pieces."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> d.DataSourceReader:
        return FolderReader({k.lower(): v for k, v in self.options.items()})


class FilteredListing(FolderListing):
    @classmethod
    def name(cls) -> str:
        return "filtered_folder_listing"

    def reader(self, schema) -> d.DataSourceReader:
        return FilteringReader({k.lower(): v for k, v in self.options.items()})


_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _load(spark: SparkSession, path: str, where: str | None, **options: object) -> DataFrame:
    """The entries as they are when the result is read; with a condition, as they are now, written to the shared folder."""
    load = lambda kind: spark.read.format(kind).options(path=path, **{k: str(v) for k, v in options.items()}).load()
    if where is None:
        return load("folder_listing")
    before = spark.conf.get(_PUSHDOWN)
    spark.conf.set(_PUSHDOWN, "true")
    try:
        return stored(load("filtered_folder_listing").where(where), "listing")
    finally:
        spark.conf.set(_PUSHDOWN, before)


def folder_listing(spark: SparkSession, path: str, where: str | None = None, recursive: bool = True, follow_symlinks: bool = False, pieces: int = PIECES) -> DataFrame:
    """The entries below a folder, or a single file.

    where: a condition that is told to the reader, which opens no folder that a prefix of the path rules out. It is given
    here and not by a later filter, as Spark 4.1 mixes up the filters of two plans over one Python source: a listing that
    is filtered is a relation of its own, read once and stored.

    With links followed, a real folder is listed once: under its own path where that lies below the root, else under the
    least link that leads there. What leads to a folder that is listed already has no row. Links are found by a scan of
    what is new in each round, until none leads out of what has been opened.
    """
    reachable(spark).dataSource.register(FolderListing)
    spark.dataSource.register(FilteredListing)
    options = {"recursive": recursive, "followSymlinks": follow_symlinks, "pieces": pieces}
    if not follow_symlinks:
        return _load(spark, path, where, **options).drop("real")
    kept = lambda **more: _load(spark, path, where, **options, **more).where("entity_type <> 'LinkedFolder'")
    found, opened, new = kept(), [os.path.realpath(path)], _load(spark, path, None, **options)
    while recursive:
        links = stored(new.where("entity_type = 'LinkedFolder'").select("relative_path", "real", "name", "last_modified", "links", "target"), "links")
        fresh = links.where(~_below("real", opened)).groupBy("real").agg(F.min(F.struct("relative_path", "name", "last_modified", "links", "target")).alias("l"))
        covered = fresh.select("real", F.explode(_ancestors("real")).alias("top")).where("top <> real").join(fresh.select(F.col("real").alias("top")), "top", "left_semi").select("real").distinct()
        outer = fresh.join(covered, "real", "left_anti").select("real", "l.*")
        roots = sorted((r["real"], r["relative_path"]) for r in outer.limit(MOST_LINKED + 1).collect())
        if not roots:
            break
        if len(roots) > MOST_LINKED:
            raise RuntimeError(f"over {MOST_LINKED} linked folders lead out of {path}")
        more = {"roots": json.dumps(roots), "closed": json.dumps(opened)}
        new = _load(spark, path, None, **options, **more)
        own = outer.select("relative_path", "name", F.lit("Folder").alias("entity_type"), F.lit(0).cast("long").alias("size"), "last_modified", F.lit(None).cast("string").alias("inode"), "links", "target", F.lit(None).cast("string").alias("real"))
        found = found.unionByName(own if where is None else own.where(where)).unionByName(kept(**more))
        opened += [real for real, _ in roots]
    return found.drop("real")


def _ancestors(column: str):
    """A real path and the folders that it lies in; the file system's root is empty."""
    parts = F.split(column, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def _below(column: str, tops: list[str]):
    """Whether a real path is one of these folders or lies below one."""
    return F.arrays_overlap(_ancestors(column), F.array(*[F.lit(t if t != "/" else "") for t in tops]))
