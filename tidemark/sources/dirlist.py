"""A Spark data source over directories: ``spark.read.format("dirlist").option("path", ...)``.

Options: recursive, dirs (directories are rows), hidden (enter directories named with a leading dot),
errors (fail or skip), strict (other kinds of files and undecodable names fail), exclude and include
(JSON lists of patterns; an excluded directory is not entered, an excluded root gives no rows), root (a
directory's own row, named ".", where there are no patterns).
"""

import json
import os
import re
import stat

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directories that the driver lists to deal the tree, and parts that it is dealt over at most.
SPLIT, PARTS = 64, 1024
SCHEMA = "path string, size long, is_dir boolean, modified long, change_time long, inode long, mode int, is_symlink boolean, symlink_target string"


def entry(root: str, full: str) -> tuple:
    """One row; links are not followed."""
    s = os.lstat(full)
    link = stat.S_ISLNK(s.st_mode)
    folder = stat.S_ISDIR(s.st_mode)
    name = os.path.relpath(full, root) if full != root else os.path.basename(root)
    return (name, 0 if folder else s.st_size, folder, s.st_mtime_ns, s.st_ctime_ns, s.st_ino, stat.S_IMODE(s.st_mode), link, os.readlink(full) if link else None)


def root_excluded(root: str, exclude) -> bool:
    """Whether a pattern excludes the root itself, so that nothing is scanned (A2)."""
    return any(re.search(p, root) for p in exclude)


def single_file_candidate(root: str, found: DataFrame) -> bool:
    """Whether the listing of the root is one row of its own name that is no directory (A4)."""
    rows = found.select("path", "is_dir").limit(2).collect()
    return len(rows) == 1 and not rows[0].is_dir and rows[0].path == os.path.basename(root.rstrip("/"))


def confirms_single_file(root: str, parent: DataFrame) -> bool:
    """Whether the listing of the parent has the root as something other than a directory (A5)."""
    name = os.path.basename(root.rstrip("/"))
    return bool(parent.filter((F.col("path") == name) & ~F.col("is_dir")).limit(1).count())


class Part(InputPartition):
    def __init__(self, starts, descend):
        self.starts, self.descend = starts, descend


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        on = lambda k, default: o.get(k, default).lower() == "true"
        self.root = o["path"].removeprefix("file://").rstrip("/") or "/"
        self.recursive, self.dirs, self.hidden = on("recursive", "false"), on("dirs", "true"), on("hidden", "true")
        self.skip, self.strict = o.get("errors", "fail") == "skip", on("strict", "false")
        self.exclude, self.include = (json.loads(o.get(k, "[]")) for k in ("exclude", "include"))
        self.own = on("root", "false") and self.dirs and not (self.exclude or self.include)

    def single(self) -> bool:
        return os.path.islink(self.root) or not os.path.isdir(self.root)

    def partitions(self):
        """The directories listed here by their own entries, the trees found below them dealt evenly. Listing
        goes on breadth first, as a root may hold one deep tree."""
        if root_excluded(self.root, self.exclude):
            return [Part([], False)]
        if self.single() or not self.recursive:
            return [Part([self.root], False)]
        listed, found = [], [self.root]
        while found and len(listed) < SPLIT and len(found) < PARTS:
            try:
                below = sorted(d.path for d in os.scandir(found[0]) if d.is_dir(follow_symlinks=False))
            except OSError:
                if found[0] == self.root and not self.skip:
                    raise
                below = []
            listed.append(found.pop(0))
            found += [d for d in below if self.enters(d)]
        return [*(Part([d], False) for d in listed), *(Part(found[k::PARTS], True) for k in range(min(PARTS, len(found))))]

    def matches(self, full: str, patterns) -> bool:
        return any(re.search(p, os.path.relpath(full, self.root)) for p in patterns)

    def enters(self, full: str) -> bool:
        return not self.matches(full, self.exclude) and (self.hidden or not os.path.basename(full).startswith("."))

    def kept(self, full: str) -> bool:
        return not self.matches(full, self.exclude) and (not self.include or self.matches(full, self.include))

    def read(self, partition):
        if self.single() and partition.starts:
            yield entry(self.root, self.root)
            return
        if self.own and self.root in partition.starts:
            yield (".", *entry(self.root, self.root)[1:])
        todo = list(partition.starts)
        while todo:
            try:
                found = sorted(os.scandir(todo.pop()), key=lambda d: d.name)
            except OSError:
                if self.skip:
                    continue
                raise
            for d in found:
                try:
                    row = entry(self.root, d.path)
                    if self.strict:
                        row[0].encode()
                        if not (row[2] or row[7] or stat.S_ISREG(os.lstat(d.path).st_mode)):
                            raise OSError(f"neither file, directory nor link: {d.path}")
                except (OSError, UnicodeEncodeError):
                    if self.skip:
                        continue
                    raise
                if row[2]:
                    if partition.descend and self.enters(d.path):
                        todo.append(d.path)
                    if not self.dirs:
                        continue
                if self.kept(d.path):
                    yield row


class DirectoryListing(DataSource):
    @classmethod
    def name(cls):
        return "dirlist"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(DirectoryListing)


def listing(spark, path: str, **options) -> DataFrame:
    """A1-A11 by options."""
    register(spark)
    text = {k: json.dumps(v) if isinstance(v, list) else str(v).lower() for k, v in options.items()}
    return spark.read.format("dirlist").options(path=path, **text).load()


def blocks(files: DataFrame, requests: DataFrame, most: int = 100 * 1024 * 1024) -> DataFrame:
    """(path, idx, success, data, error): ranges of file contents; a bad one fails alone.

    ``files``: path, content. ``requests``: path, idx, offset, length.
    """
    j = requests.join(files, "path", "left")
    error = (
        F.when(F.col("length") > most, "range too long")
        .when(F.col("content").isNull(), "file not found")
        .when((F.col("offset") < 0) | (F.col("offset") >= F.length("content")), "offset beyond the end")
    )
    data = F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return j.select("path", "idx", error.isNull().alias("success"), F.when(error.isNull(), data).alias("data"), error.alias("error"))
