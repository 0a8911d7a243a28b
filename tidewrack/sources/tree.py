"""A file tree as a table, by a Python data source: names that start with a dot or underscore and empty files included.

Option `path` is the root (on a store that all executors mount), `maxBytes` the largest file read, `withContent` whether
content is read, `withHash` whether `sha256` of a file's bytes is a column too, `partitions` the number of read tasks. Ignored
directories are not entered.

The driver lists the root and, while there are fewer subtrees than tasks, some directories below; subtrees are walked by the
tasks. Filters on `relative` reach the source: of named files (=, in) no directory is listed, and a prefix skips subtrees.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from ..functions.columns import IGNORED_DIRS

#: Directories that the driver lists at most to find subtrees for the tasks.
LISTED = 64
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class _Part(InputPartition):
    def __init__(self, names, trees):
        self.names, self.trees = names, trees


def _inside(name: str) -> bool:
    parts = name.split("/")
    return bool(name) and not name.startswith("/") and "\\" not in name and not any(x in ("", ".", "..") for x in parts) and not any(x in IGNORED_DIRS for x in parts[:-1])


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.realpath(options["path"])
        self.most = int(options.get("maxBytes", "200000"))
        on = lambda k, d: str(options.get(k, d)).lower() == "true"
        self.content, self.hash = on("withContent", "true"), on("withHash", "false")
        self.parts = max(1, int(options.get("partitions", "8")))
        self.names: set[str] | None = None
        self.prefix = ""

    def pushFilters(self, filters):
        for f in filters:
            got = None
            if isinstance(f, EqualTo) and f.attribute == ("relative",):
                got = {f.value}
            elif isinstance(f, In) and f.attribute == ("relative",):
                got = set(f.value)
            if got is not None:
                got.discard(None)
                self.names = got if self.names is None else self.names & got
                continue
            if isinstance(f, StringStartsWith) and f.attribute == ("relative",) and (f.value.startswith(self.prefix) or self.prefix.startswith(f.value)):
                self.prefix = max(self.prefix, f.value, key=len)
            yield f  # Spark looks at the rows too

    def _list(self, tree: str) -> tuple[list[str], list[str]]:
        """Names of files and of directories to enter, below one directory."""
        files, trees = [], []
        try:
            with os.scandir(os.path.join(self.root, tree)) as entries:
                for e in sorted(entries, key=lambda x: x.name):
                    name = f"{tree}/{e.name}" if tree else e.name
                    if e.is_symlink():
                        continue
                    if e.is_dir():
                        if e.name not in IGNORED_DIRS and (f"{name}/".startswith(self.prefix) or self.prefix.startswith(f"{name}/")):
                            trees.append(name)
                    elif name.startswith(self.prefix):
                        files.append(name)
        except OSError:
            pass
        return files, trees

    def partitions(self):
        if self.names is not None:
            names, trees = sorted(n for n in self.names if _inside(n) and n.startswith(self.prefix)), []
        else:
            # breadth first, until there are subtrees for all tasks
            names, trees, listed = [], [""], 0
            while trees and listed < LISTED and len(trees) < 4 * self.parts:
                more, below = self._list(trees.pop(0))
                names, trees, listed = names + more, trees + below, listed + 1
        n = max(1, min(self.parts, len(names) + len(trees)))
        return [_Part(names[k::n], trees[k::n]) for k in range(n)]

    def _names(self, part):
        yield from part.names
        todo = list(reversed(part.trees))
        while todo:
            files, trees = self._list(todo.pop())
            yield from files
            todo += reversed(trees)

    def read(self, part):
        for name in self._names(part):
            full = os.path.join(self.root, name)
            try:
                if os.path.realpath(full) != full or not os.path.isfile(full) or os.path.getsize(full) > self.most:
                    continue
                size, text, sha = os.path.getsize(full), None, None
                if self.content or self.hash:
                    with open(full, "rb") as f:
                        data = f.read()
                    size, text = len(data), data.decode("utf-8", "replace") if self.content else None
                    sha = hashlib.sha256(data).hexdigest()
                yield (name, size, text, sha) if self.hash else (name, size, text)
            except OSError:
                continue


class Tree(DataSource):
    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return "relative string, size bigint, content string" + (", sha256 string" if str(self.options.get("withHash", "false")).lower() == "true" else "")

    def reader(self, schema):
        return _Reader(self.options)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(Tree)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("tree").options(path=path, **options).load()


def changed_names(path: str, base: str) -> list[str]:
    """Names that differ from a git base (added, copied, modified, renamed); without the base, what is unstaged or staged."""
    import subprocess

    def diff(*args):
        p = subprocess.run(["git", "-C", path, "diff", "--name-only", "-z", "--diff-filter=ACMR", *args], capture_output=True, text=True)
        return [x for x in p.stdout.split("\0") if x] if p.returncode == 0 else None

    got = diff(base)
    got = (diff() or []) + (diff("--cached") or []) if got is None else got
    return sorted(set(got))


def read_changed(spark: SparkSession, path: str, base: str, **options) -> DataFrame:
    """The files of a difference: only these are opened, and no directory is listed."""
    from pyspark.sql import functions as F

    names = changed_names(path, base)
    d = read(spark, path, **options)
    return d.where(F.col("relative").isin(*names)) if names else d.where("false")
