"""Versioned snapshots, append-only logs and remote names.

A version is a folder, written whole, and a small numbered file that names it; one writer gets a number. Whoever replaces a
table gets the next free one; an upsert that finds its number taken starts again from the newer version, so that no
writer's rows are lost.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import names, put_if_absent, read_small


class Store:
    """Tables `fingerprints`, `report` and `pointer` are replaced by version; `runs`, `feedback` and `ignore` are appended to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _last(self, table: str) -> int:
        """Number of the newest version, 0 if there is none."""
        return max((int(n) for n in names(self.spark, f"{self.folder}/{table}/versions") if n.isdigit()), default=0)

    def _commit(self, table: str, df: DataFrame, after: int) -> bool:
        """Write df as the version after one; False if another writer has that number."""
        data = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{table}/{data}")
        return put_if_absent(self.spark, f"{self.folder}/{table}/versions/{after + 1:09}", json.dumps({"data": data}))

    def _read(self, table: str, version: int) -> DataFrame | None:
        text = read_small(self.spark, f"{self.folder}/{table}/versions/{version:09}") if version else None
        return None if text is None else self.spark.read.parquet(f"{self.folder}/{table}/{json.loads(text)['data']}")

    def replace(self, table: str, df: DataFrame) -> int:
        """Write a new version; earlier ones stay readable, so df may read the last one."""
        while not self._commit(table, df, n := self._last(table)):
            pass
        return n + 1

    def latest(self, table: str) -> DataFrame | None:
        return self._read(table, self._last(table))

    def upsert(self, table: str, new: DataFrame, deleted: DataFrame | None = None, key: str = "path") -> int:
        """Rows of new over those of the last version by key, less deleted keys."""
        while True:
            n = self._last(table)
            old = self._read(table, n)
            out = new if old is None else old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)
            if self._commit(table, out if deleted is None else out.join(deleted.select(key), key, "left_anti"), n):
                return n + 1

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{table}/log")

    def log(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}/log")

    def save_report(self, issues: DataFrame, completed: bool, skipped: bool) -> bool:
        """Keep a report for reuse, if it is complete and was not skipped."""
        if completed and not skipped:
            self.replace("report", issues)
        return completed and not skipped


    def point(self, report: str) -> None:
        """Remember where the last report is."""
        self.replace("pointer", self.spark.range(1).select(F.lit(report).alias("json"), F.current_timestamp().alias("written_at")))

    def last_report(self) -> str | None:
        last = self.latest("pointer")
        return None if last is None else last.first()["json"]


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(n)


def slug(text: Column) -> Column:
    """owner/name of a repository slug or address; null if it is neither."""
    t = F.regexp_replace(F.trim(text), r"(?i)^(?:https?://[^/]+/|git@[^:]+:)", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\.git$", ""), r"^models/", "")
    return F.when(t.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*/[A-Za-z0-9][A-Za-z0-9._-]*$"), t)


# What names of repositories look like, and their addresses.
REPOSITORY = r"^([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?$"
HUB_ID = r"^(?:(datasets|spaces|models)/)?([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)$"
ADDRESSES = {"github": "https://github.com/{}.git", "bitbucket": "https://bitbucket.org/{}.git", "hub": "https://huggingface.co/{}"}


def repository(text: Column) -> Column:
    """owner/name, without a suffix `.git`; null if it is no such name."""
    t = F.trim(text)
    return F.when(t.rlike(REPOSITORY), F.regexp_replace(t, REPOSITORY, "$1/$2"))


def hub_id(text: Column) -> Column:
    """org/name of a model, datasets/org/name or spaces/org/name; null if it is no such id."""
    t = F.btrim(F.trim(text), F.lit("/"))
    kind = F.regexp_extract(t, HUB_ID, 1)
    name = F.regexp_replace(t, HUB_ID, "$2/$3")
    return F.when(t.rlike(HUB_ID), F.when(kind.isin("", "models"), name).otherwise(F.concat(kind, F.lit("/"), name)))


def address(kind: str, text: Column) -> Column:
    """Where a repository (kinds github, bitbucket) or hub id is cloned from; null if the name is none."""
    before, after = ADDRESSES[kind].split("{}")
    return F.concat(F.lit(before), hub_id(text) if kind == "hub" else repository(text), F.lit(after))


def source_kind(path: str | None = None, **remote: str | None) -> tuple[str, str]:
    """The one source that is given (path, git_url, github, bitbucket, hub); the present folder if none is."""
    given = [(k, v) for k, v in (("path", path), *remote.items()) if v]
    if len(given) > 1:
        raise ValueError(f"give one source only, not {[k for k, _ in given]}")
    return given[0] if given else ("path", ".")


def import_risks(before: Column, after: Column, roots: list[str]) -> Column:
    """Sorted distinct protected package roots whose imports were removed between two texts."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?m)^\s*(?:import|from)\s+([A-Za-z_]\w*)"), F.lit(1)))
    return F.array_sort(F.array_intersect(F.array_except(found(before), found(after)), F.array(*map(F.lit, roots))))
