"""An index that is kept up by differences: immutable segments of hash-bucketed postings, with tombstones.

A version of the index is a manifest, a small file that names its segments from old to new. A segment has the postings of the
files that one difference added or changed (as lists, in a folder for each bucket of terms, in files sorted by term), their
lengths, and tombstones: the paths whose older entries are dead. Applying a difference reads the changed files and writes one
segment; nothing that is there is read or rewritten. Reading merges: an entry counts if no newer segment has its path among
the tombstones. Segments of a level are merged once there are FAN of them, so that an entry is rewritten once a level,
and readers meet FAN segments a level at most.

Manifests are numbered, and one writer gets a number: whoever finds it taken starts again from the newer version. Readers keep
the version that they have opened; `sweep` deletes segments that only older versions name.

Defined cases: a difference without changed or deleted files makes no version; a file that changes and then goes is
dead; blank files have no entry; a path that is told twice in one difference is indexed once for each row of files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import bounded, cut, drop_cut, free_shuffles, hadoop, names, put_if_absent, read_small
from . import search

#: Buckets of terms, and segments of a level that are merged into one of the next.
BUCKETS, FAN = 64, 8
#: Portions of its buckets that a merge shuffles one after another.
PORTIONS = 4
POSTINGS = f"{search.LISTS}, bucket int"


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _lookup(df: DataFrame) -> DataFrame:
    """The small side of a join with texts or postings: broadcast, or hashed by partition, so that those aren't sorted."""
    return F.broadcast(df) if bounded(df) else df.hint("shuffle_hash")


class SegmentIndex:
    """Folder: manifests/<number>.json ({"buckets", "segments": [[name, level], ...]}), segments/<name>/{postings, docs, dead}."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.folder, self.fan = spark, folder.rstrip("/"), fan
        self.number, self.segments, self.buckets = 0, [], buckets
        self.refresh()

    def refresh(self) -> SegmentIndex:
        """Open the newest version."""
        have = [int(n.removesuffix(".json")) for n in names(self.spark, f"{self.folder}/manifests") if n.removesuffix(".json").isdigit()]
        if have:
            self.number = max(have)
            m = json.loads(read_small(self.spark, f"{self.folder}/manifests/{self.number:09}.json"))
            self.segments, self.buckets = [tuple(x) for x in m["segments"]], m["buckets"]
        return self

    def _publish(self, segments: list[tuple[str, int]]) -> bool:
        text = json.dumps({"buckets": self.buckets, "segments": segments})
        if not put_if_absent(self.spark, f"{self.folder}/manifests/{self.number + 1:09}.json", text):
            return False
        self.number, self.segments = self.number + 1, segments
        return True

    def _write(self, lists: Iterable[DataFrame], docs: DataFrame, dead: DataFrame) -> str:
        """Write a segment; lists: its postings, in one or more portions that have no bucket in common."""
        name = uuid.uuid4().hex
        for part in lists:
            # a bucket of more than the advisory size of a partition is written by several tasks
            p = part.withColumn("bucket", bucket_of(F.col("term"), self.buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
            p.write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/segments/{name}/postings")
        docs.write.parquet(f"{self.folder}/segments/{name}/docs")
        dead.select("path").distinct().write.parquet(f"{self.folder}/segments/{name}/dead")
        return name

    def apply(self, files: DataFrame, diff: DataFrame, **options) -> bool:
        """Bring the index in step with a fingerprint diff (path, status); files: relative, content. False if nothing has changed."""
        # several steps read it: texts are hashed once
        diff = cut(diff.where("status in ('added', 'changed', 'deleted')").select("path", "status"), "difference")
        fresh = diff.where("status in ('added', 'changed')").select(F.col("path").alias("relative")).distinct()
        if diff.isEmpty():
            drop_cut(diff)
            return False
        fresh = _lookup(fresh)
        # of more than a broadcast, the paths are looked at first: texts stay where they are if all of them are new
        every = not bounded(fresh) and files.select("relative").join(fresh, "relative", "left_anti").isEmpty()
        changed = files if every else files.join(fresh, "relative", "left_semi")
        lists, docs = search.build(changed, packed=True, **options)
        name = self._write([lists], docs, diff)
        drop_cut(diff)
        # the same segment serves any version: it names no other
        while not self._publish([*self.segments, (name, 0)]):
            self.refresh()
        self.compact()
        return True

    def _read(self, part: str, segments: list[tuple[str, int]], schema: str) -> DataFrame:
        """Rows of some segments with `seg`, the place of theirs in age."""
        out = None
        for k, (name, _) in enumerate(segments):
            d = self.spark.read.schema(schema).parquet(f"{self.folder}/segments/{name}/{part}").withColumn("seg", F.lit(k))
            out = d if out is None else out.unionByName(d)
        return self.spark.createDataFrame([], f"{schema}, seg int") if out is None else out

    def _alive(self, d: DataFrame, segments: list[tuple[str, int]]) -> DataFrame:
        """Rows of d whose path no newer segment has buried; those of the newest segment need no look."""
        newest = d.where(F.col("seg") >= len(segments) - 1).drop("seg")
        if len(segments) < 2:
            return newest
        d = d.where(F.col("seg") < len(segments) - 1)
        dead = self._read("dead", segments[1:], "path string").groupBy(F.col("path").alias("d_path")).agg((F.max("seg") + 1).alias("until"))
        old = d.join(_lookup(dead), d.path == F.col("d_path"), "left").where(F.coalesce(F.col("seg") >= F.col("until"), F.lit(True)))
        return old.drop("seg", "d_path", "until").unionByName(newest)

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """term, path, tf, at: all of them, or those of some terms, for which only their buckets' folders are read."""
        d = search.unpack(self._read("postings", self.segments, POSTINGS))
        if terms is not None:
            sums = self.spark.range(1).select(F.explode(F.array(*[bucket_of(F.lit(t), self.buckets) for t in terms])).alias("b")).collect()
            d = d.where(F.col("bucket").isin(sorted({r["b"] for r in sums})) & F.col("term").isin(*terms))
        return self._alive(d.drop("bucket"), self.segments)

    def docs(self) -> DataFrame:
        """path, len of the files that are indexed."""
        return self._alive(self._read("docs", self.segments, "path string, len long"), self.segments)

    def query(self, terms: list[list[str]], k: int = 5) -> DataFrame:
        return search.query(self.postings(sorted({w for t in terms for w in t})), self.docs(), terms, k)

    def compact(self) -> int:
        """Merge runs of `fan` neighbours of one level until there is none; how many merges were published.

        A merged segment keeps the tombstones that older ones need, and drops what its own parts have buried.
        """
        done = 0
        while run := self._run():
            lo, hi = run
            parts, level = self.segments[lo:hi], self.segments[lo][1]
            dead = self._read("dead", parts, "path string").drop("seg")
            docs = self._alive(self._read("docs", parts, "path string, len long"), parts)
            name = self._write(self._merged(parts), docs, dead if lo else dead.limit(0))
            while not self._publish([*self.segments[:lo], (name, level + 1), *self.segments[hi:]]):
                self.refresh()
                at = [k for k in range(len(self.segments)) if self.segments[k : k + len(parts)] == parts]
                if not at:  # another writer has merged them
                    return done
                lo, hi = at[0], at[0] + len(parts)
            done += 1
        return done

    def _merged(self, parts: list[tuple[str, int]]) -> Iterator[DataFrame]:
        """The postings of some segments as lists of one, a portion of the buckets at a time; what was shuffled before goes first."""
        n = min(PORTIONS, self.buckets)
        for k in range(n):
            free_shuffles(self.spark)
            some = self._read("postings", parts, POSTINGS).where(F.col("bucket").isin(list(range(k, self.buckets, n))))
            yield search.pack(self._alive(search.unpack(some), parts))

    def _run(self) -> tuple[int, int] | None:
        for lo in range(len(self.segments)):
            hi = lo
            while hi < len(self.segments) and self.segments[hi][1] == self.segments[lo][1]:
                hi += 1
            if hi - lo >= self.fan:
                return lo, lo + self.fan
        return None

    def sweep(self, keep: int = 1) -> int:
        """Delete segments and manifests that the newest `keep` versions don't name; nobody may read older ones then."""
        numbers = sorted(int(n.removesuffix(".json")) for n in names(self.spark, f"{self.folder}/manifests") if n.endswith(".json"))
        text = [json.loads(read_small(self.spark, f"{self.folder}/manifests/{n:09}.json")) for n in numbers[-keep:]]
        named = {s[0] for m in text for s in m["segments"]}
        gone = [n for n in names(self.spark, f"{self.folder}/segments") if n not in named]
        for path in [*(f"manifests/{n:09}.json" for n in numbers[:-keep]), *(f"segments/{n}" for n in gone)]:
            fs, p = hadoop(self.spark, f"{self.folder}/{path}")
            fs.delete(p, True)
        return len(gone)
