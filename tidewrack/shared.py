"""Tables in the folder that driver and executors share, and joins that follow a checked size."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a lookup side (ids, seeds, filter words) up to which it is broadcast; beyond it a shuffled join is used.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode, where none is configured, a temporary one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="tidewrack-")
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path on any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back: later steps don't recompute it and lost executors don't matter."""
    path = f"{shared_dir(df.sparkSession)}/tidewrack/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop_cut(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing reads them any more; others are left alone."""
    for df in tables:
        if path := _paths.pop(df, None):
            fs, p = hadoop(df.sparkSession, path)
            fs.delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of finished queries' shuffle files, which Spark keeps until the driver's JVM happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def last(df: DataFrame, what: str, *tables: DataFrame) -> DataFrame:
    """cut(df), after which the tables that it was made of are deleted."""
    out = cut(df, what)
    drop_cut(*tables)
    return out


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if df has at most so many rows (reads no more than limit + 1 of them)."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its size has been checked, else as it is (a shuffled join follows)."""
    return F.broadcast(df) if bounded(df, limit) else df


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file with its whole content, unless there is one of this name: of any number of writers one gets True.

    Written aside first; on a local disk a hard link gives the name, elsewhere a rename, which a distributed file system
    refuses where the name is taken.
    """
    fs, p = hadoop(spark, path)
    aside = f"{path}.{uuid.uuid4().hex}"
    fs.mkdirs(p.getParent())
    local = fs.getUri().getScheme() == "file"
    name = lambda x: hadoop(spark, x)[1].toUri().getPath()
    if local:
        with open(name(aside), "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(name(aside), name(path))
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(name(aside))
    out = fs.create(hadoop(spark, aside)[1], False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    done = not fs.exists(p) and fs.rename(hadoop(spark, aside)[1], p)
    if not done:
        fs.delete(hadoop(spark, aside)[1], False)
    return done


def read_small(spark: SparkSession, path: str) -> str | None:
    """Text of a small file; None if there is none."""
    fs, p = hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    fs, p = hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
