"""Pieces that several training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import pathlib
import tempfile
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import BROADCAST_ROWS, bounded, cut, drop_cut, last, maybe_broadcast, shared_dir  # noqa: F401

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD_GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def n_words(text: Column) -> Column:
    """Number of words of a text, without an array of them; null gives 0."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return (F.length(marks) - F.length(F.replace(marks, F.lit("x"), F.lit("")))).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return what a Python worker has freed to the system: it waits, idle, beside the executor's heap for its next task."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(batches: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a partition's batches that gives its memory back at the end."""

    @functools.wraps(batches)
    def run(it):
        try:
            yield from batches(it)
        finally:
            give_back()

    return run


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that they can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = pathlib.Path(__file__).resolve().parents[1]
        name = f"{tempfile.mkdtemp(prefix='tidewrack-')}/{root.name}.zip"
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(name)
