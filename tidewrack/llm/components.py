"""Connected components of links, by alternating large-star and small-star steps (no task or driver sees a whole component)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, last


def _sum(df: DataFrame):
    return df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long, a <> b, not null) to (id, component): the smallest id that each linked id reaches."""
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while before != (now := _sum(edges)):
        before = now
        # large star: every larger neighbour of a is tied to a's smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        old, edges = edges, cut(small, "links")
        drop_cut(old)
    low = edges.groupBy("b").agg(F.lit(1)).select(F.col("b").alias("id"), F.col("b").alias("component"))
    return last(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(low), "components", edges)
