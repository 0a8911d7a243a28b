"""Mixing sources to target weights by weighted fair queueing.

Main path: DataFrame functions only.

Every document gets a place in its source's shuffled order; a copy's virtual finish time is the source's tokens up to
and with it, divided by the source's target. All copies in order of finish time, cut at the total budget, are the mix.
A source's running sums go in three steps (sums of coarse buckets, of buckets, then order within a bucket), so that no source
meets in one task; the number of buckets follows the number of rows, so that a bucket has about BUCKET of them at any size.
The copies are range-sorted by finish time into a table, whose running sums are sums of partitions and then within each.

Defined cases: a null text has size 0 and is taken with 0 words; a null source is a source of its own, last in order;
rows with equal keys are ordered by doc_id, and equal rows are told apart by nothing and treated alike; an empty table
gives an empty mix; columns other than doc_id, source and text play no part.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import ranged, running
from .common import bounded, cut, last, n_words, table

#: Weights of the sources in code point order, repeating; copies of a document at most.
WEIGHTS, COPIES = (5, 2, 1), 3
SEED = "mix-1"
#: Rows that a bucket of running sums is meant for.
BUCKET = 2048
#: Sources, and buckets, whose one row each is broadcast.
SOURCES, SUMS = 100_000, 200_000


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def targets(base: DataFrame, weights=WEIGHTS, copies: int = COPIES) -> DataFrame:
    """source, source_size, total, target: shares by weight, capped at `copies` times the size, the excess reshared by weight.

    One row for each source; the sources are ordered by the weight-relative cap, where the cap binds for a leading run of them.
    """
    per = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    every, by = Window.partitionBy(F.lit(0)), F.col("cap") / F.col("weight")
    order = Window.partitionBy(F.lit(0)).orderBy(by, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("cap", F.col("source_size") * copies).select(
        "source", "source_size", "weight", "cap", F.sum("source_size").over(every).alias("total"),
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order), F.lit(0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0))).alias("open_weight"),
    )
    # the level is that of the first source in order whose cap is above it
    level = F.min_by(F.struct("left", "open_weight"), F.when(F.col("cap") * F.col("open_weight") > F.col("left") * F.col("weight"), by)).over(every)
    per = per.withColumn("level", level)
    share = F.col("level.left").cast("double") * F.col("weight") / F.col("level.open_weight")
    return per.select("source", "source_size", "total", F.when(share < F.col("cap"), share).otherwise(F.col("cap").cast("double")).alias("target"))


def _buckets(rows: int) -> int:
    """A square power of two: buckets for so many rows."""
    k = 0
    while BUCKET << 2 * k < rows:
        k += 1
    return 1 << 2 * k


def _below(df: DataFrame, part: list[str], bucket: str, buckets: int, size: str) -> DataFrame:
    """df with `below`: the sum of size over the rows of part in lower buckets. Bucket numbers are 0 up to a few times `buckets`."""
    side = math.isqrt(buckets)
    low = Window.partitionBy(*part, "coarse").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    high = Window.partitionBy(*part or [F.lit(0)]).orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*part, bucket).agg(F.sum(size).alias("n")).withColumn("coarse", F.floor(F.col(bucket) / side))
    fine = sums.select(*[F.col(c).alias(f"f_{c}") for c in (*part, bucket)], F.col("coarse").alias("f_coarse"), F.coalesce(F.sum("n").over(low), F.lit(0)).alias("f_below"))
    wide = sums.groupBy(*part, "coarse").agg(F.sum("n").alias("n"))
    wide = wide.select(*[F.col(c).alias(f"w_{c}") for c in (*part, "coarse")], F.coalesce(F.sum("n").over(high), F.lit(0)).alias("w_below"))
    on = lambda a, b, names: reduce(lambda x, c: x & F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}")), names, F.lit(True))
    all_ = fine.join(wide, on("f_", "w_", [*part, "coarse"])).select(*[f"f_{c}" for c in (*part, bucket)], (F.col("f_below") + F.col("w_below")).alias("below"))
    all_ = F.broadcast(all_) if bounded(all_, SUMS) else all_
    return df.join(all_, on("", "f_", [*part, bucket])).drop(*[f"f_{c}" for c in (*part, bucket)])


def weighted_mix(base: DataFrame, per: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix: doc_id, source, size, copy (0 up), finish, upto (tokens of the mix up to and with this copy), part and place in order.

    base: doc_id, source, size, a table that is cheap to read again; per: as targets() gives.
    """
    buckets = _buckets(base.count())
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = base.select("doc_id", "source", "size", key.alias("key"))
    # the first 48 bits of the key in equal parts: buckets in the key's order
    d = d.withColumn("lot", F.floor(F.conv(F.substring("key", 1, 12), 16, 10).cast("long") / ((1 << 48) // buckets)))
    d = _below(d, ["source"], "lot", buckets, "size")
    within = Window.partitionBy("source", "lot").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("place", F.col("below") + F.sum("size").over(within)).drop("below", "lot")
    t = per.select(F.col("source").alias("t_source"), "source_size", "target", "total")
    t = F.broadcast(t) if bounded(per, SOURCES) else t
    d = d.join(t, d.source.eqNullSafe(t.t_source)).drop("t_source")
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"))
    finish = F.when(F.col("target") > 0, (F.col("copy") * F.col("source_size") + F.col("place")).cast("double") / F.col("target")).otherwise(F.lit(0.0))
    d = d.select("doc_id", "source", "size", "copy", "key", "total", finish.alias("finish"))
    order = [F.col("finish"), F.col("source").asc_nulls_last(), *map(F.col, ("copy", "key", "doc_id", "size"))]
    table = ranged(d, *order)
    m = running(table, F.col("size")).where("upto <= total")
    return last(m.select("doc_id", "source", "size", "copy", "finish", "upto", "part", "place"), "mixed", table)


def mix(docs: DataFrame) -> DataFrame:
    """The mix of all documents in order of finish time: doc_id, source, size, copy, finish, upto."""
    base = cut(sizes(docs), "sizes")
    return weighted_mix(base, targets(base)).orderBy("part", "place").drop("part", "place")


def taken(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken."""
    base = cut(sizes(docs), "sizes")
    per = cut(targets(base), "targets")
    mixed = weighted_mix(base, per)
    got = mixed.groupBy("doc_id", "source", "size").agg(F.sum("size").alias("t"), F.count("*").alias("c"))
    same = base.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    g = got.select(F.col("doc_id").alias("g_id"), F.col("source").alias("g_source"), F.col("size").alias("g_size"), "t")
    s = same.join(g, same.doc_id.eqNullSafe(g.g_id) & same.source.eqNullSafe(g.g_source) & (same["size"] == g.g_size), "left")
    # equal rows: the copies taken are dealt to them in turn, the first ones getting one more
    s = s.select("doc_id", "source", "size", F.coalesce("t", F.lit(0)).alias("t"), "rows", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("nth"))
    copies = F.when(F.col("size") > 0, F.floor(F.col("t") / F.greatest("size", F.lit(1)))).otherwise(F.lit(0))
    s = s.withColumn("taken", (F.floor(copies / F.col("rows")) + (F.col("nth") <= copies % F.col("rows")).cast("long")) * F.col("size"))
    t = per.select(F.col("source").alias("t_source"), "source_size", "target")
    t = F.broadcast(t) if bounded(per, SOURCES) else t
    out = s.join(t, s.source.eqNullSafe(t.t_source)).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "source")
    return last(out, "mix", base, per, mixed)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () AS total,
         sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight
       FROM s1 WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT rest::DOUBLE AS rest, open_weight FROM s2 WHERE cap * open_weight > rest * weight ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, total, CASE WHEN lvl.rest * weight / lvl.open_weight < cap THEN lvl.rest * weight / lvl.open_weight ELSE cap::DOUBLE END AS target
      FROM s2 LEFT JOIN lvl ON true),
p AS (SELECT base.*, source_size, target, total, sum(size) OVER (PARTITION BY base.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS place
      FROM base JOIN t ON base.source IS NOT DISTINCT FROM t.source),
f AS (SELECT p.*, c.range AS copy, CASE WHEN target > 0 THEN (c.range * source_size + place)::DOUBLE / target ELSE 0.0 END AS finish FROM p CROSS JOIN range(3) c),
u AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, copy, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM f)
SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(sum(size) FILTER (upto <= total), 0)::BIGINT AS taken
FROM u GROUP BY doc_id, source, size, source_size, target
"""
