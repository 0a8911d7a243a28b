"""Stages of a corpus pipeline: (spark, docs, sf_dir) to a DataFrame. All but the last return the columns of docs.

Each stage calls one operator; its decisions take effect on whole rows. Ids of decided documents are broadcast only up to
a checked number of rows; beyond it the join is shuffled.

Defined cases: null, empty and blank texts fail the quality rules, and pass the other filters, but have no words that a mix
could take; rows without doc_id are judged like others, but are nobody's near-duplicate; of equal rows near-dedup keeps one,
and rows of one id with different texts are different documents; an empty table gives an empty one; extra columns are kept
as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import decontaminate, mixing, near, quality, tokens
from .common import cut, last, maybe_broadcast, n_words, table


def whole(docs: DataFrame) -> Column:
    """A row's columns in one struct."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the likelihood ratio."""
    return quality.accepted(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (the smallest id); of equal rows one, rows without id all.

    A document is known by its id and its text's hash, so rows of one id with other texts are other documents.
    """
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    # rows without id stay out: in pandas a null would make the batch's keys floats, which lose digits
    out = near.near_duplicates(docs.where("doc_id is not null").select(key.alias("doc_id"), "text"))
    groups = maybe_broadcast(out.where("not kept").select(F.col("component_id").alias("g")).distinct())
    members = cut(out.join(groups, out.component_id == groups.g, "left_semi").select(F.col("doc_id").alias("m_key"), "component_id").distinct(), "members")
    ids = docs.select("doc_id", key.alias("key"))
    named = ids.join(maybe_broadcast(members), F.col("key") == F.col("m_key"))
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.key")
    gone = maybe_broadcast(last(members.join(first, F.col("m_key") == F.col("key"), "left_anti").select(F.col("m_key").alias("gone_key")), "gone", members))
    many = maybe_broadcast(out.groupBy(F.col("doc_id").alias("many_key")).agg(F.count("*").alias("n")).where("n > 1").select("many_key"))
    # documents' own columns travel in one struct, so that their names clash with nothing
    d = docs.select(key.alias("key"), whole(docs).alias("row"))
    left = d.join(gone, F.col("key") == F.col("gone_key"), "left_anti")
    once = left.join(many, F.col("key") == F.col("many_key"), "left_anti")
    again = left.join(many, F.col("key") == F.col("many_key"), "left_semi")
    nth = F.row_number().over(Window.partitionBy("key", "row.doc_id", "row.text").orderBy("key"))
    again = again.withColumn("nth", nth).where("nth = 1")
    return once.select("row").unionByName(again.select("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item. A document is known by its id and its text's hash."""
    key = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    found = decontaminate.overlaps(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = maybe_broadcast(cut(found.select(F.col("doc_id.doc_id").alias("bad_id"), F.col("doc_id.hash").alias("bad_hash")).distinct(), "leaks"))
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.bad_id) & (F.xxhash64(docs.text) == bad.bad_hash), "left_anti")


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy that it takes. Documents without words are not taken.

    Rows of one id, source and size are told apart by nothing that the mix looks at; they share the copies, the first ones
    (by text) getting one more.
    """
    base = cut(mixing.sizes(docs), "sizes")
    per = cut(mixing.targets(base), "targets")
    mixed = mixing.weighted_mix(base, per)
    got = mixed.groupBy("doc_id", "source", "size").agg(F.count("*").alias("c"))
    rows = base.where("size > 0").groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    rows = rows.withColumnsRenamed({"doc_id": "r_id", "source": "r_source", "size": "r_size"})
    same = F.col("doc_id").eqNullSafe(F.col("r_id")) & F.col("source").eqNullSafe(F.col("r_source")) & (F.col("size") == F.col("r_size"))
    m = last(got.join(rows, same).select("r_id", "r_source", "r_size", "c", "n"), "taken", base, per, mixed)
    d = docs.select(whole(docs).alias("row"), n_words(F.col("text")).alias("size"))
    same = F.col("row.doc_id").eqNullSafe(F.col("r_id")) & F.col("row.source").eqNullSafe(F.col("r_source")) & (F.col("size") == F.col("r_size"))
    once = d.join(maybe_broadcast(m.where("n = 1")), same).select("row", F.col("c").alias("k"))
    nth = F.row_number().over(Window.partitionBy("r_id", "r_source", "r_size").orderBy("row.text"))
    again = d.join(maybe_broadcast(m.where("n > 1")), same).select("row", "c", "n", nth.alias("nth"))
    again = again.select("row", (F.floor(F.col("c") / F.col("n")) + (F.col("nth") <= F.col("c") % F.col("n")).cast("long")).alias("k")).where("k > 0")
    return once.unionByName(again).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("copy")).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all rows written as frames and read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.round_trip(docs)
