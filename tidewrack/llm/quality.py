"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the whole corpus.

Main path: DataFrame functions only.

Defined cases: a null, empty or blank text has no words and fails the base rules; with no trusted row, or for a
document without n-grams, the ratio is null and the verdict is true; repeated rows are judged each; columns other
than doc_id and text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, bounded, table, words

#: Buckets of the two multinomials (a power of two), and characters of a word's end that stand for it.
BUCKETS, ENDING = 1 << 14, 3
#: Mean log ratio an n-gram (in nats) below which a document is rejected.
THRESHOLD = -0.08
SCALE = 1_000_000
WINDOW = 8


def _shifted(c: str, by: int) -> Column:
    """The array without its first elements."""
    return F.slice(c, 1 + by, F.greatest(F.size(c) - by, F.lit(0)))


def _pairs(d: DataFrame, out: str, c: str, by: int) -> DataFrame:
    """`out`: hash of each element with the one `by` places on; as many fewer elements."""
    return d.withColumn(out, F.slice(F.zip_with(c, _shifted(c, by), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(c) - by, F.lit(0))))


def base_columns(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key column, w (words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(key, words(F.col("text")).alias("w"), (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"), lines.alias("lines"))
    d = d.select(key, "w", "n_symbols", F.length(F.array_join("w", "")).cast("long").alias("word_chars"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    # windows of 2, 4 and 8 words, each from two of the size before
    d = _pairs(_pairs(_pairs(d, "h2", "w", 1), "h4", "h2", 2), "wins", "h4", 4).drop("h2", "h4")
    # only texts with an equal pair of windows sort them
    repeats = F.size(F.array_distinct("wins")) < F.size("wins")
    d = d.withColumn("s", F.when(repeats, F.array_sort(F.transform("wins", lambda x, i: F.struct(x.alias("v"), i.alias("p"))))))
    same = lambda a, b: a.getField("v").eqNullSafe(b.getField("v"))
    d = d.withColumn("at", F.array_sort(F.transform(
        F.filter(F.transform("s", lambda x, i: F.struct(x.getField("p").alias("p"), (same(x, F.get("s", i - 1)) | same(x, F.get("s", i + 1))).alias("dup"))), lambda x: x.getField("dup")),
        lambda x: x.getField("p"))))
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    d = d.select(key, "w", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _with_grams(d: DataFrame) -> DataFrame:
    """`g`, `g2`: hashes of the word endings and of neighbouring endings; their low bits are the bucket."""
    return _pairs(d.withColumn("g", F.transform("w", lambda x: F.xxhash64(F.substring(x, -ENDING, ENDING)))), "g2", "g", 1)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: `ratios`, for each bucket round(1e6 * log(trusted share / corpus share)), add-one smoothed; null without trusted rows.

    docs: doc_id, text; trusted: doc_id of the target. Counts cover every document.
    """
    ids = trusted.select(F.col("doc_id").alias("id")).where("id is not null").distinct()
    flagged = docs.select("doc_id", words(F.col("text")).alias("w"))
    flagged = flagged.join(F.broadcast(ids) if bounded(ids) else ids, flagged.doc_id == ids.id, "left").select(F.col("id").isNotNull().cast("long").alias("t"), "w")
    g = _with_grams(flagged).select("t", F.explode(F.concat("g", "g2")).alias("b"))
    counts = g.groupBy(F.col("b").bitwiseAND(buckets - 1).cast("int").alias("b")).agg(F.count("*").alias("n"), F.sum("t").alias("t"))
    # one small row for each bucket; their number is the parameter
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    full = every.join(counts, "b", "left").select("b", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("t", F.lit(0)).alias("t"))
    one = full.agg(F.array_sort(F.collect_list(F.struct("b", "n", "t"))).alias("c"), F.sum("n").alias("all_n"), F.sum("t").alias("all_t"))
    log = lambda x, total: F.log((x + 1).cast("double") / (total + buckets).cast("double"))
    return one.select(F.when(F.col("all_t") > 0, F.transform("c", lambda x: F.round((log(x.getField("t"), F.col("all_t")) - log(x.getField("n"), F.col("all_n"))) * SCALE).cast("long"))).alias("ratios"))


def score(d: DataFrame, ratios: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """d with `llr`: mean log ratio of its n-grams, an exact sum of whole millionths divided once."""
    d = _with_grams(d).withColumn("r", ratios.scalar())
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + F.get("r", b.bitwiseAND(buckets - 1)))
    n = F.size("g") + F.size("g2")
    return d.withColumn("llr", F.when(n > 0, (total("g") + total("g2")) / n / SCALE)).drop("g", "g2", "r")


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, key: str = "doc_id") -> DataFrame:
    """Every document with its rule columns, `llr`, and `kept`: base rules hold and the ratio reaches the threshold."""
    d = score(base_columns(docs.select(key, "text"), key), log_ratios(docs.select("doc_id", "text"), trusted, buckets), buckets).drop("w")
    return d.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(True)))


def accepted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns; their texts are not shuffled."""
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("tidewrack_row"))
    # not a filter: Catalyst would copy the whole judgement into its condition, term by term
    row = F.explode(F.when(F.col("kept"), F.array("tidewrack_row"))).alias("row")
    return judge(whole, trusted, key="tidewrack_row").select(row).select("row.*")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )
