"""Source divergence audit: how each source of a language differs from the language and from its other sources.

Terms are counted in one pass over the documents: a task adds up its documents' terms by language and source and passes its
sums on in bounded portions, so that a hot term or source is a row of each portion. Smoothed shares are whole billionths,
p = 1 + floor(1e9 * (count + 5) / (N + 5 * V)), in decimals; everything else is in whole numbers too.

Pairs of sources are sparse: a term that a source lacks has the source's base share b. For sources x and y the sum over
all V terms of |p_x - p_y| is
  V * |b_x - b_y|  +  sum over terms of x of (|p_x - b_y| - |b_x - b_y|)  +  the same for y
  + sum over the terms of both of (|p_x - p_y| - |p_x - b_y| - |b_x - p_y| + |b_x - b_y|);
the middle sums need only how often each share occurs in a source, the last one only terms that both have. Sums of a
block of pairs leave a task, not the pairs.

Terms are ranked by radix selection: histograms over ten bits of the value at a time, made on all tasks, give each
group's threshold; ties at it are refined by UTF-8 bytes, a few at a time, until few enough are left to be ordered.

Defined cases: a null text, lang or source is an empty one; a document without terms still makes its (lang, source) group
occur; without kept terms (V = 0) pairs have the value 0; repeated rows count each; rows without doc_id count like others;
ties of value are ordered by the item's UTF-8 bytes; an empty table gives an empty result; columns other than text, lang
and source play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, drop_cut, last, lean, ship, table

#: Documents of a language that a kept term is in at least, ranks of terms, smoothing, and the unit of shares.
LEAST, TOP, PRIOR, UNIT = 30, 50, 5, 1_000_000_000
#: Bits of a value that a histogram is over, values below 2 to the power of ROUNDS * BITS, bytes of a tie's refinement.
BITS, ROUNDS, BYTES = 10, 3, 2
#: Tied terms of a group that are put in order as they are.
FEW = 2_000
#: Different terms in a task's sums, and pairs in a block.
PORTION, BLOCK = 200_000, 1_000_000
#: Copies of the smaller side of a join by language that is not broadcast.
SALTS = 16
GROUP = ["lang", "source"]
_GAPS = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 0x20 for b in range(256))
#: Bytes of a text whose terms are listed at once; a longer text goes in pieces that end at a gap.
PIECE = 1 << 24


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, some at a time."""
    t, at = text.translate(_GAPS), 0
    while len(t) - at > PIECE:
        end = t.rfind(b" ", at, at + PIECE)
        end = end if end > at else t.find(b" ", at + PIECE)
        if end < 0:
            break
        yield t[at:end].split()
        at = end
    yield t[at:].split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text to lang, source, term, n, df; a null term for each group that occurs."""
    sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in sums.items():
            names = list(n)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * (len(names) + 1), pa.string()), "source": pa.array([source] * (len(names) + 1), pa.string()),
                    "term": pa.array([*(x.decode() for x in names), None], pa.string()), "n": pa.array([*n.values(), 0], pa.int64()), "df": pa.array([*(df[x] for x in names), 0], pa.int64()),
                }
            )
        sums.clear()

    held = 0
    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, df = sums.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for some in terms(text):
                n.update(some)
                seen.update(some)
            df.update(seen)
            held += len(n) - before
            if held > PORTION:
                yield from flush()
                held = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents); term null: the group occurs."""
    ship(docs.sparkSession)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    d = docs.select(empty("lang"), empty("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    part = d.mapInArrow(lean(_counts), "lang string, source string, term string, n long, df long")
    return part.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def kept_terms(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term (null: the sources that occur), n, sources (array of source and n, at most one of each)."""
    per = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return per.where(F.col("term").isNull() | (F.col("df") >= least)).select("lang", "term", "n", "sources")


def _share(n: str, total: str, v: str) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * v)), exact; 1 where nothing is kept."""
    below = f"(CAST({total} AS DECIMAL(19,0)) + {PRIOR} * {v})"
    return F.expr(f"CASE WHEN {v} = 0 THEN 1L ELSE 1L + (CAST({UNIT} AS DECIMAL(10,0)) * (CAST({n} AS DECIMAL(19,0)) + {PRIOR})) div {below} END")


def _by_lang(big: DataFrame, small: DataFrame, on: Column, salt: Column, limit: int) -> DataFrame:
    """big join small on a condition over `lang` and `o_lang`: broadcast up to `limit` rows, else a language is dealt out in salts."""
    if bounded(small, limit):
        return big.join(F.broadcast(small), on)
    small = small.withColumn("o_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(small, on & (F.col("salt") == F.col("o_salt"))).drop("salt", "o_salt")


def group_totals(kept: DataFrame) -> DataFrame:
    """lang, source, total (N of the group), v, lang_total, b (share of a term that the group lacks)."""
    g = kept.select("lang", F.explode("sources").alias("s")).select("lang", "s.source", "s.n")
    g = g.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    of = kept.groupBy(F.col("lang").alias("o_lang")).agg(F.sum("n").alias("lang_total"), F.count("term").alias("v"))
    g = g.join(of, g.lang == of.o_lang).drop("o_lang")
    return g.select(*GROUP, "total", "v", "lang_total", _share("0", "total", "v").alias("b"))


def shares(kept: DataFrame, totals: DataFrame, limit: int) -> DataFrame:
    """lang, source, term, p, q (the language's), b: a row for each kept term that a group has."""
    each = kept.where("term is not null").select("lang", "term", F.col("n").alias("lang_n"), F.explode("sources").alias("s")).select("lang", "term", "lang_n", "s.source", "s.n").where("n > 0")
    t = totals.select(F.col("lang").alias("o_lang"), F.col("source").alias("o_source"), "total", "v", "lang_total", "b")
    t = F.broadcast(t) if bounded(totals, limit) else t
    d = each.join(t, (each.lang == t.o_lang) & (each.source == t.o_source))
    return d.select(*GROUP, "term", _share("n", "total", "v").alias("p"), _share("lang_n", "lang_total", "v").alias("q"), "b")


def _blocks(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (left, right) of neighbours' places in lists of such lengths, left before right, about BLOCK at a time."""
    starts = np.concatenate(([0], np.cumsum(lengths)))
    ends = np.repeat(starts[1:], lengths)
    after = ends - np.arange(starts[-1]) - 1  # places behind one in its list
    upto = np.concatenate(([0], np.cumsum(after)))
    at = 0
    while at < len(after):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + BLOCK, "right")) - 1)
        for lo in range(0, max(1, int(after[at])) if to == at + 1 else 1, BLOCK):
            n = np.minimum(after[at:to] - lo, BLOCK) if to == at + 1 else after[at:to]
            left = np.repeat(np.arange(at, to), n)
            first = np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
            yield left, left + 1 + lo + np.arange(len(left)) - first
        at = to


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, sources (source, p, b by term) to lang, source, item, value: sums over the terms that both have."""
    for batch in batches:
        lists = batch.column("sources")
        lengths = np.diff(lists.offsets.to_numpy())
        x = lists.flatten()
        lang = batch.column("lang").dictionary_encode()
        source = x.field("source").dictionary_encode()
        code = np.repeat(lang.indices.to_numpy(), lengths).astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
        p, b = x.field("p").to_numpy(), x.field("b").to_numpy()
        used, code = np.unique(code, return_inverse=True)
        for i, j in _blocks(lengths):
            if len(i):
                i, j = np.where(code[i] < code[j], i, j), np.where(code[i] < code[j], j, i)
                v = np.abs(p[i] - p[j]) - np.abs(p[i] - b[j]) - np.abs(b[i] - p[j]) + np.abs(b[i] - b[j])
                keys, at = np.unique(code[i] * len(used) + code[j], return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, at, v)
                one, two = used[keys // len(used)], used[keys % len(used)]
                size = max(1, len(source.dictionary))
                take = lambda d, at: d.dictionary.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([take(lang, one // size), take(source, one % size), take(source, two % size), pa.array(sums)], ["lang", "source", "item", "value"])


def pairs(shared: DataFrame, totals: DataFrame, limit: int) -> DataFrame:
    """lang, source, item (another source of the language), value: the sum of |p - q| over all kept terms."""
    g = totals.select(*GROUP, "v", "b")
    other = g.select(F.col("lang").alias("o_lang"), F.col("source").alias("item"), F.col("b").alias("o_b"))
    on = (F.col("lang") == F.col("o_lang")) & (F.col("source") != F.col("item"))
    keys = ["lang", "source", "item"]
    base = _by_lang(g, other, on, F.col("source"), limit).select(*keys, (F.col("v") * F.abs(F.col("b") - F.col("o_b"))).alias("value"))
    often = shared.groupBy(*GROUP, "p", "b").agg(F.count("*").alias("n"))
    own = _by_lang(often, other, on, F.struct("source", "p"), limit)
    own = own.groupBy(*keys).agg(F.sum(F.col("n") * (F.abs(F.col("p") - F.col("o_b")) - F.abs(F.col("b") - F.col("o_b")))).alias("value"))
    lists = shared.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "b")).alias("sources")).where(F.size("sources") > 1).select("lang", "sources")
    both = lists.mapInArrow(lean(_both), "lang string, source string, item string, value long").groupBy(*keys).agg(F.sum("value").alias("value"))
    turned = lambda d: d.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    # each direction's own terms count for both, as do the terms that both have
    half = own.unionByName(both)
    every = base.unionByName(half).unionByName(turned(half)).groupBy(*keys).agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    return every.select(*GROUP, F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _join_groups(d: DataFrame, per: DataFrame, names: list[str], limit: int) -> DataFrame:
    """d with the columns `names` of per, which has a row for each group."""
    p = per.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *names)
    p = F.broadcast(p) if bounded(per, limit) else p
    return d.join(p, (d.lang == p.t_lang) & (d.source == p.t_source)).drop("t_lang", "t_source")


def _step(hist: DataFrame, by: Column) -> DataFrame:
    """hist: lang, source, need, bucket, n. The bucket in which the need is met, and what is needed of it (the last one, if it is met in none)."""
    w = Window.partitionBy(*GROUP).orderBy(by)
    h = hist.withColumn("upto", F.sum("n").over(w))
    met = F.struct(F.when(F.col("upto") >= F.col("need"), 0).otherwise(1).alias("late"), F.when(F.col("upto") >= F.col("need"), F.col("upto")).otherwise(-F.col("upto")).alias("o"))
    one = h.groupBy(*GROUP).agg(F.min_by(F.struct("bucket", (F.col("need") - F.col("upto") + F.col("n")).alias("need"), "n"), met).alias("x"))
    return one.select(*GROUP, F.col("x.bucket").alias("bucket"), F.least("x.need", "x.n").alias("need"), F.col("x.n").alias("left"))


def top_terms(found: DataFrame, top: int = TOP, few: int = FEW, limit: int = 100_000) -> DataFrame:
    """found: lang, source, item, value (a table that is cheap to read again). The `top` of each group by value, ties by bytes."""
    # thresholds by histograms over the value's bits, the high ones first
    made: list[DataFrame] = []
    at = found.groupBy(*GROUP).agg(F.lit(top).cast("long").alias("need")).withColumn("prefix", F.lit(0).cast("long"))
    for k in reversed(range(ROUNDS)):
        d = _join_groups(found, at, ["need", "prefix"], limit)
        d = d.where(F.shiftright("value", BITS * (k + 1)) == F.col("prefix"))
        bucket = F.shiftright("value", BITS * k)
        at = cut(_step(d.groupBy(*GROUP, "need", bucket.alias("bucket")).agg(F.count("*").alias("n")), F.desc("bucket")).withColumnRenamed("bucket", "prefix"), "radix")
        made.append(at)
    d = _join_groups(found, at.withColumnRenamed("prefix", "threshold"), ["need", "left", "threshold"], limit)
    sure = d.where("value > threshold").select(*GROUP, "item", "value")
    tied = d.where("value = threshold").select(*GROUP, "item", "value", "need", "left")
    # ties: histograms over the next bytes, until few are left in the bucket that holds the last rank
    depth = 0
    while not at.where((F.col("left") > few) & (F.col("left") > F.col("need"))).isEmpty():
        piece = F.substring(F.col("item").cast("binary"), depth * BYTES + 1, BYTES)
        at = cut(_step(tied.groupBy(*GROUP, "need", piece.alias("bucket")).agg(F.count("*").alias("n")), F.asc("bucket")), "radix")
        made.append(at)
        d = _join_groups(tied.drop("need", "left"), at, ["need", "left", "bucket"], limit)
        sure = sure.unionByName(d.where(piece < F.col("bucket")).select(*GROUP, "item", "value"))
        tied = d.where(piece == F.col("bucket")).select(*GROUP, "item", "value", "need", "left")
        depth += 1
    # what is left: `top` rows and the last bucket
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    out = sure.unionByName(tied.select(*GROUP, "item", "value")).withColumn("rank", rank).where(F.col("rank") <= top)
    return last(out, "ranked", *made)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, few: int = FEW, limit: int = 100_000) -> DataFrame:
    """lang, source, part, item, value, rank; see above. Tables of one row a group are broadcast up to `limit` rows."""
    kept = cut(kept_terms(term_counts(docs), least), "kept_terms")
    totals = cut(group_totals(kept), "group_totals")
    shared = shares(kept, totals, limit)
    found = cut(shared.where("p > q").select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "above")
    ranked = top_terms(found, top, few, limit)
    drop_cut(found)
    term = ranked.select(*GROUP, F.lit("term").alias("part"), "item", "value", "rank")
    return last(pairs(shared, totals, limit).unionByName(term), "audit", kept, totals, ranked)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT id, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
l AS (SELECT g.lang, count(kept.term) AS v, coalesce(sum(kept.n), 0) AS total FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN kept ON g.lang = kept.lang GROUP BY g.lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w SEMI JOIN kept ON w.lang = kept.lang AND w.term = kept.term GROUP BY ALL),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (kept.n + 5)) // (l.total + 5 * l.v) AS q
  FROM t JOIN l ON t.lang = l.lang JOIN kept ON kept.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
