"""BM25 full-text search over files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import bounded, cut, maybe_broadcast

K1, B, MIN_IDF, CAP, MAX_TERMS = 1.2, 0.75, 1e-6, 80_000, 12
#: Tokens of several texts that are grouped at a time, and the lists that they become.
TOGETHER = 1 << 20
LISTS = "term string, paths array<string>, ends array<int>, at array<int>"


def index_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != "")


def query_terms(text: str) -> list[str]:
    """The first terms of a query, repeated ones included."""
    return [t.lower() for t in re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", text)][:MAX_TERMS]


def _listed(words: pa.Array, term: np.ndarray, paths: pa.Array, tf: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """A row for each run of one term (numbers in words) of postings in order; at: all their places."""
    first = np.flatnonzero(np.diff(term, prepend=-1))
    cuts, sums = np.append(first, len(term)), np.append(0, np.cumsum(tf))
    many, place = np.diff(cuts) + 1, np.arange(len(cuts))
    ends = sums[np.arange(many.sum()) - np.repeat(place[:-1], many)] - np.repeat(sums[first], many)
    arrays = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    columns = words.take(pa.array(term[first])), arrays(cuts, paths), arrays(cuts + place, pa.array(ends, pa.int32())), arrays(sums[cuts], pa.array(at, pa.int32()))
    return pa.RecordBatch.from_arrays(list(columns), ["term", "paths", "ends", "at"])


def _of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of rows (path, ts: the tokens of a text); tokens never become rows."""
    for b in batches:
        cuts = b.column("ts").offsets.to_numpy()
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + TOGETHER, "right")) - 1)
            n = np.diff(cuts[lo : hi + 1])
            words = b.column("ts").values.slice(cuts[lo], cuts[hi] - cuts[lo]).dictionary_encode()
            if len(words):
                rows, most = np.repeat(np.arange(hi - lo), n), int(n.max())
                at = np.arange(len(words)) - np.repeat(cuts[lo:hi] - cuts[lo], n)
                # one number says term, row and place; several rows have few tokens, so it has less than 63 bits
                group, at = np.divmod(np.sort((words.indices.to_numpy().astype(np.int64) * (hi - lo) + rows) * most + at), most)
                first = np.flatnonzero(np.diff(group, prepend=-1))
                term, row = np.divmod(group[first], hi - lo)
                yield _listed(words.dictionary, term, b.column("path").take(pa.array(row + lo)), np.diff(np.append(first, len(group))), at)
            lo = hi


def _of_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of rows (term, path, at)."""
    held, n = [], 0

    def listed() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        words = t["term"].combine_chunks().dictionary_encode()
        code = words.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        at = t["at"].combine_chunks().take(pa.array(order))
        return _listed(words.dictionary, code[order], t["path"].combine_chunks().take(pa.array(order)), at.value_lengths().to_numpy(), at.flatten().to_numpy())

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += len(b.column("at").flatten())
        if n >= TOGETHER:
            yield listed()
            held, n = [], 0
    if held:
        yield listed()


def pack(postings: DataFrame) -> DataFrame:
    """Postings as lists: a term with some of its files (paths), where each one's places end (ends, from 0) and all places (at)."""
    return postings.select("term", "path", "at").mapInArrow(_of_postings, LISTS)


def unpack(lists: DataFrame) -> DataFrame:
    """The postings (term, path, tf, at) of lists; further columns stay."""
    rest = [c for c in lists.columns if c not in ("term", "paths", "ends", "at")]
    d = lists.select("term", F.posexplode("paths").alias("i", "path"), "ends", "at", *rest)
    start = F.get("ends", F.col("i"))
    tf = F.get("ends", F.col("i") + 1) - start
    return d.select("term", "path", tf.cast("long").alias("tf"), F.slice("at", start + 1, tf).alias("at"), *rest)


def build(files: DataFrame, stem: bool = False, cap: int | None = CAP, only: list[str] | None = None, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """postings (term, path, tf, at: positions; as lists if packed) and docs (path, len); blank files are left out.

    Only the first `cap` characters of a text are indexed, as in the reference; with None whole texts are. With `only`, just
    these terms get postings (for one query over files that aren't indexed): other tokens never become rows. Postings are made
    within the texts' rows; only those of paths that several rows have, and of words with one stem, are brought together.
    """
    text = F.col("content") if cap is None else F.substring("content", 1, cap)
    d = files.where(F.trim(F.coalesce("content", F.lit(""))) != "").select(F.col("relative").alias("path"), F.concat_ws(" ", "relative", text).alias("text"))
    ts = d.select("path", index_tokens(F.col("text")).alias("ts"))
    formed = pack if packed else lambda p: p
    if only is not None and not stem:
        # one pass over the texts, for postings and lengths
        hits = F.filter(F.transform("ts", lambda t, i: F.struct(i.alias("at"), t.alias("term"))), lambda x: x.getField("term").isin(*only))
        base = cut(ts.select("path", F.size("ts").cast("long").alias("len"), hits.alias("hits")), "hits")
        found = base.select("path", F.explode("hits").alias("x")).select("path", "x.*")
        return formed(found.groupBy("term", "path").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("at")).alias("at"))), base.select("path", "len")
    lists = lambda t: t.mapInArrow(_of_texts, LISTS)
    together = lambda p: p.groupBy("term", "path").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    marks = F.regexp_replace(F.lower("text"), "[a-z0-9]+", "x")
    n = F.length(marks) - F.length(F.replace(marks, F.lit("x"), F.lit("")))
    docs = d.select("path", n.cast("long").alias("len"))
    if stem:
        # distinct words are stemmed, not their occurrences
        p = unpack(lists(ts))
        stems = p.select("term").distinct().select(F.col("term").alias("raw"), porter_udf()("term").alias("stem"))
        stems = cut(stems if only is None else stems.where(F.col("stem").isin(*only)), "stems")
        return formed(together(p.join(maybe_broadcast(stems), F.col("term") == F.col("raw")).select(F.col("stem").alias("term"), "path", "tf", "at"))), docs
    out = unpack if not packed else lambda x: x
    twice = cut(files.groupBy(F.col("relative").alias("t_path")).count().where("count > 1").select("t_path"), "twice")
    if twice.isEmpty():
        return out(lists(ts)), docs
    twice = maybe_broadcast(twice)
    same = ts.path.eqNullSafe(twice.t_path)
    once = lists(ts.join(twice, same, "left_anti"))
    return out(once).unionByName(formed(together(unpack(lists(ts.join(twice, same, "left_semi")))))), docs


def phrase_frequencies(postings: DataFrame, terms: list[list[str]]) -> DataFrame:
    """q (number of the term in the query), path, tf: occurrences of each term, a phrase of one or more words."""
    spark = postings.sparkSession
    rows = [(q, k, w, len(ws)) for q, ws in enumerate(terms) for k, w in enumerate(ws)]
    want = F.broadcast(spark.createDataFrame(rows, "q int, k int, word string, n int"))
    # a filter on a grouping column goes below the grouping: only the postings asked for are shuffled
    asked = postings.where(F.col("term").isin(sorted({w for _, _, w, _ in rows})))
    hit = asked.join(want, asked.term == want.word)
    # a single word's occurrences are its places
    out = hit.where("n = 1").select("q", "path", F.size(F.array_distinct("at")).cast("long").alias("tf"))
    if all(len(ws) == 1 for ws in terms):
        return out
    hit = hit.where("n > 1").select("q", "n", "path", F.explode("at").alias("p"), "k")
    starts = hit.groupBy("q", "n", "path", (F.col("p") - F.col("k")).alias("start")).agg(F.count_distinct("k").alias("c")).where("c = n")
    return out.unionByName(starts.groupBy("q", "path").agg(F.count("*").alias("tf")))


def snippet(hits: DataFrame, files: DataFrame, term: str, around: int = 60) -> DataFrame:
    """hits with text: what stands around the first place of a term in the file, or its start."""
    low = F.instr(F.lower("content"), F.lit(term.lower()))
    f = files.select(F.col("relative").alias("s_path"), F.substring(F.col("content"), F.greatest(low - around, F.lit(1)), F.lit(2 * around + len(term))).alias("text"))
    return hits.join(f, hits.path == F.col("s_path"), "left").drop("s_path")


def query(postings: DataFrame, docs: DataFrame, terms: list[list[str]], k: int = 5) -> DataFrame:
    """path, score (BM25, negated: more negative is better) of the k best."""
    tf = phrase_frequencies(postings, terms)
    n = tf.groupBy("q").agg(F.count("*").alias("df"))
    all_ = docs.agg(F.count("*").alias("N"), F.avg("len").alias("avg"))
    idf = F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    j = tf.join(F.broadcast(n), "q").join(docs, "path").join(F.broadcast(all_))
    part = F.greatest(idf, F.lit(MIN_IDF)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return j.groupBy("path").agg((-F.sum(part)).alias("score")).orderBy("score", "path").limit(k)


def block_of(path: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(blocks)).cast("int")


def bounds(postings: DataFrame, docs: DataFrame, blocks: int) -> DataFrame:
    """term, block, max_tf, min_len, n: for each block of files what bounds a term's part of any score in it (a table to keep beside the postings)."""
    d = postings.select("term", "path", "tf").join(docs, "path")
    return d.groupBy("term", block_of(F.col("path"), blocks).alias("block")).agg(F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.count("*").alias("n"))


def _part(idf: Column, tf: Column, length: Column) -> Column:
    """A term's part of a score: it grows with tf and falls with the length, so bounds of both bound it."""
    return F.greatest(idf, F.lit(MIN_IDF)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avg")))


def query_pruned(postings: DataFrame, docs: DataFrame, bounds_: DataFrame, blocks: int, terms: list[str], k: int = 5, probe: int = 8) -> tuple[DataFrame, DataFrame]:
    """What query() gives for single words, from the blocks that can hold one of the k best; and one row: n_blocks that hold a term, n_read.

    The `probe` blocks of the highest bounds are scored first; their k-th score is what a further block's bound must reach.
    """
    t = bounds_.where(F.col("term").isin(*set(terms)))
    counts = {w: terms.count(w) for w in terms}
    times = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col("term")]
    all_ = docs.agg(F.count("*").alias("N"), F.avg("len").alias("avg"))
    df = t.groupBy("term").agg(F.sum("n").alias("df")).join(all_)
    stats = cut(df.select(F.col("term").alias("s_term"), "avg", F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "term_stats")
    with_stats = lambda d: d.join(F.broadcast(stats), F.col("term") == F.col("s_term"))  # noqa: E731  a row for each term asked for
    each = with_stats(t).select("block", (times * _part(F.col("idf"), F.col("max_tf"), F.col("min_len"))).alias("p"))
    ub = cut(each.groupBy("block").agg(F.sum("p").alias("bound")), "bounds")
    asked = with_stats(postings.where(F.col("term").isin(*set(terms))).select("term", "path", "tf"))

    def scores(of: DataFrame) -> DataFrame:
        of = F.broadcast(of.select(F.col("block").alias("b"))) if bounded(of) else of.select(F.col("block").alias("b"))
        mine = lambda d: d.join(of, block_of(F.col("path"), blocks) == F.col("b"), "left_semi")
        j = mine(asked).join(mine(docs), "path")
        return j.groupBy("path").agg((-F.sum(times * _part(F.col("idf"), F.col("tf"), F.col("len")))).alias("score"))

    first = ub.orderBy(F.desc("bound"), "block").limit(probe)
    best = cut(scores(first).orderBy("score", "path").limit(k), "probed")
    kth = best.agg(F.when(F.count("*") >= k, -F.max("score")).otherwise(0.0).alias("kth"))
    # a little room for sums in another order
    may = cut(ub.join(F.broadcast(kth)).where(F.col("bound") * (1 + 1e-9) >= F.col("kth")).select("block").union(first.select("block")).distinct(), "read")
    return scores(may).orderBy("score", "path").limit(k), ub.agg(F.count("*").alias("n_blocks")).join(may.agg(F.count("*").alias("n_read")))


def _snippet(text: str, terms: set[str], tokens: int, stems: bool) -> str:
    """The window of so many tokens that holds the most different terms, then the most hits; a sentence's start is preferred, else hits are centred."""
    spans = [m.span() for m in re.finditer("[a-z0-9]+", text.lower())]
    words = [text[a:b].lower() for a, b in spans]
    hits = [(i, x) for i, w in enumerate(words) if (x := porter(w) if stems else w) in terms]
    if not hits:
        return ""
    n = len(spans)
    sentence = [i for i, (a, _) in enumerate(spans) if not i or re.search(r"[.:][ \t\n\r]+\Z", text[max(0, a - 80) : a])]

    def score(at: int) -> tuple[int, int]:
        inside = [(i, t) for i, t in hits if at <= i < at + tokens]
        value = 1000 * len({t for _, t in inside}) + len(inside) - len({t for _, t in inside})
        first, last = (inside[0][0], inside[-1][0] + 1) if inside else (at, at)
        centred = first - (tokens - (last - first)) // 2
        return value, max(0, min(centred, n - tokens))

    best, start = 0, 0
    for i, _ in hits:
        value, at = score(i)
        if value > best:
            best, start = value, at
        if n > tokens:
            s = max((x for x in sentence if x <= i), default=0)
            if s < i and (value := score(s)[0] + (120 if s == 0 else 100)) > best:
                best, start = value, s
    end = min(n, start + tokens)
    head = text[: spans[0][0]] if start == 0 else "…"
    tail = text[spans[end - 1][1] :] if end == n else "…"
    return head + text[spans[start][0] : spans[end - 1][1]] + tail


def snippets(hits: DataFrame, files: DataFrame, terms: list[str], tokens: int = 24, stem: bool = False) -> DataFrame:
    """hits (path, score; a few) with `snippet`: the best window of a file's text for the terms, "" if it holds none."""
    wanted = {porter(t) if stem else t for t in terms}

    @F.pandas_udf("string")
    def window(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: _snippet(t, wanted, tokens, stem))

    f = files.select(F.col("relative").alias("s_path"), F.col("content").alias("s_content"))
    return f.join(F.broadcast(hits), hits.path == F.col("s_path"), "right").withColumn("snippet", window("s_content")).drop("s_path", "s_content")


# Endings of steps 2 and 4 of Porter's algorithm.
ENDINGS = (
    ("ational", "ate"),
    ("tional", "tion"),
    ("enci", "ence"),
    ("anci", "ance"),
    ("izer", "ize"),
    ("logi", "log"),
    ("bli", "ble"),
    ("alli", "al"),
    ("entli", "ent"),
    ("eli", "e"),
    ("ousli", "ous"),
    ("ization", "ize"),
    ("ation", "ate"),
    ("ator", "ate"),
    ("alism", "al"),
    ("iveness", "ive"),
    ("fulness", "ful"),
    ("ousness", "ous"),
    ("aliti", "al"),
    ("iviti", "ive"),
    ("biliti", "ble"),
)
LAST_ENDINGS = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_VOWELS = "aeiou"


def _cons(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and (w[i] != "y" or i == 0 or not _cons(w, i - 1))


def _measure(w: str) -> int:
    kinds = [_cons(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(kinds, kinds[1:], strict=False) if not a and b)


def _cvc(w: str) -> bool:
    n = len(w)
    return n >= 3 and _cons(w, n - 3) and not _cons(w, n - 2) and _cons(w, n - 1) and w[-1] not in "wxy"


def porter(w: str) -> str:
    """Porter's stemmer (M. F. Porter, 1980)."""
    if len(w) <= 2:
        return w
    vowel = lambda s: any(not _cons(s, i) for i in range(len(s)))

    def swap(w, pairs, least):
        for a, b in pairs:
            if w.endswith(a):
                return w[: -len(a)] + b if _measure(w[: -len(a)]) > least else w
        return w

    for a, b in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(a):
            w = w[: -len(a)] + b
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for a in ("ed", "ing"):
            if w.endswith(a):
                if vowel(w[: -len(a)]):
                    w = w[: -len(a)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    w = swap(w, ENDINGS, 0)
    w = swap(w, [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")], 0)
    for a in LAST_ENDINGS:
        if w.endswith(a):
            s = w[: -len(a)]
            if _measure(s) > 1 and (a != "ion" or s.endswith(("s", "t"))):
                w = s
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def porter_udf():
    @F.pandas_udf("string")
    def stem(s: pd.Series) -> pd.Series:
        return s.map({w: porter(w) for w in s.unique()})

    return stem
