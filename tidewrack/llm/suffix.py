"""Exact removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if a WINDOW-byte string that covers it also starts anywhere else.

1. Winnowing routes, and decides nothing: each window has one anchor, the K-byte string with the least hash in it, so equal
   windows have equal anchors at the same place. Consecutive windows with one anchor are a range, and its string is all
   their bytes. A range whose anchor occurs nowhere else has no equal.
2. Every other range is decided by the transforms. One string for each different range (two, if it occurs again) goes to
   a group by anchor. In a group, shards of strings get Burrows-Wheeler transforms over symbols of SYMBOL bytes (at every
   byte offset; equal symbols are verified byte by byte), which are merged by iterative interleave refinement: after k
   rounds the merged order is right in the first k symbols, and the round that parts two neighbours gives their common
   prefix. Neighbours with a common prefix of WINDOW / SYMBOL symbols are a repeated interval.
3. An anchor with more than HOT different ranges (a passage that very many documents share has such at its ends) is made
   longer: its windows are dealt in halves, by their offset before the anchor, and the bytes that all windows of a half
   have in common are the half's anchor. This goes on until no anchor has more; a half of one window has one string.

What is decided for a different range holds for all its occurrences, which are told by 128 bits of their strings' hash.

Defined cases: null and empty texts have 0 bytes; texts under WINDOW bytes are kept whole; equal rows are copies of each
other; an empty table gives no rows; columns other than doc_id and text play no part.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, drop_cut, lean, ship, table
from .hashing import _BYTE, _power_tables, scramble

WINDOW, K, SYMBOL = 200, 32, 50
#: Window starts handled at once; bytes of strings for each bucket; different ranges of an anchor at most; elements merged at
#: once (whole anchors; symbol numbers of so many fit 16 bits).
CHUNK, BUCKET, HOT, GROUP = 1 << 18, 1 << 20, 4_000, 60_000
_POS = np.uint64((1 << 22) - 1)


def _prefix(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power_tables(len(b) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64))), down


def _hash(sums: np.ndarray, down: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
    """63-bit hashes of the strings [a, e)."""
    return (scramble((sums[e] - sums[a]) * down[a] + (e - a).astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, in time that doesn't depend on w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, ~np.uint64(0))
    padded[:n] = x
    rows = padded.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _pieces(texts: list[bytes]):
    """Lists of (text number, offset, bytes) of about CHUNK bytes; a long text is cut so that each window is in one piece."""
    out, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t) - WINDOW + 1, CHUNK):
            piece = t[at : at + CHUNK + WINDOW - 1]
            if size + len(piece) > 2 * CHUNK and out:
                yield out
                out, size = [], 0
            out.append((i, at, piece))
            size += len(piece)
    if out:
        yield out


_RANGE = "doc_id long, tk long, h long, r1 long, r2 long, lo int, hi int, at int"


def _digests(strings: list[bytes]) -> np.ndarray:
    """128 bits of each string's hash as two numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), "<i8").reshape(-1, 2)


def _frame(pdf: pd.DataFrame, rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows (number in pdf, values...) under names, with doc_id and tk of pdf."""
    i = [x[0] for x in rows]
    return pd.DataFrame({"doc_id": pdf["doc_id"].array[i], "tk": pdf["tk"].to_numpy()[i]} | {n: [x[k] for x in rows] for k, n in enumerate(names, 1)})


@lean
def _ranges(batches):
    """Ranges of texts: anchor's hash, string's digest, first and last window start, anchor's place."""
    for pdf in batches:
        texts = [t.encode() if t else b"" for t in pdf["text"]]
        docs, keys = pdf["doc_id"].array, pdf["tk"].to_numpy()
        for pieces in _pieces(texts):
            raw = b"".join(p for _, _, p in pieces)
            b = np.frombuffer(raw, np.uint8)
            sums, down = _prefix(b)
            at = np.arange(len(b) - K + 1)
            grams = scramble((sums[K:] - sums[:-K]) * down[at])
            lens = np.array([len(p) for _, _, p in pieces])
            ends = np.cumsum(lens)
            best = _sliding_min((grams & ~_POS) | at.astype(np.uint64), WINDOW - K + 1)
            pos = (best & _POS).astype(np.int64)
            of = np.repeat(np.arange(len(lens)), lens)
            ok = np.zeros(len(pos), bool)
            for e, n in zip(ends.tolist(), lens.tolist(), strict=True):
                ok[e - n : e - WINDOW + 1] = True
            new = ok & np.concatenate(([True], (pos[1:] != pos[:-1]) | (of[1 : len(pos)] != of[: len(pos) - 1])))
            lo = np.flatnonzero(new)
            hi = np.flatnonzero(ok & np.concatenate(((new[1:] | ~ok[1:]), [True])))
            piece = of[lo]
            text = np.array([i for i, _, _ in pieces])[piece]
            shift = np.array([o for _, o, _ in pieces])[piece] - (ends - lens)[piece]
            r = _digests([raw[x:y] for x, y in zip(lo.tolist(), (hi + WINDOW).tolist(), strict=True)])
            yield pd.DataFrame({
                "doc_id": docs[text], "tk": keys[text], "h": (grams[pos[lo]] >> np.uint64(1)).astype(np.int64), "r1": r[:, 0], "r2": r[:, 1],
                "lo": lo + shift, "hi": hi + shift, "at": pos[lo] + shift,
            })


@lean
def _halves(batches):
    """Ranges of anchors that are too common, dealt in halves under longer anchors. ws: lo, hi, at, least, most."""
    for pdf in batches:
        rows = []
        for i, (text, ws) in enumerate(zip(pdf["text"], pdf["ws"], strict=True)):
            t = text.encode()
            for w in ws:
                mid = (w["least"] + w["most"] + 1) // 2
                for least, most in ((w["least"], mid - 1), (mid, w["most"])):
                    lo, hi = max(w["lo"], w["at"] - most), min(w["hi"], w["at"] - least)
                    if lo <= hi:
                        core = t[w["at"] - least : w["at"] - most + WINDOW]
                        h = xxhash.xxh3_64_intdigest(core, seed=least * WINDOW + most) >> 1
                        r1, r2 = _digests([t[lo : hi + WINDOW]])[0].tolist()
                        rows.append((i, h, r1, r2, lo, hi, w["at"], least, most))
        yield _frame(pdf, rows, ["h", "r1", "r2", "lo", "hi", "at", "least", "most"])


# ---- Burrows-Wheeler transforms of shards and their merging ----


class Shard:
    """Transform of a collection of symbol strings: suffixes in order, and the symbol before each (-1 at a string's start)."""

    def __init__(self, sa: np.ndarray, bwt: np.ndarray, n_ends: int):
        self.sa, self.bwt, self.n_ends = sa, bwt, n_ends


def _small(x: np.ndarray) -> np.ndarray:
    """Numbers from -1 up, plus one, in 16 bits where they fit: numpy sorts those by radix."""
    return (x + 1).astype(np.uint16) if not len(x) or int(x.max()) < 65535 else x + 1


def shard_bwt(symbols: np.ndarray, nxt: np.ndarray, prev_symbol: np.ndarray, ends: np.ndarray, depth: int, number: np.ndarray) -> Shard:
    """symbols[i] (-1 at a string's end) and nxt[i] of element i, an index into the shard; ends: elements that end a string."""
    places = [np.arange(len(symbols))]
    for _ in range(depth - 1):
        places.append(nxt[places[-1]])
    order = np.arange(len(symbols))
    key = _small(symbols)
    for place in reversed(places):  # the last symbol first: each stable pass keeps the order of those after it
        order = order[np.argsort(key[place[order]], kind="stable")]
    return Shard(number[order], prev_symbol[order], int(ends.sum()))


def merge(a: Shard, b: Shard, depth: int) -> tuple[Shard, np.ndarray]:
    """The merged transform, and for each of its suffixes the common prefix with the one before, in symbols (`depth` at most).

    The interleave starts as all of a, then all of b. A round moves each suffix's predecessor, in the present order, to its
    symbol's bucket: the suffix order in one symbol more. No suffix is compared or sorted anew. A place where a round first
    parts neighbours stays a place where they part.
    """
    z = np.concatenate((np.zeros(len(a.sa), bool), np.ones(len(b.sa), bool)))
    n_ends = a.n_ends + b.n_ends
    ends = np.concatenate((np.zeros(a.n_ends, bool), np.ones(b.n_ends, bool)))
    interval, common = np.zeros(len(z), np.int32), np.full(len(z), depth, np.int8)
    first, second = _small(a.bwt), _small(b.bwt)
    kind = np.result_type(first, second)
    for k in range(depth):
        before = np.empty(len(z), kind)
        of_b = np.flatnonzero(z)
        before[np.flatnonzero(~z)], before[of_b] = first, second
        has = np.flatnonzero(before)
        to = has[np.argsort(before[has], kind="stable")]
        z = np.concatenate((ends, z[to]))
        c, old = before[to], interval[to]
        parted = np.concatenate((np.zeros(n_ends, bool), [True], (c[1:] != c[:-1]) | (old[1:] != old[:-1])))[: len(z)]
        interval = np.cumsum(parted, dtype=np.int32)
        new = np.flatnonzero(parted)
        common[new[common[new] == depth]] = k
    sa, bwt = np.empty(len(z), np.int64), np.empty(len(z), np.int64)
    sa[~z], sa[z], bwt[~z], bwt[z] = a.sa, b.sa, a.bwt, b.bwt
    common[:1] = 0
    return Shard(sa, bwt, n_ends), common


def repeated_intervals(common: np.ndarray, depth: int) -> np.ndarray:
    """Of each suffix, whether it has a common prefix of depth symbols with a neighbour."""
    after = common >= depth
    return after | np.concatenate((after[1:], [False]))


def _symbols(b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Numbers of the SYMBOL-byte strings at these places: equal numbers for equal bytes, and only for those."""
    sums, down = _prefix(b)
    number = np.unique(_hash(sums, down, start, start + SYMBOL), return_inverse=True)[1]
    one = np.zeros(len(start), np.int64)
    one[number] = start
    strings = np.lib.stride_tricks.sliding_window_view(b, SYMBOL)
    for k in range(0, len(start), GROUP):
        x, y = start[k : k + GROUP], one[number[k : k + GROUP]]
        twice = np.flatnonzero(x != y)
        if not np.array_equal(strings[x[twice]], strings[y[twice]]):  # a hash that two strings have: number the strings themselves
            return np.unique(strings[start].copy().view(f"V{SYMBOL}").ravel(), return_inverse=True)[1]
    return number


def repeated_windows(strings: list[bytes], shards: int = 2) -> list[np.ndarray]:
    """Of each string, the starts of WINDOW-byte strings that start elsewhere in the collection too."""
    depth = WINDOW // SYMBOL
    lens = np.array([len(s) for s in strings])
    b = np.frombuffer(b"".join(strings), np.uint8)
    # elements: at each string's offsets a symbol of SYMBOL bytes; then SYMBOL ends, one for each phase
    sizes = lens + 1
    first = np.concatenate(([0], np.cumsum(sizes)))
    of = np.repeat(np.arange(len(strings)), sizes)
    off = np.arange(first[-1]) - first[of]
    ends = off >= lens[of] - SYMBOL + 1
    symbols = np.full(first[-1], -1, np.int64)
    symbols[~ends] = _symbols(b, ((np.cumsum(lens) - lens)[of] + off)[~ends])
    nxt = np.arange(first[-1]) + np.where(ends, 0, SYMBOL)
    prev = np.where(off >= SYMBOL, symbols[np.maximum(np.arange(first[-1]) - SYMBOL, 0)], -1)
    bounds = np.linspace(0, len(strings), min(shards, len(strings)) + 1).astype(int)
    todo = []
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        x, y = first[s], first[e]
        todo.append(shard_bwt(symbols[x:y], nxt[x:y] - x, prev[x:y], ends[x:y], depth, np.arange(x, y)))
    if len(todo) == 1:
        todo.append(Shard(np.zeros(0, np.int64), np.zeros(0, np.int64), 0))
    while len(todo) > 1:
        merged, common = merge(todo[0], todo[1], depth)
        todo = [*todo[2:], merged]
    at = merged.sa[repeated_intervals(common, depth)]
    at = np.sort(at[off[at] <= lens[of[at]] - WINDOW])
    cut_at = np.searchsorted(at, first)
    return [off[at[i:j]] for i, j in zip(cut_at[:-1], cut_at[1:], strict=True)]


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of what windows at these ascending starts cover."""
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > WINDOW)
    return list(zip(at[np.concatenate(([0], gap + 1))].tolist(), (at[np.concatenate((gap, [len(at) - 1]))] + WINDOW).tolist(), strict=True))


def _decided(strings: list[bytes], again: list[bool]) -> list[list[tuple[int, int]]]:
    """Of different strings, what is repeated; those that occur again are there twice, once in each shard."""
    n, twice = len(strings), [i for i, x in enumerate(again) if x]
    return [_runs(at) for at in repeated_windows(strings + [strings[i] for i in twice])[:n]]


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """What is repeated (start, end: in the string) of a bucket's different ranges (s_...), whole anchors at a time."""
    pdf = pdf.drop_duplicates(["h", "r1", "r2"]).sort_values("h", kind="stable")  # equal documents bring equal strings
    h, strings, again = pdf["h"].to_numpy(), list(pdf["s"]), pdf["again"].tolist()
    edge = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
    runs: list[list[tuple[int, int]]] = []
    start, size = 0, 0
    for a, e in zip(edge[:-1], edge[1:], strict=True):
        more = sum((len(strings[i]) + 1) * (1 + again[i]) for i in range(a, e))
        if a > start and size + more > GROUP:
            runs += _decided(strings[start:a], again[start:a])
            start, size = a, 0
        size += more
    runs += _decided(strings[start:], again[start:])
    out = [(i, s, e) for i, x in enumerate(runs) for s, e in x]
    i = [x[0] for x in out]
    ranges = {f"s_{n}": pdf[n].to_numpy()[i] for n in ("h", "r1", "r2", "again", "doc", "tk", "lo")}
    return pd.DataFrame(ranges | {"start": [x[1] for x in out], "end": [x[2] for x in out]})


@lean
def _strings(batches):
    for pdf in batches:
        texts = (t.encode() for t in pdf["text"])
        each = zip(texts, pdf["tk"].tolist(), pdf["ws"], strict=True)
        rows = [(w["h"], w["r1"], w["r2"], w["again"], t[w["lo"] : w["hi"] + WINDOW], w["doc"], tk, w["lo"]) for t, tk, ws in each for w in ws]
        yield pd.DataFrame({n: [x[k] for x in rows] for k, n in enumerate(("h", "r1", "r2", "again", "s", "doc", "tk", "lo"))})


def _release(df: DataFrame, *old: DataFrame) -> DataFrame:
    """df, after deleting tables and shuffle files that nothing needs any more.

    Spark keeps a finished query's shuffle files until the driver's JVM happens to collect its garbage, here many times the input.
    """
    drop_cut(*old)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def _with_texts(docs: DataFrame, per: DataFrame, *columns: str | Column, common: bool = False) -> DataFrame:
    """doc_id, tk, text, ws: each document with its different rows of per, under these columns; equal documents have equal ones.

    common: per is of anchors that are too common, which few documents have, so that texts need not be shuffled for it.
    """
    few = common and bounded(per)
    per = per.groupBy("doc_id", "tk").agg(F.collect_set(F.struct(*columns)).alias("ws")).withColumnsRenamed({"doc_id": "d", "tk": "t"})
    return docs.join(F.broadcast(per) if few else per, docs.doc_id.eqNullSafe(per.d) & (docs.tk == per.t)).select("doc_id", "tk", "text", "ws")


def _varied(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different ranges of rows (h, r1, r2, n: occurrences, and a place of one), and v_h, v: how many an anchor has, where several."""
    # any row's place will do, as all have the same string; all firsts are of one row
    kinds = cut(rows.groupBy("h", "r1", "r2").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "tk", "lo", "hi")]), "kinds")
    several = cut(kinds.groupBy(F.col("h").alias("v_h")).agg(F.count("*").alias("v")).where("v > 1"), "several")
    return kinds, several


def _by_anchor(df: DataFrame, several: DataFrame, how: str) -> DataFrame:
    few = several if not bounded(several) else F.broadcast(several)
    return df.join(few, F.col("h") == F.col("v_h"), how)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, tk (hash of the text), start, end: bytes covered by repeated strings (spans may overlap).

    docs: doc_id, tk, text.
    """
    rows, least, most = cut(docs.mapInPandas(_ranges, _RANGE), "ranges"), F.lit(0).alias("least"), F.lit(WINDOW - K).alias("most")
    spans = None
    while rows is not None:
        kinds, several = _varied(rows)
        hot = several.where(F.col("v") > HOT)
        more = None
        if hot.limit(1).count():
            hot = cut(hot, "hot")
            wide = _by_anchor(rows, hot, "left_semi")
            parts = _with_texts(docs, wide, "lo", "hi", "at", least, most, common=True).mapInPandas(_halves, _RANGE + ", least int, most int")
            more = _release(cut(parts, "ranges"), hot)
        need = _by_anchor(kinds, several, "left").where(F.coalesce(F.col("v") <= HOT, F.col("n") > 1))
        need = need.select("h", "r1", "r2", (F.col("n") > 1).alias("again"), "doc_id", "tk", "lo", "hi")
        doc = F.col("doc_id").cast("string").alias("doc")  # pandas would make numbers with nulls floats
        strings = _with_texts(docs, need, "h", "r1", "r2", "again", "lo", "hi", doc, common=spans is not None)
        strings = cut(strings.mapInPandas(_strings, "h long, r1 long, r2 long, again boolean, s binary, doc string, tk long, lo int"), "strings")
        _release(strings, kinds, several)
        size = strings.agg(F.sum(F.length("s"))).first()[0] or 0
        bucket = F.pmod(F.xxhash64("h"), F.lit(max(1, -(-size // BUCKET))))
        ranges = "s_h long, s_r1 long, s_r2 long, s_again boolean, s_doc string, s_tk long, s_lo int, start int, end int"
        runs = strings.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(_bucket, ranges)
        runs = _release(cut(runs, "runs"), strings)
        # a range that occurs once has its place with it; only those that occur again are looked up among all
        many = runs.where("s_again").select("s_h", "s_r1", "s_r2", "start", "end")
        places = lambda d, t, lo: [d.alias("doc_id"), t.alias("tk"), (lo + F.col("start")).alias("start"), (lo + F.col("end")).alias("end")]
        one = runs.where("not s_again").select(*places(F.col("s_doc").cast("long"), F.col("s_tk"), F.col("s_lo")))
        found = rows.join(F.broadcast(many) if bounded(many) else many, (F.col("h") == F.col("s_h")) & (F.col("r1") == F.col("s_r1")) & (F.col("r2") == F.col("s_r2")))
        found = cut(found.select(*places(F.col("doc_id"), F.col("tk"), F.col("lo"))).unionAll(one), "spans")
        _release(found, rows, runs)
        spans, rows, least, most = found if spans is None else spans.unionAll(found), more, F.col("least"), F.col("most")
    return spans


def _remove(batches):
    for pdf in batches:
        n, gone, runs, digest, kept = [], [], [], [], []
        for t, spans in zip(pdf["text"], pdf["spans"], strict=True):
            b = t.encode() if t else b""
            parts, at, cut_, count = [], 0, 0, 0
            for s, e in sorted((x["start"], x["end"]) for x in (spans if spans is not None else [])):
                if s > at or not count:
                    parts.append(b[at:s])
                    count += 1
                    cut_ += e - s
                    at = e
                elif e > at:
                    cut_ += e - at
                    at = e
            rest = b"".join([*parts, b[at:]])
            n.append(len(b))
            gone.append(cut_)
            runs.append(count)
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": n, "n_removed": gone, "n_spans": runs, "kept_sha256": digest, "kept": kept})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk"), "text")
    spans = repeated_spans(d).groupBy("doc_id", "tk").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = spans.withColumnsRenamed({"doc_id": "d", "tk": "t"})
    j = d.join(spans, d.doc_id.eqNullSafe(spans.d) & (d.tk == spans.t), "left").select("doc_id", "text", "spans")
    return j.mapInPandas(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
