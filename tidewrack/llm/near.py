"""Near-duplicates by bottom-k sketches from one hash function.

A document's set is its distinct 5-word shingles (A-Z lower-cased), as 63-bit hashes; its sketch is the K smallest.
Equal sets are one class, carried by its smallest doc_id. Inverted lists of retained values generate candidate pairs of
classes; the union sketch estimates their similarity; the full sets decide (native array_intersect).

Which lists: two sets with similarity 0.75 share at least `need` of their retained values (exactly so for sets of under
48 shingles, else with odds against of about 1e-8), so the rarest value that they share is among the rarest
size - need + 1 of both. Only those values have lists. No cap is put on a list. In a list every class is first compared
with the list's centre (the class whose values are commonest), which links groups of copies without all their pairs.
Classes that share a list but are then still in different components are compared in blocks of bounded size, by centre:
classes that the centre's component lacks against all that share a list with it. A block counts common values of larger
sketches in numpy and gives out only pairs that these estimate as similar. No class and no pair is left out.

Defined cases: null, empty and blank texts have empty sets, which are linked with nothing; a null doc_id is linked with
nothing and kept; equal rows have one class and the same result each; columns other than doc_id and text play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, drop_cut, give_back, last, lean, ship, table
from .components import components
from .hashing import chunks, shingle_sets

#: Values of a sketch; words of a shingle; similarity in percent.
K, WORDS, PERCENT = 64, 5, 75
#: Share of a full sketch's values that similar sets have in common at least; estimates below this similarity are dropped.
SHARED, ESTIMATE = 0.43, 0.45
#: Values of the larger sketches (a smaller set is whole), the estimate below which their pairs are dropped (5.5 standard
#: deviations under 0.75), and classes on a block's side.
LARGE, LARGE_ESTIMATE, SIDE = 256, 0.6, 1000


@lean
def _sketches(batches):
    for pdf in batches:
        texts = [t.encode() if t is not None else b"" for t in pdf["text"]]
        for lo, hi in chunks(texts):
            part, n, keys, sketch = texts[lo:hi], [], [], []
            for s in shingle_sets(part, WORDS):
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketch.append(s[:K])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[lo:hi].to_numpy(), "n": n, "key": keys, "sketch": sketch})


@lean
def _sets(batches):
    for pdf in batches:
        texts = [t.encode() if t is not None else b"" for t in pdf["text"]]
        for lo, hi in chunks(texts):
            yield pd.DataFrame({"id": pdf["id"].iloc[lo:hi].to_numpy(), "set": list(shingle_sets(texts[lo:hi], WORDS))})


@lean
def _large(batches):
    for pdf in _sets(batches):
        yield pd.DataFrame({"id": pdf["id"], "n": pdf["set"].map(len), "sk": [s[:LARGE] for s in pdf["set"]]})


def similar_pairs(xs: list[np.ndarray], ys: list[np.ndarray], nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs whose sketches (sorted, the LARGE smallest values of sets of nx and ny) say that they may be similar."""
    both = np.zeros((len(xs), len(ys)), np.int32)
    values = np.concatenate([*xs, *ys])
    row = np.repeat(np.arange(len(xs) + len(ys)), [len(v) for v in (*xs, *ys)])
    order = np.argsort(values, kind="stable")  # within a value x rows come first
    values, row = values[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    last = np.concatenate((first[1:], [len(values)]))
    is_x = np.concatenate(([0], np.cumsum(row < len(xs))))
    n_x = is_x[last] - is_x[first]
    shared = (n_x > 0) & (n_x < last - first)
    single = shared & (last - first == 2)
    np.add.at(both, (row[first[single]], row[first[single] + 1] - len(xs)), 1)
    for a, e, k in zip(first[shared & ~single].tolist(), last[shared & ~single].tolist(), n_x[shared & ~single].tolist(), strict=True):
        both[row[a : a + k, None], row[None, a + k : e] - len(xs)] += 1
    # all values up to the lesser of both sketches' largest are known on both sides
    top = np.iinfo(np.int64).max
    x_top = np.array([v[-1] if n > LARGE else top for v, n in zip(xs, nx, strict=True)])
    y_top = np.array([v[-1] if n > LARGE else top for v, n in zip(ys, ny, strict=True)])
    known = np.stack([np.searchsorted(v, y_top, "right") for v in xs]) + np.stack([np.searchsorted(v, x_top, "right") for v in ys], axis=1)
    whole = (x_top == top)[:, None] & (y_top == top)[None, :]
    union = known - both
    return np.nonzero(both >= np.where(whole, PERCENT / 100, LARGE_ESTIMATE) * union - 1e-9)


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    x = pdf["x"].to_numpy(dtype=bool)
    a, b = pdf[x], pdf[~x]
    none = np.zeros(0, np.int64)
    i, j = similar_pairs(list(a["sk"]), list(b["sk"]), a["n"].to_numpy(), b["n"].to_numpy()) if len(a) and len(b) else (none, none)
    i, j, ci, cj = a["id"].to_numpy()[i], b["id"].to_numpy()[j], a["c"].to_numpy()[i], b["c"].to_numpy()[j]
    i, j = i[ci != cj], j[ci != cj]
    if len(pdf) > SIDE:
        give_back()
    return pd.DataFrame({"a": np.minimum(i, j), "b": np.maximum(i, j)})


def _rest(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) in different components that share a centre. members: hub, id, c, h_c (the hub's component)."""
    m = members.withColumn("x", F.col("c") != F.col("h_c"))
    n = m.groupBy("hub").agg(F.ceil(F.sum(F.col("x").cast("long")) / SIDE).alias("nx"), F.ceil(F.count("*") / SIDE).alias("ny")).where("nx > 0")
    # a table of its own: read plainly, a hub that very many share can be split where it is joined
    n = cut(n, "hubs")
    n = F.broadcast(n) if bounded(n) else n
    m = cut(m.join(n.withColumnRenamed("hub", "n_hub"), F.col("hub") == F.col("n_hub")).drop("n_hub"), "members")
    ids = m.select("id").distinct()
    ids = F.broadcast(ids) if bounded(ids) else ids
    large = docs.join(ids, docs.doc_id == ids.id).select("id", "text").mapInPandas(_large, "id long, n long, sk array<long>")
    large = cut(large.withColumnRenamed("id", "l_id").dropDuplicates(["l_id"]), "large")
    part = lambda k: F.pmod(F.xxhash64("id"), F.col(k))
    upto = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    x = m.where("x").select("hub", part("nx").alias("i"), upto("ny").alias("j"), "id", "c", F.lit(True).alias("x"))
    y = m.select("hub", upto("nx").alias("i"), part("ny").alias("j"), "id", "c", F.lit(False).alias("x"))
    rows = x.unionByName(y).join(large, F.col("id") == F.col("l_id")).drop("l_id")
    return last(rows.groupBy("hub", "i", "j").applyInPandas(_block, "a long, b long").distinct(), "rest", m, large)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), key (digest of the whole set; null if empty), sketch."""
    return docs.select("doc_id", "text").mapInPandas(_sketches, "doc_id long, n long, key binary, sketch array<long>")


def _need(n: Column) -> Column:
    return F.when(n < 48, F.ceil(n * 3 / 4)).otherwise(F.ceil(F.least(n, F.lit(K)) * SHARED)).cast("int")


def _lists(classes: DataFrame) -> DataFrame:
    """value, id, centre: of each class, the retained values that need a list, and how common its values are."""
    v = classes.select("id", "n", F.explode("sketch").alias("value"))
    often = v.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    per = v.join(often, "value").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("vs"), F.sum(F.log2(F.col("df").cast("double"))).alias("centre"))
    # values with a list of one are the rarest and come first; they use up places
    size = F.least(F.col("n"), F.lit(K)).cast("int")
    take = size - _need(F.col("n")) + 1 - (size - F.size("vs"))
    return per.where(take > 0).select("id", F.round(F.col("centre") / size, 6).alias("centre"), F.explode(F.slice("vs", 1, take)).alias("v")).select("id", "centre", F.col("v.value").alias("value"))


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose union sketch has enough values of both."""
    s = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    p = pairs.join(s("a"), "a").where(F.col("n_a").isNotNull()).join(s("b"), "b").where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, K)
    p = p.withColumn("u", union)
    both = F.size(F.array_intersect("u", F.array_intersect("s_a", "s_b")))
    return p.where(both >= ESTIMATE * F.size("u")).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    pairs = cut(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    ids = F.broadcast(ids) if bounded(ids) else ids
    texts = docs.join(ids, docs.doc_id == ids.id).select("id", "text")
    sets = cut(texts.mapInPandas(_sets, "id long, set array<long>"), "sets")
    s = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}"))
    p = pairs.join(s("a"), "a").join(s("b"), "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    good = cut(p.where(100 * both >= PERCENT * (F.size("set_a") + F.size("set_b") - both)).select("a", "b").distinct(), "good")
    drop_cut(sets)
    drop_cut(pairs)
    return good


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id)."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = cut(sketches(docs), "sketches")
    classes = cut(sk.where("doc_id is not null and n > 0").groupBy("key").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("m")).select("key", F.col("m.doc_id").alias("id"), F.col("m.n").alias("n"), F.col("m.sketch").alias("sketch")), "classes")
    reps = classes.select("id", "n", "sketch")
    lists = cut(_lists(reps), "lists")
    hubs = lists.groupBy("value").agg(F.count("*").alias("m"), F.max(F.struct("centre", (-F.col("id")).alias("neg"))).alias("h")).where("m > 1").select("value", (-F.col("h.neg")).alias("hub"))
    stars = lists.join(hubs, "value").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    good = _verified(_estimated(stars, reps), docs)
    comp = components(good)
    # what is left: classes that share a list, and so its centre, but no component
    members = lists.join(hubs, "value").select("hub", "id").distinct()
    named = lambda d, k, c: d.join(comp.select(F.col("id").alias("c_id"), "component"), d[k] == F.col("c_id"), "left").withColumn(c, F.coalesce("component", k)).drop("c_id", "component")
    more = _verified(_rest(named(named(members, "id", "c"), "hub", "h_c"), docs), docs)
    drop_cut(lists)
    comp = components(good.union(more)) if more.limit(1).count() else comp
    c = comp.withColumnRenamed("id", "c_id")
    of = classes.join(c, classes.id == c.c_id, "left").select(F.col("key").alias("k"), F.coalesce("component", "id").alias("component"))
    out = sk.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(of, F.col("key") == F.col("k"), "left")
    cid = F.coalesce("component", "doc_id")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"), F.coalesce(cid == F.col("doc_id"), F.lit(True)).alias("kept"))
    return last(out, "near", sk, classes, good, more, comp)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
