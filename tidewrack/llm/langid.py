"""Language identification by a byte convolutional network, trained in numpy.

Filters of several widths over one-hot bytes (sums of table rows), ReLU, max pooling over a fixed-length window, softmax;
a document's probabilities are the mean over all its windows, weighted by their bytes.

Training reads a bounded sample of every language: PER_LANG documents of each (smallest hashes of the id; fewer where the
languages are so many that these pass SAMPLE, but one at least) and WINDOWS windows spread over each. Every window of every document is predicted.

Defined cases: a text that is null or has no letter gets `und` with score 0; with no usable label every text does;
repeated rows get equal results each; columns other than doc_id, text and lang play no part (lang in training only).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, maybe_broadcast, ship, table

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 16, 256
SAMPLE, PER_LANG, WINDOWS = 38_400, 600, 3
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 7


def to_windows(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of a text, the last filled up with spaces."""
    n = max(1, -(-len(raw) // size))
    return np.frombuffer(raw.ljust(n * size), dtype=np.uint8).reshape(n, size)


class ByteCNN:
    """tables[w]: (width, 256, filters); dense: (features, classes)."""

    def __init__(self, langs: list[str], seed: int = SEED):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.tables = {w: r.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.dense = r.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.offset = np.zeros(len(langs), np.float32)
        self._fast: tuple | None = None

    def __getstate__(self):
        return {**self.__dict__, "_fast": None}

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        parts, at = [], {}
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            c = self.tables[w][0][x[:, :n]]
            for j in range(1, w):
                c += self.tables[w][j][x[:, j : j + n]]
            at[w] = c.argmax(axis=1)
            parts.append(np.take_along_axis(c, at[w][:, None, :], axis=1)[:, 0] + self.bias[w])
        return np.concatenate(parts, axis=1), at

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> ByteCNN:
        r = np.random.default_rng(SEED + 1)
        params = [*self.tables.values(), *self.bias.values(), self.dense, self.offset]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for k in range(0, len(x), BATCH):
                i = order[k : k + BATCH]
                z, at = self._pooled(x[i])
                a = np.maximum(z, 0)
                p = self._softmax(a @ self.dense + self.offset)
                p[np.arange(len(i)), y[i]] -= 1
                p /= len(i)
                da = (p @ self.dense.T) * (z > 0)
                grads = []
                for q, w in enumerate(WIDTHS):
                    g, d = np.zeros_like(self.tables[w]), da[:, q * FILTERS : (q + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(g[j], (np.take_along_axis(x[i], at[w] + j, axis=1), np.arange(FILTERS)[None, :]), d)
                    grads.append(g)
                grads += [da[:, q * FILTERS : (q + 1) * FILTERS].sum(0) for q in range(len(WIDTHS))] + [a.T @ p, p.sum(0)]
                t += 1
                for s, (par, g) in enumerate(zip(params, grads, strict=True)):
                    m[s] = 0.9 * m[s] + 0.1 * g
                    v[s] = 0.999 * v[s] + 0.001 * g * g
                    par -= RATE * (m[s] / (1 - 0.9**t)) / (np.sqrt(v[s] / (1 - 0.999**t)) + 1e-8)
        return self

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of neighbouring bytes: the first two places of all widths, and the last two of width 4."""
        pair = lambda t, j: (t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS)
        return np.concatenate([pair(self.tables[w], 0) for w in WIDTHS], axis=1), pair(self.tables[4], 2)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each window of x, as training computes them, by tables of byte pairs."""
        if self._fast is None:
            self._fast = self._pair_tables()
        first, last = self._fast
        out, n, f = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32), x.shape[1], FILTERS
        for k in range(0, len(x), 64):
            b = x[k : k + 64]
            p = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
            c = first[p]  # places 0 .. n - 2
            out[k : k + 64, :f] = c[:, :, :f].max(axis=1)
            out[k : k + 64, f : 2 * f] = (c[:, : n - 2, f : 2 * f] + self.tables[3][2][b[:, 2:]]).max(axis=1)
            out[k : k + 64, 2 * f :] = (c[:, : n - 3, 2 * f :] + last[p[:, 2:]]).max(axis=1)
        out += np.concatenate([self.bias[w] for w in WIDTHS])
        return self._softmax(np.maximum(out, 0) @ self.dense + self.offset)

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        langs: list[str] = []
        scores: list[float] = []
        lo = 0
        while lo < len(texts):  # about a megabyte of windows at once
            hi, n = lo + 1, len(texts[lo])
            while hi < len(texts) and n + len(texts[hi]) <= 1 << 20:
                n += len(texts[hi])
                hi += 1
            w = [to_windows(t) for t in texts[lo:hi]]
            first = np.concatenate(([0], np.cumsum([len(x) for x in w])))
            p = self.probabilities(np.concatenate(w))
            weight = np.full(len(p), WINDOW, np.float64)
            weight[first[1:] - 1] = [max(1, len(t) - (len(x) - 1) * WINDOW) for t, x in zip(texts[lo:hi], w, strict=True)]
            s = np.add.reduceat(p * weight[:, None], first[:-1], axis=0) / np.add.reduceat(weight, first[:-1])[:, None]
            best = s.argmax(axis=1)
            langs += [self.langs[b] for b in best]
            scores += np.clip(s[np.arange(len(best)), best], 0, 1).tolist()
            lo = hi
        return langs, scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> ByteCNN:
    """Train on the bounded sample of docs (doc_id, text, lang) that are not held out."""
    d = docs.where(~held_out(F.col("doc_id"))).where("lang is not null and text is not null").select("doc_id", "text", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h"))
    counts = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return ByteCNN([])
    per_lang = max(1, min(per_lang, SAMPLE // len(counts)))
    # ids with the smallest hashes: a threshold that lets about 1.2 per_lang + 50 of each language through, then the first of these
    share = docs.sparkSession.createDataFrame([(k, min(1 << 40, int((1 << 40) * (1.2 * per_lang + 50) / n))) for k, n in counts.items()], "s_lang string, share long")
    some = d.join(maybe_broadcast(share), F.col("lang") == F.col("s_lang")).where("h < share")
    cut = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.substring(F.col("text"), (F.floor(F.length("text") * k / WINDOWS) + 1).cast("int"), F.lit(WINDOW)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    sample = some.select("doc_id", "lang", "h", cut.alias("w"), nth.alias("nth")).where(F.col("nth") <= per_lang).toPandas()
    sample = sample.sort_values(["lang", "h", "doc_id"])
    model = ByteCNN(sorted(counts))
    x, y, number = [], [], {k: i for i, k in enumerate(model.langs)}
    for lang, windows in zip(sample["lang"], sample["w"], strict=True):
        for t in dict.fromkeys(windows):
            x.append(to_windows(t.encode())[:1])
            y.append(number[lang])
    return model.train(np.concatenate(x), np.array(y))


def identify(docs: DataFrame, model: ByteCNN) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text)."""

    @lean
    def batches(it):
        for pdf in it:
            ok = (pdf["letter"] & pdf["text"].notna()).to_numpy(dtype=bool)
            lang, score = np.full(len(pdf), "und", dtype=object), np.zeros(len(pdf))
            if ok.any() and model.langs:
                texts = [t.encode() for t in pdf["text"][ok]]
                lang[ok], score[ok] = model.predict(texts)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": lang, "score": score})

    ship(docs.sparkSession)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letter).mapInPandas(batches, "doc_id long, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
