"""Registered queries do the whole job: inputs that an earlier form left out, against brute force."""

import math
import re

import pytest

from tidewrack.plans.catalogue import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, path, texts):
    rows = [(k, t, "en", "s0", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def brute_anchor(doc_id, text):
    """start_line, end_line, start_column of the quote that the query takes from a document."""
    at = (doc_id * 7) % 60
    quote, hint = text[at : at + 6].strip(), doc_id % 12 + 1
    if not quote:
        return None
    if "\n" not in quote:
        hits = [(abs(n - hint), n, t.find(quote) + 1) for n, t in enumerate(text.split("\n"), 1) if quote in t]
        return (min(hits)[1], min(hits)[1], min(hits)[2])
    first = text[: text.find(quote)].count("\n") + 1
    return (first, first + quote.count("\n"), None)


def test_anchor_nearest_takes_quotes_of_several_lines(spark, tmp_path):
    texts = {k: "".join("abcd efg\nhi"[(i * (k + 3) + i // 7) % 11] for i in range(80)) for k in range(60)}
    texts |= {60: "ab\ncd\n" * 20, 61: "x\n\n\ny z\n" * 20, 62: None, 63: "     \n" * 20}
    got = {x.ord: (x.start_line, x.end_line, x.start_column) for x in QUERIES["anchor_nearest"](spark, folder(spark, tmp_path / "sf", texts)).collect()}
    want = {k: brute_anchor(k, t) for k, t in texts.items() if t is not None}
    assert got == {k: v for k, v in want.items() if v is not None}
    assert sum(v[0] < v[1] for v in got.values()) > 5


def test_bm25_topk_reads_whole_texts(spark, tmp_path):
    texts = {0: "x " * 45_000 + "que que que", 1: "the que end", 2: "der x", 3: "nothing here", 4: "the the tion", 5: " ", 6: "a b c", 7: "c d e"}
    got = {x.path: x.score for x in QUERIES["bm25_topk"](spark, folder(spark, tmp_path / "sf", texts)).collect()}
    words = {f"f{k}": [f"f{k}", *re.findall("[a-z0-9]+", t)] for k, t in texts.items() if t.strip()}
    avg, want = sum(map(len, words.values())) / len(words), {}
    for term in ("the", "tion", "der", "que"):
        tf = {p: w.count(term) for p, w in words.items() if term in w}
        idf = max(math.log((len(words) - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6)
        for p, n in tf.items():
            want[p] = want.get(p, 0) - idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words[p]) / avg))
    assert got == {p: pytest.approx(s, abs=2e-6) for p, s in want.items()} and "f0" in got
