"""The divergence audit against plain counting, with hot ties, groups without terms, salted joins and portions."""

import collections
import random
import re

import pytest

from tidewrack.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, term string, value string, n long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, least, top):
    groups, df, n = set(), collections.Counter(), collections.defaultdict(collections.Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall(lower(text or ""))
        groups.add((lang, source))
        n[lang, source].update(words)
        df.update((lang, w) for w in set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), k in df.items() if x == lang and k >= least]
        sources = sorted(s for x, s in groups if x == lang)
        count = {s: {w: n[lang, s][w] for w in kept} for s in sources}
        count[None] = {w: sum(count[s][w] for s in sources) for w in kept}
        total = {s: sum(c.values()) for s, c in count.items()}
        p = {s: {w: 1 + 10**9 * (c[w] + 5) // (total[s] + 5 * len(kept)) for w in kept} for s, c in count.items()}
        for s in sources:
            part = {"pair": [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in sources if o != s]}
            part["term"] = [(p[None][w] - p[s][w], w.encode()) for w in kept if count[s][w] and p[s][w] > p[None][w]]
            for name, items in part.items():
                for k, (v, item) in enumerate(sorted(items), 1):
                    if name == "pair" or k <= top:
                        out.add((lang, s, name, item.decode(), -v, k))
    return out


def rows_of(seed, docs=400):
    r = random.Random(seed)
    voc = [f"{a}{b}é{c}" for a in "xyZ" for b in "abcd" for c in "PQRST"] + ["the", "The", "THE", "ÿĀ", "\U0001f600"]
    out = []
    for k in range(docs):
        lang, source = r.choice(["en", "en", "de", None, ""]), r.choice(["s0", "s0", "s1", "S2", "é", None])
        words = [r.choice(voc[: r.choice([5, 20, 65])]) for _ in range(r.randint(0, 30))]
        out.append((k, r.choice([" ", "1", "-", "\n"]).join(words), lang, source))
    # each once and only in one source: a tie of hundreds
    out += [(None, " ".join(f"tie{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{'z' * (i % 3)}" for i in range(300)), "en", "tied")] * 3
    return out + [(1, None, "fr", "s0"), (1, "123 4", "fr", None), (1, "", None, "only")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "v", 1) for r in rows], DOCS)


@pytest.mark.parametrize("few,limit,portion,block", [(2000, 100_000, 200_000, 1_000_000), (3, 0, 7, 5)])
def test_audit_equals_plain_counting(spark, monkeypatch, few, limit, portion, block):
    monkeypatch.setattr(divergence, "PORTION", portion)
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = rows_of(3)
    got = divergence.audit(frame(spark, rows).repartition(5), 3, 20, few, limit)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(x) for x in got.collect()]
    assert set(got) == brute(rows, 3, 20) and len(got) == len(set(got))
    assert {x[0] for x in got} == {"", "en", "de", "fr"} and sum(x[1] == "tied" and x[2] == "term" for x in got) == 20


def test_pairs_in_blocks_are_all_pairs(monkeypatch):
    import numpy as np

    for block in (1, 3, 10, 1000):
        monkeypatch.setattr(divergence, "BLOCK", block)
        lengths = np.array([0, 3, 1, 5, 0, 2, 9])
        got = [(int(a), int(b)) for i, j in divergence._blocks(lengths) for a, b in zip(i, j, strict=True)]
        starts = np.concatenate(([0], np.cumsum(lengths)))
        want = [(a, b) for lo, hi in zip(starts[:-1], starts[1:], strict=True) for a in range(lo, hi) for b in range(a + 1, hi)]
        assert sorted(got) == want and len(got) == len(set(got))


def test_terms_of_a_long_text_in_pieces(monkeypatch):
    text = "Abc éé1x y " * 50 + "w" * 40 + " end"
    want = [x.encode() for x in TERM.findall(lower(text))]
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(divergence, "PIECE", piece)
        assert [x for some in divergence.terms(text.encode()) for x in some] == want


def test_empty_tables_and_texts(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    rows = [(1, None, "en", "a"), (2, "few", "en", "b")]
    assert {tuple(x) for x in divergence.audit(frame(spark, rows)).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
