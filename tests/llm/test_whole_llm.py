"""The training-data queries do the whole job: inputs that an earlier form left out."""

import itertools
import math
import random

from tidewrack.llm import decontaminate, langid, stages


def test_decontamination_finds_short_items(spark):
    item = lambda name, n: [f"{name}{k}" for k in range(n)]
    items = {1: item("a", 15), 2: item("b", 12), 3: item("c", 9), 4: item("d", 5), 5: item("e", 1), 6: [], 7: item("f", 30)}

    def changed(words, *at):
        return [f"pre{k}" for k in range(4)] + ["other" if k in at else w for k, w in enumerate(words)] + ["post"] * 3

    texts = {1: changed(items[1], 5, 10), 2: changed(items[2], 5), 3: changed(items[3], 4), 4: changed(items[4]), 5: items[5], 6: changed(items[4], 2), 7: changed(items[7][:9]), 8: items[4], 9: []}
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    for limit in (10**6, 3):
        got = {(x.doc_id, x.item_id): (x.score, x.n_matched) for x in decontaminate.overlaps(docs, bench, limit=limit).collect()}
        assert got == {(1, 1): (9, 13), (2, 2): (9, 11), (3, 3): (6, 8), (4, 4): (5, 5), (5, 5): (1, 1), (8, 4): (5, 5)}


def test_decontamination_finds_each_change_of_short_items(spark):
    """Every single change from 8 words on, and every pair of changes from 10 words on, wherever they stand."""
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(8, 15)}
    docs, want = [], set()
    for n, words in items.items():
        for c in (1, 2) if n >= 10 else (1,):
            for at in itertools.combinations(range(n), c):
                d = len(docs)
                docs.append((d, " ".join(["lead", "in", *("other" if k in at else w for k, w in enumerate(words)), "end"])))
                want.add((d, n))
    docs.append((len(docs), " ".join(w for n in items for w in items[n][: n // 2])))  # halves are no passages
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    for limit in (10**6, 3):
        got = {(x.doc_id, x.item_id) for x in decontaminate.overlaps(d, b, limit=limit).collect()}
        assert got == want


def test_near_dedup_stage_tells_texts_of_one_id_apart(spark):
    r = random.Random(4)
    a, b, c, d = (" ".join(f"{x}{r.randint(0, 99)}" for _ in range(60)) for x in "abcd")
    rows = [(2, a), (1, b), (1, c), (1, c), (2, b), (3, a + " tail"), (3, d), (0, d + " tail"), (None, a), (None, a), (4, None), (4, ""), (5, "few words")]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, key string")
    got = stages.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    want = [(2, a), (1, b), (1, c), (0, d + " tail"), (None, a), (None, a), (4, None), (4, ""), (5, "few words")]
    assert sorted([(x.doc_id, x.text) for x in got.collect()], key=str) == sorted(want, key=str)


def test_language_id_learns_every_label(spark, monkeypatch):
    rows = [(k * 100 + i, f"{chr(0x4E00 + 40 * k)}{chr(0x4E01 + 40 * k)} " * 40, f"l{k:02}") for k in range(70) for i in range(12 if k < 69 else 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.langs == [f"l{k:02}" for k in range(70)]
    monkeypatch.setattr(langid, "SAMPLE", 140)  # two documents of each
    assert langid.fit(docs).langs == model.langs


def plain_prediction(model, text):
    """lang and score of a text by the network's definition, number by number."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    raw, sums, weights = text.encode(), [0.0] * len(model.langs), 0
    for at in range(0, max(1, len(raw)), langid.WINDOW):
        x = raw[at : at + langid.WINDOW]
        weight, x = max(1, len(x)), x.ljust(langid.WINDOW)
        features = []
        for w in langid.WIDTHS:
            table, bias = model.tables[w].tolist(), model.bias[w].tolist()
            for f in range(langid.FILTERS):
                best = max(sum(table[j][x[i + j]][f] for j in range(w)) for i in range(len(x) - w + 1))
                features.append(max(0.0, best + bias[f]))
        z = [sum(a * d[k] for a, d in zip(features, model.dense.tolist(), strict=True)) + float(model.offset[k]) for k in range(len(model.langs))]
        e = [math.exp(v - max(z)) for v in z]
        sums = [s + weight * v / sum(e) for s, v in zip(sums, e, strict=True)]
        weights += weight
    best = max(range(len(sums)), key=lambda k: sums[k])
    return model.langs[best], sums[best] / weights


def test_predictions_equal_the_network_by_its_definition(spark):
    r = random.Random(2)
    rows = [(k, f"{'ab' if k % 2 else 'xy'}{'é' * (k % 3)} " * r.randint(2, 40), "l1" if k % 2 else "l2") for k in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model.bias = {w: b + 0.1 * w for w, b in model.bias.items()}
    texts = [None, "", "12 34", "a", "ab" * 128, "ab" * 128 + "x", "xyé " * 150, "Ω ß \U0001f600 x", *(t for _, t, _ in rows[:6])]
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, t in enumerate(texts):
        lang, score = plain_prediction(model, t)
        assert got[k].lang_pred == lang and abs(got[k].score - score) < 1e-4, (k, t)
