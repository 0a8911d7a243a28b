"""The segment index against a fresh build, over many differences; stems; what a reader touches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewrack.functions import columns as C
from tidewrack.operators import planning, search, segments
from tidewrack.shared import put_if_absent, read_small


def files(spark, d):
    return spark.createDataFrame([(k, v) for k, v in d.items()], "relative string, content string")


def diff(spark, old, new):
    prints = lambda d: files(spark, d).select(F.col("relative").alias("path"), C.file_hash(F.col("content")).alias("sha256"))
    return planning.fingerprint_diff(prints(old), prints(new))


def rows(d):
    return sorted(map(tuple, d.collect()))


def same(spark, index, tree):
    postings, docs = search.build(files(spark, tree))
    assert rows(index.postings().select(*postings.columns)) == rows(postings)
    assert rows(index.docs().select(*docs.columns)) == rows(docs)


def test_index_equals_a_fresh_build_after_each_difference(spark, tmp_path):
    fan, r = 2, random.Random(2)
    words = ["the", "one", "two", "é", "x9", "Tail", "tail"]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 12)))
    index, tree = segments.SegmentIndex(spark, str(tmp_path), buckets=4, fan=fan), {}
    for step in range(5):
        new = dict(tree)
        for k in range(12):
            if r.random() < 0.4:
                new[f"f{k}"] = text()
            elif r.random() < 0.2:
                new.pop(f"f{k}", None)
        index.apply(files(spark, new), diff(spark, tree, new))
        tree = new
        if step > 2:
            same(spark, index, tree)
    levels = [level for _, level in index.segments]
    assert all(levels.count(x) < fan for x in set(levels)) and levels == sorted(levels, reverse=True)
    assert not index.apply(files(spark, tree), diff(spark, tree, tree))
    again = segments.SegmentIndex(spark, str(tmp_path))
    assert (again.segments, again.buckets, again.number) == (index.segments, 4, index.number)
    got, want = index.query([["the"], ["two"]], 5), search.query(*search.build(files(spark, tree)), [["the"], ["two"]], 5)
    assert rows(got) == rows(want)
    again.sweep()
    same(spark, again, tree)
    assert len(list((tmp_path / "segments").iterdir())) == len(index.segments)


def test_postings_are_made_within_the_texts_rows(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    tree = {f"f{k}": " ".join(r.choice(["the", "é", "Tail", "x9-b", "w%d" % r.randint(0, 30)]) for _ in range(r.choice([0, 1, 9, 300]))) for k in range(40)} | {"…": "!"}
    # a path that two rows have, and a null one, which differences don't know
    twice = files(spark, tree).unionByName(spark.createDataFrame([("f1", "the the again"), (None, "the lost"), (None, "lost")], "relative string, content string"))
    want = {}
    for x in twice.where("trim(content) <> ''").select("relative", search.index_tokens(F.concat_ws(" ", "relative", "content")).alias("ts")).collect():
        for k, t in enumerate(x.ts):
            want.setdefault((t, x.relative), []).append(k)
    monkeypatch.setattr(search, "TOGETHER", 64)
    for lists in (search.build(twice, cap=None, packed=True)[0], search.pack(search.build(twice, cap=None)[0])):
        assert {(x.term, x.path): (x.tf, x["at"]) for x in search.unpack(lists).collect()} == {k: (len(v), sorted(v)) for k, v in want.items()}
    # tokens aren't dealt out: the one shuffle of a segment's write has lists
    postings, _ = search.build(files(spark, tree), packed=True)
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    got = search.phrase_frequencies(search.build(twice, cap=None)[0], [["the"], ["the", "again"]])
    assert [(x.q, x.tf) for x in got.where("path = 'f1'").orderBy("q").collect()] == [(0, len(set(want["the", "f1"]))), (1, 1)]


def test_the_kept_up_index_is_merged(spark):
    from tidewrack.plans import catalogue
    from tidewrack.shared import names

    tree = {f"f{k}": f"w{k % 5} common tail" for k in range(20)}
    new = {k: v + " changed" * (k < "f11") for k, v in tree.items() if k != "f7"} | {"g": "late w1", "blank": " "}
    index = catalogue._kept_up(spark, files(spark, tree), files(spark, new))
    # one segment of the next level, which has no entry of files that have changed or gone, and nothing else is left
    assert [level for _, level in index.segments] == [1]
    stored = search.unpack(index._read("postings", index.segments, segments.POSTINGS))
    assert rows(stored.select("term", "path", "tf")) == rows(search.build(files(spark, new), cap=None)[0].select("term", "path", "tf"))
    assert index._read("dead", index.segments, "path string").isEmpty()
    assert names(spark, f"{index.folder}/segments") == [index.segments[0][0]]
    same(spark, index, new)


def test_differences_beyond_a_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "bounded", lambda df: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tree = {f"f{k}": f"w{k % 5} common tail" for k in range(30)}
        new = {k: v + " changed" * (k < "f2") for k, v in tree.items() if k != "f7"}
        index = segments.SegmentIndex(spark, str(tmp_path), buckets=4)
        index.apply(files(spark, tree), diff(spark, {}, tree))
        same(spark, index, tree)
        index.apply(files(spark, new), diff(spark, tree, new))
        same(spark, index, new)
        plan = index.postings()._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_two_writers_both_count(spark, tmp_path):
    a, b = (segments.SegmentIndex(spark, str(tmp_path), buckets=2, fan=9) for _ in range(2))
    one, two = {"a": "one two"}, {"b": "two three"}
    assert a.apply(files(spark, one), diff(spark, {}, one)) and b.apply(files(spark, two), diff(spark, {}, two))
    assert b.number == 2
    same(spark, b, one | two)
    same(spark, a.refresh(), one | two)


def test_readers_touch_the_buckets_of_their_terms(spark, tmp_path):
    tree = {f"f{k}": f"w{k % 50} common" for k in range(200)}
    index = segments.SegmentIndex(spark, str(tmp_path), buckets=16)
    index.apply(files(spark, tree), diff(spark, {}, tree))
    got = index.postings(["w3"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    bucket = spark.range(1).select(segments.bucket_of(F.lit("w3"), 16)).first()[0]
    assert f"PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    read = {f.split("bucket=")[1].split("/")[0] for f in got.select(F.input_file_name().alias("f")).distinct().toPandas()["f"] if "bucket=" in f}
    assert read <= {str(bucket)} and got.count() == 4
    assert index.postings([]).count() == 0


def test_put_if_absent_names_a_file_once(spark, tmp_path):
    path = f"file://{tmp_path}/m/1.json"
    assert put_if_absent(spark, path, json.dumps([1])) and not put_if_absent(spark, path, "other")
    assert read_small(spark, path) == "[1]" and read_small(spark, path + "x") is None
    assert [p.name for p in (tmp_path / "m").iterdir()] == ["1.json"]


def test_stems_by_distinct_words(spark):
    tree = files(spark, {"a": "running runs the ties", "b": "tie run", "c": "  "})
    p, _ = search.build(tree, stem=True)
    got = {(x.term, x.path): (x.tf, sorted(x.at)) for x in p.collect()}
    assert got["run", "a"] == (2, [1, 2]) and got["run", "b"] == (1, [2]) and got["ti", "a"] == (1, [4])
    assert rows(search.build(tree, stem=True, only=["run"])[0].select("path", "tf")) == [("a", 2), ("b", 1)]


def test_pruned_search_equals_the_whole_one_and_skips_blocks(spark):
    r = random.Random(9)
    tree = {f"f{k}": " ".join(r.choice(["the", "rare", *["w%d" % (i % 40) for i in range(60)]]) for _ in range(r.choice([3, 10, 200]))) for k in range(600)}
    p, d = search.build(files(spark, tree), cap=None)
    p, d = p.cache(), d.cache()
    bounds = search.bounds(p, d, 128).cache()
    for terms in (["the", "rare"], ["w3"], ["w1", "w2", "w1"], ["none"]):
        got, counts = search.query_pruned(p, d, bounds, 128, terms, 5, probe=4)
        want = search.query(p, d, [[t] for t in terms], 5)
        assert [x.path for x in got.collect()] == [x.path for x in want.collect()]
        assert [x.score for x in got.collect()] == [pytest.approx(x.score) for x in want.collect()]
        n = counts.first()
        assert n.n_read <= n.n_blocks
    n = search.query_pruned(p, d, bounds, 128, ["the", "rare"], 5, probe=4)[1].first()
    assert n.n_read < n.n_blocks


def test_snippets_equal_another_engine(spark):
    import sqlite3

    r = random.Random(3)
    sep = [" ", " ", " ", ". ", ": ", "\n", ", ", " - "]
    tree = {f"f{k}": r.choice(["", "# "]) + "".join(r.choice(["alpha", "beta", "running", *["w%d" % i for i in range(30)]]) + r.choice(sep) for _ in range(r.choice([3, 20, 24, 25, 90]))) for k in range(120)}
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE c USING fts5(path, content, tokenize='porter unicode61')")
    db.executemany("INSERT INTO c VALUES (?, ?)", tree.items())
    for terms in (["alpha"], ["alpha", "beta", "run"], ["w3", "runs"]):
        want = dict(db.execute("SELECT path, snippet(c, 1, '', '', '…', 24) FROM c WHERE c MATCH ?", ["content: (" + " OR ".join(f'"{t}"' for t in terms) + ")"]))
        hits = spark.createDataFrame([(p, 0.0) for p in want], "path string, score double")
        got = {x.path: x.snippet for x in search.snippets(hits, files(spark, tree), terms, stem=True).collect()}
        assert got == want and len(got) > 20


def test_learned_context(spark):
    from tidewrack.operators import prompts

    hits = spark.createDataFrame([("b", -1.0, " two "), ("a", -2.0, ""), ("c", -1.0, None)], "path string, score double, snippet string")
    assert prompts.learned_context(hits).first().text == "## Local learning context (on-disk index)\n\n### a\n```\n(no snippet)\n```\n\n### b\n```\ntwo\n```\n\n### c\n```\n(no snippet)\n```\n"
    assert prompts.learned_context(hits.where("false")).first().text == ""
