"""The pipeline on a small folder against brute force, and each stage's columns."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.llm import stages

from tests.llm.test_llm import VOC, brute_near, brute_quality, brute_ratios

quality = pytest.importorskip("tidewrack.llm.quality")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    d = tmp_path_factory.mktemp("sf")
    base = [" ".join(r.choice(VOC) for _ in range(80)) for _ in range(40)]
    item = " ".join(r.choice(VOC) for _ in range(25))
    rows = [(i, base[i % 40] if i < 60 else " ".join(r.choice(VOC) for _ in range(60)), "en", f"s{i % 3}", 1, "x") for i in range(120)]
    rows += [(200, None, "en", "s0", 0, "x"), (201, "too short", "en", None, 9, "x"), (202, base[0] + " " + item, "en", "s1", 1, "x"), (203, "la la " * 200, None, "s1", 1, "x"), (5, base[5], "en", "s2", 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows


def test_stages(spark, folder):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, steps = docs.columns, []
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(f(spark, docs, d), "test")
        assert docs.columns == columns
        steps.append([(x.doc_id, x.text) for x in docs.collect()])
    # id 5 is there twice with equal texts, so that each id has one ratio; all documents count for both multinomials
    ratios = brute_ratios({(r[0], k): r[1] for k, r in enumerate(rows)}, {(r[0], k) for k, r in enumerate(rows) if r[0] < 120})
    good = [(r[0], r[1]) for k, r in enumerate(rows) if not brute_quality(r[1])[5] and ratios[r[0], k] >= quality.THRESHOLD]
    assert 0 < len(good) < len(rows) - 4
    assert sorted(steps[0]) == sorted(good)
    near = brute_near([k for k, _ in dict(good).items()], list(dict(good).values()))
    assert sorted(steps[1]) == sorted((k, t) for k, t in dict(good).items() if near[k][2])
    assert sorted(steps[2]) == sorted((k, t) for k, t in steps[1] if k != 202)
    assert set(steps[3]) <= set(steps[2]) and max(steps[3].count(x) for x in set(steps[3])) <= 3
    out = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    from tokenizers import Tokenizer

    from tidewrack.llm import tokens

    encode = Tokenizer.from_file(tokens.vocabulary()).encode
    at = 0
    for r, (k, t) in zip(sorted(out, key=lambda x: x.start), sorted(steps[3]), strict=True):
        ids = [*encode(t, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


CLASHES = (
    "key", "row", "nth", "size", "k", "n", "c", "copy", "m_key", "gone_key", "many_key", "component_id", "kept", "g", "first", "bad_id", "bad_hash", "hash", "r_id", "r_source", "r_size", "tidewrack_nth",
    "tidewrack_row", "w", "llr", "base_failed", "ratios", "start", "finish", "a.b", "tick",
)


def test_stages_keep_columns_of_any_name(spark, folder):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    wide = docs.drop("row").select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, d)
        assert got.columns == wide.columns, name
        got = got.collect()
        if name == "minhash_near_dedup":
            assert sorted((x.doc_id or -1, x.text or "") for x in stage(spark, docs, d).collect()) == sorted((x.doc_id or -1, x.text or "") for x in got)
        assert got and all(x[c] == f"own {c}" for x in got for c in CLASHES)
    ids = corpus_pipeline.STAGES[-1][1](spark, wide, d)
    assert ids.count() == len(rows)


def test_stages_take_empty_tables_and_very_long_texts(spark, folder):
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), d).count() == 0, name
    r = random.Random(6)
    long_ = " ".join(r.choice(VOC) for _ in range(60_000))
    item = spark.read.parquet(f"{d}/benchmark.parquet").first().text
    more = spark.createDataFrame([(900, long_, "en", "s0", 1, "x"), (901, long_ + " " + item, "en", "s0", 1, "x"), (902, long_, "en", "s1", 1, "x")], docs.schema)
    near = stages.near_dedup(spark, more, d)
    assert [x.doc_id for x in near.collect()] == [900]
    assert sorted(x.doc_id for x in stages.decontamination(spark, more, d).collect()) == [900, 902]
    got = {x.doc_id for x in stages.quality_rules(spark, docs.unionByName(more), d).collect()}
    assert {900, 901, 902} <= got or not {900, 901, 902} & got
