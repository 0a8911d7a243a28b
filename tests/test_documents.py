"""Reports, summaries, predicates on explanations, captured chunks and small configuration, on literal expectations."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tests.test_engine import col, files, issues
from tidewrack.functions import columns as C
from tidewrack.operators import documents, explain, planning, score, search
from tidewrack.sources import chunks, store

META = "mode string, generated timestamp, seconds int, confidence int, commit_go string, push_go string, reused_from string, bypassed boolean, skipped boolean"


def meta(spark, **over):
    row = {"mode": "review", "generated": datetime.datetime(2026, 1, 2, 3, 4), "seconds": 61, "confidence": 80, "commit_go": "GO", "push_go": "NO-GO", "reused_from": None, "bypassed": False, "skipped": None} | over
    return spark.createDataFrame([tuple(row.values())], META)


def test_summary(spark):
    d = issues(spark, {"severity": "LOW"}, {"file": "b.py", "line": 2}, {"file": "a.py", "line": 9, "codeExample": " "}, {"severity": "CRITICAL", "codeExample": "x\n" * 42})
    got = documents.text(documents.pr_summary(d, meta(spark, bypassed=True), d.limit(1)))
    head, *rest = got.split("#### ")
    assert head == "## Summary for review\n\n**Gate confidence:** 80%\n**Counts:** Critical 1, High 2, Medium 0, Low 1\n**LLM:** bypassed (scanners clean at triage floor)\n**Suppressed (audit):** 1\n\n## Suggested fixes (critical and high)\n\n"
    assert [x.split("\n")[1] for x in rest] == ["- **Where:** `a.py:1`", "- **Where:** `a.py:9`", "- **Where:** `b.py:2`"]
    assert rest[0].count("x\n") == 40 and "# truncated (2 more line(s))" in rest[0]
    assert "Example" not in rest[1] and "Fingerprint" not in got and got.endswith(f"\n\n{documents.CLOSING}\n")
    none = documents.text(documents.pr_summary(d.where("severity = 'LOW'"), meta(spark)))
    assert "_No critical or high findings._" in none and "**LLM:**" not in none and "Suppressed" not in none


def test_report(spark, tmp_path):
    d = issues(spark, {"priority": "P3", "title": "z"}, {"title": "a"}, {"title": "b"}).withColumn("fixTiming", F.when(F.col("ord") == 2, "immediately").otherwise("before launch"))
    runs = spark.createDataFrame([(0, "osv", "ran", "", 3), (1, "trivy", "skipped", "not found", 0)], "ord long, tool string, status string, detail string, n_findings long")
    gaps = spark.createDataFrame([(0, "coverage:sec.x: missed"), (1, "no backups")], "ord long, gap string")
    doc = documents.report(d, meta(spark), runs, gaps, d.limit(0).withColumn("reason", F.lit("")))
    got = documents.text(doc)
    heads = [x for x in got.split("\n") if x.startswith(("# ", "## "))]
    assert heads == ["# Review report, 2026-01-02 03:04 UTC", "## Gate verdict", "## Finding fields", "## P1 - Security", "## P2 - Bugs, reliability, performance", "## P3 - Architecture and quality", "## Automated scanners", "## Suppressed", "## Plan to fix", "## Durability gaps"]
    assert got.index("] a\n") < got.index("] b\n") < got.index("_No findings in this band._") < got.index("] z\n")
    assert "- **osv**: `ran` (3 finding(s))\n" in got and "- **trivy**: `skipped`, not found\n" in got
    assert "## Suppressed\n\n_None._" in got and "1. **b** (`a.py:1`): f" in got and "- [ ] no backups" in got and "sec.x: missed" not in got
    assert "**Duration:** 1m 1s (61s)\n" in got
    documents.write(doc, f"{tmp_path}/r")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert lines.rstrip("\n") == got.rstrip("\n")


def test_explanations(spark):
    moves = ["load_all (10-20) -> src/loading.py", "notes"]
    steps = {"": True, "  ": True, None: True, "do it -> now": False, "move LOAD_ALL": False, "preload_all it": True, "to loading.py": False, "to loading": False, "see notes": False, "see notes_b": True}
    steps |= {"x" * 47: True, "x" * 48: False, "x" * 60 + " as appropriate": True, "Refactor " + "x" * 100: True, "Refactor " + "x" * 180: False}
    vague = col(spark, list(steps), lambda c: explain.is_vague(c, F.array(*map(F.lit, moves))))
    assert dict(zip(steps, vague, strict=True)) == steps
    assert col(spark, ["x" * 50], lambda c: explain.is_vague(c, F.lit(None).cast("array<string>"))) == [False]
    rows = [(["a utils_module"], ["t"], 1), (["autils_module"], ["t"], 1), ([""], ["Split by responsibility", "Modularize"], 0), ([""], ["Split by responsibility", "Modularize"], 1), (None, None, None)]
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, texts array<string>, titles array<string>, n int").orderBy("k")
    assert [r[0] for r in d.select(explain.is_boilerplate(F.col("texts"), F.col("titles"), F.col("n"))).collect()] == [True, False, True, False, False]


def test_chunks(spark):
    line = lambda x: f"data: {json.dumps(x)}"
    choice = lambda c: line({"choices": [{"delta": {"content": c}}]})
    block = lambda t, kind="text_delta": line({"type": "content_block_delta", "delta": {"type": kind, "text": t}})
    lines = [choice("a b"), " " + choice("") + "\r", choice(3), line({"choices": []}), line([1]), "data: [DONE]", "data:", "data: {", "event: x", None, block("z")]
    assert col(spark, lines, lambda c: chunks.piece(c, "choices")) == ["a b", "", *[None] * 9]
    assert col(spark, [block("z"), block("z", "other"), block(None), choice("a"), line({"type": "ping"})], lambda c: chunks.piece(c, "blocks")) == ["z", None, None, None, None]
    with pytest.raises(ValueError):
        chunks.piece(F.lit(""), "other")
    rows = [(1, 2, choice("b"), 2.0), (1, 1, choice("a"), 1.0), (2, 1, "data: [DONE]", 1.0), (3, 1, choice("c"), 1.0), (3, 2, "x", 9.0)]
    d = spark.createDataFrame(rows, "answer int, ord int, line string, seconds double")
    assert sorted(map(tuple, chunks.fold(d, "choices", 5.0).collect())) == [(1, "ab", "ok"), (2, "", "empty"), (3, "c", "late")]
    assert {r.status for r in chunks.fold(d, "choices").collect()} == {"ok", "empty"}
    assert chunks.fold(d.limit(0), "choices", 5.0).count() == 0


def test_labels(spark):
    when = lambda c: c.cast("timestamp")
    assert col(spark, ["2026-08-05 14:30:59"], lambda c: C.report_name(F.lit(" Full Audit "), when(c))) == ["review_report_full_audit_2026-08-05_1430"]
    assert col(spark, ["2026-08-05 14:30:59"], lambda c: C.report_name(F.lit(None).cast("string"), when(c))) == ["review_report_review_2026-08-05_1430"]
    assert col(spark, ["sec", "", ".", "..", "a/b", "a\\b", None, "a..b"], C.is_safe_rule_id) == [True, False, False, False, False, False, False, True]
    label = lambda *a: spark.range(1).select(documents.status_label(*[F.lit(x).cast(t) for x, t in zip(a, ("string", "boolean", "boolean"), strict=True)])).first()[0]
    assert [label("r1", True, True), label("", True, True), label(None, None, True), label(None, None, None)] == ["reused from r1", "bypassed (scanners clean at triage floor)", "skipped (no file delta; no prior snapshot)", None]
    stats = planning.inventory_stats(files(spark, {f"f{k}.py": "x" for k in range(3)}), 2)
    assert documents.truncation_note(stats, 2).first()[0].startswith("Inventory truncated: 2 of 3 matched files (max_files=2)")
    assert documents.truncation_note(planning.inventory_stats(files(spark, {"a.py": "x"}), 2), 2).first()[0] is None


def test_configuration(spark):
    ok = {"entries": [{"id": "a.b", "rule_id": "r"}, 7, {"id": "c", "rule_id": "s", "band": "P1", "pack": "META", "full_audit_only": True}]}
    assert [tuple(r) for r in score.load_matrix(spark, json.dumps(ok)).orderBy("ord").collect()] == [(0, "a.b", "r", "p3", False, "core"), (1, "c", "s", "p1", True, "meta")]
    for bad in ({"entries": {}}, {"entries": [{"id": 1, "rule_id": "r"}]}, {"entries": [{"id": "a", "rule_id": "r", "pack": "other"}]}):
        with pytest.raises(ValueError):
            score.load_matrix(spark, json.dumps(bad))
    rules = spark.createDataFrame([("security", "S"), ("reliability", "R"), ("architecture", "A")], "id string, body string")
    books = lambda *a: [tuple(r) for r in planning.playbooks(rules, *a).orderBy("ord").select("label", "body").collect()]
    assert books("sentinel") == [("P1 security", "S")] and books("architecture") == [("P3 architecture", "A")]
    assert books("review", True) == [("P1 security", "S"), ("P2 reliability", "R"), ("P3 architecture", "A")]
    assert books("review")[2] == ("P3 architecture (scoped)", planning.SCOPED)
    with pytest.raises(KeyError):
        books("other")
