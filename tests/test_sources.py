"""The tree source, bills of materials, rewritten gaps, and quotes of many issues in one file."""

import json
import os
import random
import subprocess

from pyspark.sql import functions as F

from tidewrack.operators import anchors, score
from tidewrack.sources import scanners, tree


def make(root, names):
    for n in names:
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"text of {n}")


def test_named_files_are_read_without_listing(spark, tmp_path, monkeypatch):
    make(tmp_path, [f"d{k % 5}/e{k % 3}/f{k}.py" for k in range(40)] + ["top.txt", "node_modules/x.js", "d0/.hid"])
    d = tree.read(spark, str(tmp_path), partitions="4")
    every = {x.relative for x in d.collect()}
    assert every == {f"d{k % 5}/e{k % 3}/f{k}.py" for k in range(40)} | {"top.txt", "d0/.hid"}
    for k in range(5):
        os.chmod(tmp_path / f"d{k}", 0o311)  # may be entered, not listed
    try:
        named = d.where(F.col("relative").isin("d1/e1/f1.py", "top.txt", "gone", "../x", "node_modules/x.js"))
        assert {x.relative: x.content for x in named.collect()} == {"d1/e1/f1.py": "text of d1/e1/f1.py", "top.txt": "text of top.txt"}
    finally:
        for k in range(5):
            os.chmod(tmp_path / f"d{k}", 0o755)
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0], plan
    assert {x.relative for x in d.where("relative = 'top.txt' and size > 0").collect()} == {"top.txt"}
    assert {x.relative for x in d.where("relative like 'd2/%'").collect()} == {x for x in every if x.startswith("d2/")}
    assert d.where("relative = 'a' and relative = 'b'").count() == 0


def test_filters_reach_the_reader(tmp_path):
    make(tmp_path, ["a/b/c.py", "a/x.py", "z/y.py"])
    r = tree._Reader({"path": str(tmp_path), "partitions": "2"})
    from pyspark.sql.datasource import EqualTo, In, StringStartsWith

    assert list(r.pushFilters([In(("relative",), ("z/y.py", "a/x.py", None))])) == []
    assert list(r.pushFilters([EqualTo(("relative",), "a/x.py")])) == []
    assert [p.names for p in r.partitions()] == [["a/x.py"]] and [p.trees for p in r.partitions()] == [[]]
    r = tree._Reader({"path": str(tmp_path), "partitions": "1"})
    left = list(r.pushFilters([StringStartsWith(("relative",), "a/b"), EqualTo(("size",), 3)]))
    assert len(left) == 2 and [x[0] for p in r.partitions() for x in r.read(p)] == ["a/b/c.py"]


def test_subtrees_are_walked_by_the_tasks(tmp_path, monkeypatch):
    make(tmp_path, [f"d{k}/s{k % 7}/t/f.py" for k in range(30)])
    r = tree._Reader({"path": str(tmp_path), "partitions": "4"})
    listed = []
    own = r._list
    monkeypatch.setattr(r, "_list", lambda t: listed.append(t) or own(t))
    parts = r.partitions()
    assert listed == [""] and sorted(sum((p.trees for p in parts), [])) == sorted(f"d{k}" for k in range(30)) and len(parts) == 4
    assert sorted(x[0] for p in parts for x in r.read(p)) == sorted(f"d{k}/s{k % 7}/t/f.py" for k in range(30))


def test_changed_files_and_hashes(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    make(tmp_path, ["a.py", "d/b é.py", "c.py"])
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    (tmp_path / "d/b é.py").write_text("other")
    (tmp_path / "c.py").unlink()
    got = tree.read_changed(spark, str(tmp_path), "HEAD", withHash="true", withContent="false").collect()
    import hashlib

    assert [(x.relative, x.content, x.sha256) for x in got] == [("d/b é.py", None, hashlib.sha256(b"other").hexdigest())]
    git("commit", "-qam", "two")
    assert tree.read_changed(spark, str(tmp_path), "HEAD").count() == 0


def test_licences_of_several_documents(spark):
    lic = lambda *x: [{"license": {"id": i}} for i in x]
    boms = [{"components": [{"name": f"n{k}", "version": "1", "licenses": lic(f"L{k}")}, {"name": "bare"}]} for k in range(5)]
    boms.append({"components": [None, {"version": "2", "licenses": [{"license": "GPL-2.0"}, {"expression": " "}, {"license": {}}, {"license": {"url": "u"}}]}, {"name": "m", "licenses": []}]})
    boms.append({"components": [{"name": f"c{k:02}", "licenses": lic("MIT")} for k in range(50)]})
    raw = spark.createDataFrame([(k, json.dumps(b)) for k, b in enumerate(boms)] + [(9, "not json"), (10, None), (11, "{}")], "doc int, json string")
    x = scanners.supply_chain(raw).first()
    assert (x.n_components, x.n_licensed, x.n_copyleft, x.gap) == (10 + 2 + 50, 5 + 1 + 50, 1, "")
    assert x.license_ids == sorted(["L0", "L1", "L2", "L3", "L4", "GPL-2.0", "MIT"])
    notes = {}
    for n in scanners.license_notes(raw).orderBy("doc", "ord").collect():
        notes.setdefault(n.doc, []).append(n.note)
    assert notes[0] == ["n0@1: L0"] and notes[5] == ["package@2: GPL-2.0,  , unknown [copyleft — review distribution obligations]"] and notes[6] == [f"c{k:02}: MIT" for k in range(40)]
    assert scanners.license_ids(scanners.licenses(raw), 2).collect()[1].license == "L1"
    assert scanners.supply_chain(raw.where("doc = 9")).first().gap == "sbom: no document"


def test_licence_notes_are_cut_within_a_row(spark, tmp_path):
    from tidewrack.plans import views
    from tidewrack.plans.catalogue import QUERIES

    c = [{"name": f"c{k}", "licenses": [{"license": {"id": "MIT"}}] if k % 3 else []} for k in range(90)]
    raw = spark.createDataFrame([(1, json.dumps({"components": [None, *c]})), (2, json.dumps({"components": c[:2]}))], "doc int, json string")
    notes = scanners.license_notes(raw)
    assert [(n.doc, n.ord, n.note) for n in notes.collect()] == [(1, k + 1, f"c{k}: MIT") for k in range(60) if k % 3] + [(2, 1, "c1: MIT")]
    plan = notes._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    # a file of one group of rows is worked on by as many tasks as it has rows
    part = spark.range(3 * views.DEALT).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit(1).alias("p_size"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert QUERIES["license_notes"](spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_the_query_notes_every_licensed_component(spark, tmp_path):
    from tidewrack.plans.catalogue import ORACLES, QUERIES

    part = spark.range(100).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit(1).alias("p_size"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["license_notes"](spark, str(tmp_path))
    head = [(0, "n@1: MIT, b"), (1, "package: LGPL-2.1 [copyleft — review distribution obligations]"), (3, "odd: unknown")]
    want = [(k, *x) for k in range(100) for x in [*head, *((4 + i, "m: X") for i in range(k % 50))]]
    assert sorted(map(tuple, got.collect())) == want
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(db.execute(ORACLES["license_notes"]).fetchall()) == want


def test_rewritten_gaps_keep_valid_notes(spark):
    cov = spark.createDataFrame([(0, "sec.xxe", "na"), (1, "arch.i18n", "missed"), (2, "arch.pwa", "missed"), (3, "rel.concurrency", "missed")], "ord int, id string, status string")
    gaps = ["coverage:sec.xxe: N/A - no xml parser in the tree", "coverage:arch.i18n: N/A - not reviewed", "coverage:arch.i18n: N/A - not reviewed", "scanner:osv missing", "x coverage:arch.pwa: missed y", "scanner:osv missing"]
    got = score.rewrite_gaps(cov, spark.createDataFrame(list(enumerate(gaps)), "ord int, gap string")).orderBy("lane", "ord").collect()
    assert [x.gap for x in got] == [gaps[0], "coverage:arch.i18n: missed — lazy N/A rejected (not reviewed)", gaps[3], gaps[4], gaps[5], "coverage:rel.concurrency: missed — neither issue nor N/A"]


def test_many_quotes_of_one_file(spark):
    r = random.Random(4)
    text = "".join(r.choice(["ab", "c\n", "\r\n", "d ", "é", "\x0b", "abab"]) for _ in range(3000))
    issues = [(k, "./a.py", r.choice([None, 0, 1, 400, 900, 5000]), text[i : i + r.randint(1, 6)] if k % 9 else "absent!") for k in range(2500) for i in [r.randrange(len(text) - 6)]]
    issues += [(3000, "b.py", 1, "ab"), (3001, "a.py", 1, "  "), (3002, None, 1, "ab"), (3003, "../a.py", 1, "ab")]
    want, lines = {}, text.splitlines()
    for k, file, hint, quote in issues[:2500]:
        q, hint = quote.strip(anchors.BLANKS), 1 if hint is None else hint
        hits = [(abs(n - hint), n, t.find(q) + 1) for n, t in enumerate(lines, 1) if q and q in t]
        if hits:
            _, n, c = min(hits)
            want[k] = (n, n, c)
        elif q and q in text:
            n = text[: text.find(q)].count("\n") + 1
            want[k] = (n, n + q.count("\n"), None)
    d = spark.createDataFrame(issues, "ord long, file string, line int, quote string")
    f = spark.createDataFrame([("a.py", text), ("../a.py", "ab"), ("b.py", None), ("c.py", "ab")], "relative string, content string")
    for at_once in (4096, 100):
        got = {x.ord: (x.start_line, x.end_line, x.start_column) for x in anchors.nearest(d, f, at_once).collect()}
        assert got == want and len(got) > 1900


def test_store_gives_a_version_to_one_writer(spark, tmp_path, monkeypatch):
    from tidewrack.sources import store

    a, b = (store.Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    t = lambda **k: spark.createDataFrame(list(k.items()), "path string, sha256 string")
    a.upsert("fingerprints", t(x="1", y="1"))
    own, said = store.put_if_absent, []

    def put(session, path, text):
        if not said:
            said.append(None)
            said.append(b.upsert("fingerprints", t(z="9", y="2")))
        return own(session, path, text)

    monkeypatch.setattr(store, "put_if_absent", put)
    assert a.upsert("fingerprints", t(w="3"), t(x="").select("path")) == 3 and said[1] == 2
    assert sorted(map(tuple, a.latest("fingerprints").collect())) == [("w", "3"), ("y", "2"), ("z", "9")]
    said.clear()
    assert a.replace("fingerprints", t(q="1")) == 5 and said[1] == 4 and [tuple(r) for r in b.latest("fingerprints").collect()] == [("q", "1")]
    assert a.last_report() is None
    a.point("reports/1.json")
    b.point("reports/2.json")
    assert a.last_report() == "reports/2.json"


def test_appended_rules_are_checked_and_read_back(spark, tmp_path):
    import pytest

    from tidewrack.sources import rules, store

    s = store.Store(spark, f"file://{tmp_path}/s")
    entry = "stable_id string, file string, category string, reason string, note string, expires string"
    good = [("id-1", None, None, "wont_fix", None, None), (None, "a\\b.py", 'say "x"', "other", "n", "2030-01-02")]
    rules.append_rules(s, spark.createDataFrame(good[:1], entry))
    rules.append_rules(s, spark.createDataFrame(good[1:], entry))
    for bad in ((None, "f", None, "other", None, None), ("i", None, None, "because", None, None), (" ", None, None, "other", None, None), ("i", None, None, None, None, None)):
        with pytest.raises(ValueError):
            rules.append_rules(s, spark.createDataFrame([good[0], bad], entry))
    got = rules.appended_rules(s)
    assert [tuple(r)[:6] for r in got.orderBy("ord").collect()] == [(0, "id-1", None, None, "wont_fix", ""), (1, None, "a\\b.py", 'say "x"', "other", "n")]
    text = "\n\n".join(r.text for r in rules.ignore_text(got).orderBy("ord").collect())
    again = rules.ignore_rules(spark, text)
    assert [tuple(r) for r in again.orderBy("ord").collect()] == [tuple(r) for r in got.orderBy("ord").collect()]


def test_modes_of_a_review(spark):
    from tidewrack.plans import review
    from tidewrack.sources import rules

    f = spark.createDataFrame([("src/a.py", 9, "eval(x)\n")], "relative string, size long, content string")
    found = spark.createDataFrame([("HIGH", "sec.xxe", "src/a.py", 1, "XML entity"), ("LOW", "arch.api", "src/a.py", 1, "API")], "severity string, category string, file string, line int, title string")
    registry = spark.createDataFrame([("security", "p1", True, "S"), ("reliability", "p2", True, "R"), ("architecture", "p3", False, "A")], "id string, band string, enabled boolean, body string")
    notes = spark.createDataFrame([(0, "coverage:sec.ssrf: N/A - no outgoing requests in the tree"), (1, "coverage:sec.redos: N/A - not reviewed")], "ord int, note string")
    none = spark.createDataFrame([], rules.FEEDBACK)
    run = lambda mode, **k: review.run(f, found, rules.ignore_rules(spark, ""), none, "2026-01-01", mode=mode, registry=registry, notes=notes, **k)
    out = run("sentinel")
    status = {r.id: r.status for r in out["coverage"].collect()}
    assert set(status) == {i for b, i, *_ in score.MATRIX if b == "p1"} and status["sec.ssrf"] == "na" and status["sec.redos"] == "missed" and status["sec.xxe"] == "covered"
    gaps = [r.gap for r in out["gaps"].orderBy("lane", "ord").collect()]
    assert gaps[0] == "coverage:sec.ssrf: N/A - no outgoing requests in the tree" and gaps[1].startswith("coverage:sec.redos: missed") and not any("arch." in g for g in gaps)
    assert [r.band for r in out["passes"].collect()] == ["p1"] and [r.body for r in out["playbooks"].collect()] == ["S"]
    out = run("review", full_audit=False)
    assert {r.band for r in out["passes"].collect()} == {"p1", "p2"}
