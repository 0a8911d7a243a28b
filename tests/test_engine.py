"""Operators on small inputs; ties, order and null rules included."""

import datetime
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidewrack.functions import columns as C
from tidewrack.operators import anchors, coerce, findings, heuristics, planning, score, search, sinks, symbols
from tidewrack.plans import review
from tidewrack.sources import rules, scanners, tree
from tidewrack.streaming import feedback as stream

ISSUE = "ord long, severity string, priority string, category string, file string, line int, title string, explanation string, impact string, recommendedFix string, codeExample string, cwe string, source string, locationVerified boolean"


def issue(ord=0, severity="HIGH", priority="P1", category="sec.x", file="a.py", line=1, title="t", explanation="e", impact="i", recommendedFix="f", codeExample="c", cwe=None, source=None, locationVerified=None):
    return (ord, severity, priority, category, file, line, title, explanation, impact, recommendedFix, codeExample, cwe, source, locationVerified)


def issues(spark, *rows):
    return spark.createDataFrame([issue(ord=k, **r) for k, r in enumerate(rows)], ISSUE)


def files(spark, d):
    return spark.createDataFrame([(k, len(v.encode()), v) for k, v in d.items()], "relative string, size long, content string")


def col(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").orderBy("k").select(f(F.col("v"))).collect()]


def test_path_functions(spark):
    assert col(spark, [".env", "a.tar.gz", "x/y", "a/.b.c", "Makefile"], C.suffix) == ["", ".gz", "", ".c", ""]
    assert col(spark, ["author.py", "x/Routes.ts", "lib/a.c"], C.band) == [1, 2, 3]
    assert col(spark, ["node_modules/a", "a/b.PNG", "a.min.js", "build.py", ".github/x"], C.is_ignored) == [True, True, True, False, False]
    assert col(spark, ["./a\\B", ".env"], C.norm_route) == ["a/B", "env"]
    assert col(spark, [" ./A\\b "], C.norm_match) == ["a/b"]
    assert col(spark, ["", "a", "a\n", "a\nb"], C.line_count) == [0, 1, 1, 2]
    text = "a\rb\r\nc\x0bd\x85e\u2028f\n"
    assert col(spark, [text, "x\n\ny", "", "\n"], C.split_lines) == [text.splitlines(), ["x", "", "y"], [], [""]]
    assert col(spark, ["README.md", "a/README.md", "a/b/x.md"], lambda c: c.rlike(C.glob_regex("**/*.md"))) == [False, True, True]
    assert col(spark, ["x in left-pad", "none", "CVE-2024-1234 for @a/b"], C.package_hint) == ["left-pad", "", "@a/b"]
    assert col(spark, ["see ghsa-ab12-cd34-ef56", "cve-2020-12345", "no"], C.advisory_id) == ["GHSA-AB12-CD34-EF56", "CVE-2020-12345", ""]
    assert col(spark, [59, 61, 3723], C.duration, "int") == ["59s", "1m 1s (61s)", "1h 2m 3s (3723s)"]
    assert col(spark, ["a%b:c\n"], C.escape_workflow) == ["a%25b%3Ac%0A"]
    assert col(spark, ["fatal: https://u:p@h/x\nmore"], C.redact_git) == ["fatal: https://***@h/x"]


def test_ids_equal_uuid5(spark):
    ns = uuid.UUID(C.NAMESPACE)
    keys = ["", "a|b", "é|ü", "x" * 100]
    assert col(spark, keys, C.uuid5) == [str(uuid.uuid5(ns, k)) for k in keys]
    r = issues(spark, {"category": " Sec.X ", "file": "A\\b.py", "title": " Two  Words\n"}).select(C.stable_id(F.col("category"), F.col("file"), F.col("title"), "p")).first()[0]
    assert r == str(uuid.uuid5(ns, "p|sec.x|a/b.py|Two Words"))


def test_coercions(spark):
    assert col(spark, ["crit", "P2", "very high risk", None, "info", "odd"], C.coerce_severity) == ["CRITICAL", "MEDIUM", "HIGH", "MEDIUM", "LOW", "MEDIUM"]
    assert col(spark, ["1", "x", "low"], lambda c: C.coerce_priority(c, F.lit("HIGH"))) == ["P1", "P1", "P3"]
    assert col(spark, ["Immediate!", "later", "after that", "", "before launch"], C.coerce_timing) == ["immediately", "if time permits", "after launch", "before launch", "before launch"]
    assert col(spark, ["true", "12", "3.9", '"L40-44"', "-2", '"none"'], lambda c: C.coerce_line(F.parse_json(c))) == [1, 12, 3, 40, 1, 1]
    assert col(spark, ["", "Not reviewed yet", "could be improved", "could be improved; no http here", "nothing to see"], C.is_lazy) == [True, True, True, False, False]
    assert col(spark, ["coverage:sec.x: N/A — no sql", "coverage:a.b:N/A - y", "other"], C.note_id) == ["sec.x", "a.b", ""]


def test_merge_cluster_and_dedupe(spark):
    d = issues(spark, {"title": "t", "severity": "LOW"}, {"title": "t", "severity": "HIGH"}, {"title": "u"})
    assert [r.ord for r in findings.merge_reports(d).orderBy("ord").collect()] == [0, 2]
    parts = spark.createDataFrame([(80, 1, 0), (55, 0, 2), (10, 0, 0)], "confidence int, n_issues int, n_gaps int")
    assert findings.merge_confidence(parts).first()[0] == 55 and findings.merge_confidence(parts.where("false")).first()[0] == 0
    d = issues(spark, {"severity": "MEDIUM", "title": "A b"}, {"severity": "HIGH", "title": "a  B", "line": 9}, {"severity": "HIGH", "title": "a b", "line": 8}, {"file": "z.py"})
    got = findings.cluster(d).orderBy("ord").collect()
    assert [(r.ord, r.severity, r.line, r.clusteredCount) for r in got] == [(0, "HIGH", 9, 3), (3, "HIGH", 1, None)]
    d = issues(spark, {"category": "trivy", "title": "CVE-2024-12345 in x: y"}, {"category": "osv", "title": "CVE-2024-12345 in X"}, {"category": "trivy", "title": "config"}, {"category": "osv", "title": "CVE-2024-99999 in x"})
    got = findings.sca_dedupe(d).orderBy("lane", "ord").collect()
    assert [(r.lane, r.ord, r.category) for r in got] == [(0, 2, "trivy"), (1, 0, "osv"), (1, 3, "osv")]


def test_calibrations(spark):
    d = issues(
        spark, {"category": "sec.injection", "explanation": "subprocess.run([a, b])"}, {"category": "sec.injection", "explanation": "subprocess.run([a], shell=True)"}, {"file": "tests/fixtures/a.py", "title": "secret"}, {"file": "examples/a.py", "explanation": "intentional"}, {"file": "examples/a.py"}, {"severity": "LOW", "file": "fixtures/k", "title": "token"}
    )
    got = findings.calibrate(d).orderBy("ord").collect()
    assert [r.severity for r in got] == ["LOW", "HIGH", "LOW", "LOW", "HIGH", "LOW"]
    assert got[0].explanation.startswith("[calibrated: subprocess_list_not_injection] ") and got[5].explanation == "e"
    assert findings.calibrate(d, ()).where("severity = 'LOW'").count() == 1
    f = spark.createDataFrame([("false_positive", "sec.x", "./A.py"), ("other", "sec.y", "b"), ("false_positive", "hot", ""), ("false_positive", "HOT ", None)], "reason string, category string, file string")
    d = issues(spark, {}, {"file": "b.py"}, {"category": "hot", "file": "q"}, {"category": "gitleaks hot"})
    assert [r.severity for r in findings.calibrate_by_feedback(d, f).orderBy("ord").collect()] == ["LOW", "HIGH", "LOW", "HIGH"]
    d = issues(spark, {"category": "heuristic.x"}, {"category": "sec.x"}, {"category": "my.semgrep"}, {"category": "other"})
    assert [r.priority for r in findings.coerce_bands(d).orderBy("ord").collect()] == ["P2", "P1", "P1", "P2"]


def test_suppression(spark):
    r = rules.ignore_rules(spark, '[[ignore]]\nreason="other"\nfile="./A.py"\ncategory="sec.x"\n[[ignore]]\nreason="wont_fix"\nstableId="ID1"\n[[ignore]]\nreason="other"\nfile="b.py"\ncategory="sec.x"\nexpires="2025-01-02"\n')
    d = issues(spark, {}, {"file": "b.py"}, {"file": "c.py"}).withColumn("stable_id", F.concat(F.lit("id"), F.col("ord") - 1))
    got = {x.ord: x.rule_ord for x in findings.suppress_by_rules(d, r, "2025-01-02").collect()}
    assert got == {0: 0, 1: 2, 2: 1}
    assert {x.ord: x.rule_ord for x in findings.suppress_by_rules(d, r, "2025-01-03").collect()} == {0: 0, 1: None, 2: 1}
    for bad in ('[[ignore]]\nfile="a"\ncategory="b"', '[[ignore]]\nreason="other"\nfile="a"', '[[ignore]]\nreason="nope"\nstableId="x"'):
        with pytest.raises(ValueError):
            rules.ignore_rules(spark, bad)
    f = files(spark, {"a.py": "1\n# tidewrack:disable x\n3\n4\n# tidewrack:enable\n6\n// tidewrack:disable-next-line\n8\n9 # tidewrack:disable\n10\n# tidewrack:disable-next-line"})
    assert [x.line for x in findings.disabled_lines(f).orderBy("line").collect()] == [3, 4, 8]
    d = issues(spark, {"line": 3}, {"line": 3, "category": "gitleaks"}, {"line": 6})
    assert [x.mechanism for x in findings.suppress_by_comments(d, f).orderBy("ord").collect()] == ["disable_comment", None, None]


def test_consistency_gate_and_lookup(spark):
    d = issues(spark, {"severity": "CRITICAL", "locationVerified": False}, {"severity": "CRITICAL", "locationVerified": True}, {"severity": "CRITICAL"}, {"severity": "CRITICAL", "locationVerified": False, "category": "osv"}, {"locationVerified": False})
    assert [r.severity for r in findings.consistency(d).orderBy("ord").collect()] == ["HIGH", "CRITICAL", "CRITICAL", "CRITICAL", "HIGH"]
    assert findings.consistency(d, True).orderBy("ord").collect()[4].severity == "MEDIUM"
    assert [r.explanation[:1] for r in findings.verify(d).orderBy("ord").collect()] == ["[", "e", "[", "[", "e"]
    dec = spark.createDataFrame([(0, 0, "LOW"), (1, 0, "HIGH"), (2, 4, "CRITICAL")], "n int, ord long, severity string")
    assert [r.severity for r in findings.apply_decisions(d, dec).orderBy("ord").collect()][::4] == ["HIGH", "HIGH"]
    assert findings.gate(issues(spark, {"severity": "MEDIUM"}), "high").first().failed is False
    assert findings.gate(d.where("false"), "LOW").first().failed is False
    assert tuple(findings.gate(d, "CRITICAL", scanner_only=True).first()) == (True, 1)
    with pytest.raises(ValueError):
        findings.gate(d, "bad")
    x = d.withColumn("runId", F.concat(F.lit("r"), "ord")).withColumn("stableId", F.lit("s"))
    assert findings.find_issue(x, "R3").first().ord == 3 and findings.find_issue(x, "s").first().ord == 0
    assert findings.violations(issues(spark, {"impact": " "}, {"severity": "LOW", "impact": ""}, {"severity": "BAD", "line": 0})).orderBy("ord").select("violations").collect() == [(["impact"],), ([],), (["severity", "line"],)]
    assert [r.ord for r in findings.reuse(issues(spark, {"title": "a"}), issues(spark, {"title": "b"}, {"title": "a"}, {"title": "b"})).orderBy("lane", "ord").collect()] == [0, 0]
    t = findings.tally(issues(spark, {"severity": "CRITICAL"}, {}, {"severity": "LOW"})).first()
    assert tuple(t) == (1, 1, 0, 1)


def test_heuristics(spark):
    body = "x\n" * 500
    f = files(spark, {"big.py": body, "docs/big.py": body, "a/x.md": body, "README.md": body, "v/ExtractToolView.swift": "", "v/ReplaceToolView.swift": "", "tests/fixtures/GetA.py": "", "tests/fixtures/SetA.py": "", "s/notarize.sh": "PASSWORD=1", "s/safe.sh": "password keychain", "s/low.sh": "passwd", "t.py": "# TODO\n" * 8, "package.json": "{}", "c.json": '{\n"tenantId": "12345678-1234-1234-1234-123456789abc",\n"clientSecret":\n "abcdefgh1"}', ".gitignore": "x\n"})
    got = {(r.file, r.category): r for r in heuristics.run(f, ["CLOUD", "nope"]).collect()}
    assert {k for k in got if k[1] == "heuristic.mega_file"} == {("big.py", "heuristic.mega_file"), ("README.md", "heuristic.mega_file")}
    assert [k[0] for k in got if k[1] == "heuristic.sibling_duplication"] == ["v/ExtractToolView.swift"]
    assert {k[0]: r.severity for k, r in got.items() if k[1] == "heuristic.scripts_hygiene"} == {"s/notarize.sh": "MEDIUM", "s/low.sh": "LOW"}
    assert ("t.py", "heuristic.todo_density") in got and ("package.json", "heuristic.ci_gaps") in got and ("s/low.sh", "heuristic.gitignore_secrets") in got
    cloud = sorted((r.line, r.severity) for r in heuristics.cloud_pack(f).collect())
    assert cloud == [(2, "MEDIUM"), (3, "HIGH")]
    assert heuristics.hot_paths(heuristics.run(f, ["cloud"])).count() == 4


def test_planning(spark):
    f = files(spark, {"z.py": "", "auth.py": "", "api/b.py": "", "dist/x": "", "big": "x" * 30})
    assert [r.relative for r in planning.inventory(f, 3, 20).collect()] == ["auth.py", "api/b.py", "z.py"]
    assert tuple(planning.inventory_stats(f, 2, 20).first()) == (3, 2, True)
    s = lambda d: spark.createDataFrame(list(d.items()), "path string, sha256 string")
    diff = planning.fingerprint_diff(s({"a": "1", "b": "1", "c": "1"}), s({"a": "1", "b": "2", "auth.py": "9"}))
    assert dict(map(tuple, diff.collect())) == {"a": "unchanged", "b": "changed", "c": "deleted", "auth.py": "added"}
    disk = spark.createDataFrame([("c",)], "relative string")
    assert planning.classify_deleted(diff, disk).collect() == [("c", "dropped")]
    inv = planning.inventory(f, 0, 20)
    assert {r.relative for r in planning.adaptive_pack(inv, diff, "auto").collect()} == {"auth.py"}
    assert planning.adaptive_pack(inv, diff.where("false"), "auto").count() == 3 and planning.adaptive_pack(inv, diff.where("false"), "changed").count() == 0
    d = issues(spark, {"source": "scanner", "file": "./q"}, {"source": "scanner", "file": "p"}, {"source": "scanner", "file": "q"}, {"source": "llm", "file": "r"}, {"source": "scanner", "severity": "LOW", "file": "s"})
    assert [r.pack_file for r in planning.triage(d).collect()] == ["q", "p"]
    assert [r.pack_file for r in planning.triage(d, changed=spark.createDataFrame([("p",)], "relative string")).collect()] == ["p"]
    assert planning.triage(d, changed=spark.createDataFrame([], "relative string")).count() == 0
    b = spark.createDataFrame([("g", k, n, str(k)) for k, n in enumerate([100, 400, 300, 50])], "grp string, ord long, size long, relative string")
    assert [r["size"] for r in planning.budget_pack(b, 500).orderBy("ord").collect()] == [100, 400]
    assert [r["size"] for r in planning.budget_pack(b, 460).orderBy("ord").collect()] == [100, 300, 50]
    runs = spark.createDataFrame([(k, "ok", float(v)) for k, v in enumerate([10, 20, 100, 30, 40])], "id int, outcome string, llm_seconds double")
    assert planning.timeout_p95(runs, 1.5, 1.0, 1000.0).first()[0] == 150
    p = planning.deep_passes(spark.createDataFrame([("security", "p1", True), ("architecture", "p3", False)], "id string, band string, enabled boolean"), score.matrix(spark), "review").collect()
    assert [r.band for r in p] == ["p1"] and p[0].coverage_ids[0] == "sec.injection" and len(p[0].coverage_ids) == 9
    t = "id string, band string, enabled boolean, title string, body string"
    r = planning.rules_with_overlays(spark.createDataFrame([("a", "p1", True, "T", "B")], t), spark.createDataFrame([("a", None, False, "U", None), ("x", "p1", True, "", "")], t), spark.createDataFrame([("a", None, None, "P", None)], t)).collect()
    assert r == [("a", "p1", False, "P", "B")]
    pref = planning.prefer(b, spark.createDataFrame([("2",)], "relative string"), spark.createDataFrame([("1",), ("2",)], "relative string"))
    assert [x.relative for x in pref.orderBy("lane", "ord").collect()] == ["2", "1", "0", "3"]


def cov(spark, missed=(), invalid=(), covered=()):
    rows = [(k, i, "covered" if i in covered else "missed", None, i in invalid) for k, i in enumerate([*missed, *covered])]
    return spark.createDataFrame(rows, "ord int, id string, status string, reason string, invalid boolean")


def test_scores(spark):
    ps = lambda **k: spark.createDataFrame(list(k.items()), "name string, confidence int")
    runs = spark.createDataFrame([("osv", "ran")], "tool string, status string")
    none = issues(spark, {}).where("false")
    m = lambda p, c, r=runs.where("false"), i=none: score.audit_metrics(p, c, r, i).first()
    assert m(ps(p1=95), cov(spark, ["sec.a", "sec.b"])).security == 87
    assert m(ps(p1=95), cov(spark, ["sec.a"], ["sec.a"])).security == 88
    assert m(ps(p1=100), cov(spark, [f"sec.{k}" for k in range(20)])).security == 60
    x = m(ps(security=95), cov(spark), runs)
    assert (x.gate, x.security, x.architecture, x.reliability) == (95, 100, None, None)
    assert m(ps(p1=100), cov(spark), i=issues(spark, {}, {})).security == 80
    assert m(ps(p2=90).where("false"), cov(spark, ["sec.a"])).gate == 0
    ids = spark.createDataFrame([(0, "sec.secrets"), (1, "sec.repo_hygiene_secrets"), (2, "arch.api"), (3, "rel.performance"), (4, "arch.i18n")], "ord int, id string")
    notes = spark.createDataFrame([(0, "coverage:rel.performance: N/A - not present"), (1, "coverage:arch.i18n: N/A - not reviewed"), (2, "coverage:sec.secrets: N/A - no sql")], "ord int, note string")
    got = {r.id: (r.status, r.invalid) for r in score.evaluate_coverage(ids, issues(spark, {"category": "heuristic.gitignore_secrets"}, {"title": "rapid"}), notes).collect()}
    assert got == {"sec.repo_hygiene_secrets": ("covered", False), "arch.api": ("covered", False), "rel.performance": ("na", False), "arch.i18n": ("missed", True)}
    assert len(score.MATRIX) == 45 and len(score.MAPPED) == 37
    assert score.theme_breakdown(score.matrix(spark), cov(spark), none).count() == 18
    assert score.theme_breakdown(score.matrix(spark), cov(spark), none, full=True).count() == 43
    assert score.actionability(none).first().fix_readiness is None
    a = score.actionability(issues(spark, {"source": "llm", "locationVerified": True}, {"severity": "LOW", "codeExample": " ", "locationVerified": False})).first()
    assert (a.total_issues, a.critical_high_with_example, a.medium_low_with_example, a.fix_readiness, a.location_unverified) == (2, 1, 0, 0.5, 1)


def test_anchors_and_usage(spark):
    f = files(spark, {".env": "k = 1\nx\nk = 1\n", "b.py": "one\ntwo\nthree\n", "c.py": "import left_pad\n", "d.js": "require('left-padder')"})
    q = spark.createDataFrame([(0, "./.env", 3, "k = 1"), (1, ".env", 2, "k = 1"), (2, "b.py", 1, "two\nthree"), (3, "b.py", 1, "none"), (4, "../b.py", 1, "one"), (5, ".env", None, "k = 1")], "ord long, file string, line int, quote string")
    got = {r.ord: (r.start_line, r.end_line, r.start_column) for r in anchors.nearest(q, f).collect()}
    assert got == {0: (3, 3, 1), 1: (1, 1, 1), 2: (2, 3, None), 5: (1, 1, 1)}
    d = issues(spark, {"file": "b.py", "line": 9}, {"file": "b.py", "category": "osv"}, {"file": "zz", "category": "osv"})
    a = spark.createDataFrame([(0, 2)], "ord long, start_line int")
    assert [(r.line, r.locationVerified) for r in anchors.stamp(d, a, f).orderBy("ord").collect()] == [(2, True), (1, True), (1, False)]
    names = ["left-pad", "nope", None, "left-pad", "@a/b-c", "b.py", "padder", "a+b", "dist-only", " re-quests "]
    f = f.unionAll(files(spark, {"x.ts": 'import z from "@a/b-c"', "node_modules/y.js": "dist-only", "e.md": "see re-quests", "big.txt": "nope " * 90_000, "h.png": "nope"}))
    p = issues(spark, *[{"category": "semgrep" if k == 3 else "trivy"} for k in range(len(names))])
    p = p.withColumn("packageName", F.element_at(F.array(*map(F.lit, names)), (F.col("ord") + 1).cast("int")))
    yes, no = "referenced_in_source", "no_reference_found"
    assert [r.usageHint for r in anchors.usage_hints(p, f).orderBy("ord").collect()] == [yes, no, None, None, yes, no, yes, no, no, yes]


def test_search_equals_fts5(spark):
    sqlite3 = pytest.importorskip("sqlite3")
    r = random.Random(1)
    words = "connect connection connected relational hopeful running flies authenticate_user authenticate user token".split()
    docs = {f"f{k}.py": " ".join(r.choice(words) for _ in range(r.randint(3, 40))) for k in range(30)}
    text = "authenticate_user connections running hop token token"
    terms = search.query_terms(text)
    assert terms == ["authenticate_user", "connections", "running", "hop", "token", "token"]
    p, d = search.build(files(spark, docs), stem=True)
    got = {x.path: x.score for x in search.query(p, d, [[search.porter(w) for w in t.split("_")] for t in terms], 100).collect()}
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table c using fts5(path, content, tokenize='porter')")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    db.executemany("insert into c values (?, ?)", docs.items())
    want = dict(db.execute("select path, bm25(c) from c where c match ?", (" OR ".join(f'"{t}"' for t in terms),)))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


def test_scanner_reports(spark):
    js = {
        "gitleaks": [{"File": "a.env", "StartLine": 0, "RuleID": "aws"}, {"Description": "d"}],
        "semgrep": {"results": [{"check_id": "r", "path": "p", "start": {"line": 4}, "extra": {"severity": "ERROR", "message": "m"}}, {"extra": {"severity": "INFO"}}]},
        "osv": {"results": [{"source": {"path": "lock"}, "packages": [{"package": {"name": "x"}, "vulnerabilities": [{"id": "CVE-1", "summary": "s"}, {"id": "CVE-2"}]}]}]},
        "trivy": {"Results": [{"Target": "t", "Vulnerabilities": [{"VulnerabilityID": "CVE-3", "PkgName": "p", "Severity": "CRITICAL", "InstalledVersion": "1"}]}, {"Target": "u", "Misconfigurations": [{"ID": "M", "CauseMetadata": {"StartLine": 12}, "Severity": "LOW"}]}]},
        "checkov": [{"results": {"failed_checks": [{"check_id": "C", "repo_file_path": "/x/main.tf", "file_line_range": [4, 9], "severity": None}]}}],
    }
    rows = [(k, "ran", json.dumps(v)) for k, v in js.items()]
    rows[0] = ("gitleaks", "ran", "{not json")
    found, runs = scanners.run(spark.createDataFrame(rows, "tool string, status string, json string"), list(js))
    assert {(r.tool): (r.status, r.n_findings) for r in runs.collect()} == {"gitleaks": ("failed", 0), "semgrep": ("ran", 2), "osv": ("ran", 2), "trivy": ("ran", 2), "checkov": ("ran", 1)}
    got = {(r.category, r.title): (r.severity, r.priority, r.file, r.line) for r in found.collect()}
    assert got["semgrep", "Semgrep: r"] == ("HIGH", "P1", "p", 4) and got["semgrep", "Semgrep: semgrep"] == ("LOW", "P2", "unknown", 1)
    assert got["osv", "CVE-1 in x"] == ("HIGH", "P1", "lock", 1) and got["trivy", "M: M"] == ("LOW", "P1", "u", 12)
    assert got["checkov", "C: C"] == ("MEDIUM", "P1", "x/main.tf", 4)
    g = scanners.gitleaks(spark.createDataFrame([(json.dumps(js["gitleaks"]),)], "json string")).collect()
    assert [(r.file, r.line, r.title) for r in g] == [("a.env", 1, "Secret detected: aws"), ("unknown", 1, "Secret detected: d")]
    assert scanners.resolve("off") == [] and scanners.resolve("Trivy, osv") == ["trivy", "osv"]
    with pytest.raises(ValueError):
        scanners.resolve("nmap")
    sbom = {"components": [{"name": "a", "licenses": [{"license": {"id": "MIT"}}, {"expression": "AGPL-3.0"}]}, {"name": "b"}]}
    lic = scanners.licenses(spark.createDataFrame([(json.dumps(sbom),)], "json string"))
    assert [(r.license, r.copyleft) for r in lic.collect()] == [("MIT", False), ("AGPL-3.0", True)]
    assert [r.license for r in scanners.license_ids(lic).collect()] == ["AGPL-3.0", "MIT"]


def test_model_output(spark):
    raws = [
        '```json\n{"confidence": "72%", "gaps": "one", "findings": [{"title": "T", "severity": "crit", "line": "L7"}, {"issue": {"name": "N", "description": "D"}, "severity": "low"}, "just text", {}, {"title": "H", "severity": "HIGH", "impact": ""}]}\n```',
        'noise {"confidence": 140, "issues": []} tail',
        "not json",
    ]
    p = coerce.parse(spark.createDataFrame(list(enumerate(raws)), "k int, raw string"))
    rep = coerce.reports(p).orderBy("k").collect()
    assert [(r.confidence, r.gaps, r.strict) for r in rep] == [(72, ["one"], True), (100, [], False), (0, [], False)]
    got = coerce.issues(coerce.reports(p), "k").orderBy("ord").collect()
    assert [(r.title, r.severity, r.priority, r.line) for r in got] == [("T", "CRITICAL", "P1", 7), ("N", "LOW", "P3", 1), ("just text", "MEDIUM", "P2", 1), ("H", "HIGH", "P1", 1)]
    assert got[0].impact != "" and got[3].impact == "" and got[3].codeExample != "" and got[1].explanation == "D"
    a = spark.createDataFrame([("p1", 1, True, True), ("p2", 1, True, False), ("p3", 1, False, False), ("p3", 2, True, True), ("p4", 1, False, True), ("p4", 2, False, True)], "pass string, attempt int, valid boolean, strict boolean")
    assert {r["pass"]: r.layer for r in coerce.layers(a).collect()} == {"p1": "ok", "p2": "coerced", "p3": "micro_repair", "p4": "degraded"}


def test_documents_out_and_back(spark):
    d = issues(spark, {"title": "One", "file": ".github/x.yml", "line": 3, "locationVerified": True, "cwe": "CWE 79", "codeExample": "a\nb"}, {"title": "Two", "locationVerified": False}, {"title": "Three", "severity": "LOW", "locationVerified": True, "category": "sec x", "codeExample": ""}, {"title": "Four", "locationVerified": True, "file": "../x"})
    doc = json.loads(sinks.sarif(d).first()[0])
    res = doc["runs"][0]["results"]
    assert [(r["ruleId"], r["level"]) for r in res] == [("CWE79", "error"), ("tidewrack/sec-x", "note")]
    assert res[0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 3} and len(doc["runs"][0]["tool"]["driver"]["rules"]) == 2
    md = sinks.markdown(d).withColumnRenamed("document", "text").withColumn("path", F.lit("r.md"))
    back = rules.markdown_issues(md).orderBy("ord").collect()
    assert [(r.title, r.severity, r.file, r.line, r.codeExample) for r in back][:2] == [("One", "HIGH", ".github/x.yml", 3, "a\nb"), ("Two", "HIGH", "a.py", 1, "c")]
    assert len(back) == 4 and back[0].impact == "i" and back[0].recommendedFix == "f"
    assert len(json.loads(sinks.json_report(d).first()[0])["issues"]) == 4
    notes = [r.text for r in sinks.annotations(d).collect()]
    assert len(notes) == 3 and "::warning::Four" in notes and "::warning file=.github/x.yml,line=3::One" in notes
    assert col(spark, ["a ``` b"], sinks.fence) == ["````\na ``` b\n````"]
    assert sinks.evidence(issues(spark, {"category": "osv"}, {})).first()[0].count("\n") == 0
    l = spark.createDataFrame([("a.json", 1), ("b.json", 3), ("c.sarif.json", 9)], "path string, mtime int")  # noqa: E741
    assert rules.latest(l).first()[0] == "b.json"
    assert rules.richest(spark.createDataFrame([("a", 2, 1), ("b", 2, 5), ("c", 0, 9)], "path string, n int, mtime int")).first()[0] == "b"


def test_tree_source(spark, tmp_path):
    for n, t in {".env": "K=1", "pkg/__init__.py": "", "node_modules/x.js": "x", ".github/w.yml": "on", "big.txt": "x" * 50, "bin": "\udcff"}.items():
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(t.encode("utf-8", "surrogateescape"))
    (tmp_path / "link").symlink_to("/etc/passwd")
    got = {r.relative: r.content for r in tree.read(spark, str(tmp_path), maxBytes="20", partitions="3").collect()}
    assert got == {".env": "K=1", "pkg/__init__.py": "", ".github/w.yml": "on", "bin": "\ufffd"}
    assert {r.content for r in tree.read(spark, str(tmp_path), withContent="false").collect()} == {None}


def test_symbols(spark):
    a = "class A:\n    async def m(self):\n        pass\n\n    class In:\n        def deep(self): pass\n\n    def n(self): pass\n\n\nasync def f():\n    def g(): pass\n    return 1\n\ndef h(): pass\n"
    f = files(spark, {"a.py": a, "b.py": "def broken(", "c.go": "func one() {\n}\n  export async function two(class) {\nclass Three\nmyfunc x\nfn\n", "d.txt": ""})
    got = {}
    for r in symbols.symbols(f).collect():  # rows of a file are in order of lines
        got.setdefault(r.relative, []).append((r.kind, r.name, r.start_line, r.end_line))
    assert got == {
        "a.py": [("class", "A", 1, 8), ("async_method", "A.m", 2, 3), ("method", "A.n", 8, 8), ("async_function", "f", 11, 13), ("function", "h", 15, 15)],
        "c.go": [("function", "one", 1, 1), ("function", "two", 3, 3), ("class", "Three", 4, 4)],
    }
    assert [r.name for r in symbols.symbols(f.where("relative = 'a.py'"), top=2).collect()] == ["A", "f"]
    many = files(spark, {"m.go": "".join(f"func f{k}\n" for k in range(100)), "n.go": "x\n" * 100, "s.go": "func a\n"})
    text = {r.relative: r.text for r in symbols.outline_text(many).collect()}
    assert set(text) == {"m.go", "n.go"} and text["m.go"].count("\n") == 49 and text["m.go"].endswith("52 more") and "no symbols" in text["n.go"]


def test_small_lookups(spark):
    d = spark.createDataFrame([("ran", "a", None), ("skipped", "b", None), ("failed", "c", "boom")], "status string, tool string, detail string")
    assert {r.tool for r in scanners.gaps(d).collect()} == {"b", "c"}
    assert [r.tool for r in scanners.missing_required(d.select("tool"), d).collect()] == ["b"]
    assert score.all_ran_confidence(d).first() == (1, 55) and score.all_ran_confidence(d.limit(1)).first() == (1, 75) and score.all_ran_confidence(d.limit(0)).first() == (0, 55)
    assert col(spark, ["coverage:sec.x: N/A - no", "coverage:a.b: missed", "other", None], C.is_coverage_note) == [True, True, False, False]
    assert col(spark, ["6ba7b810-9dad-11d1-80b4-00c04fd430c8", "6ba7b8109dad11d180b400c04fd430c8", None], C.is_uuid) == [True, False, False]
    assert col(spark, ["see Review now", "commands_review", "a"], lambda c: C.mentions(c, F.lit("review"))) == [True, False, False]
    assert col(spark, ["known", None], C.run_id)[0] == "known" and col(spark, ["abc"], C.file_hash)[0].startswith("ba7816bf")
    i = issues(spark, {"title": "one"}, {"title": "two"}).withColumn("stable_id", F.lit("AB"))
    ids = spark.createDataFrame([("ab ",), ("zz",)], "stable_id string")
    assert sorted(tuple(r) for r in findings.issue_meta(i, ids).collect()) == [("ab ", "sec.x", "a.py", "one"), ("zz", "", "", "")]
    v = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "confidence int, n_issues int, n_gaps int")
    assert [r.vacuous for r in findings.is_vacuous(v).orderBy("confidence").collect()] == [True, False]


def test_triage_plan(spark):
    i = issues(spark, {"file": "./a.py", "source": "scanner"}, {"file": "b.py", "source": "scanner", "severity": "LOW"}, {"file": "c.py", "source": "scanner"}, {"file": "d.py", "source": "llm"})
    files_ = spark.createDataFrame([("a.py",), ("x.py",)], "relative string")
    plan = lambda **k: (lambda p, d: (sorted(r.pack_file for r in p.collect()), tuple(d.first())))(*planning.triage_plan(i, files_, **k))
    assert plan(routing=False) == (["a.py", "x.py"], (True, False, 0, 2, False, ""))
    assert plan() == (["a.py", "c.py"], (True, False, 2, 2, False, ""))
    assert plan(max_files=1)[0] == ["a.py"] and plan(max_files=1)[1][4]
    assert plan(floor="CRITICAL")[0] == [] and plan(floor="CRITICAL")[1][:3] == (False, True, 0)
    assert plan(floor="CRITICAL", on_clean=True)[0] == ["a.py", "x.py"] and plan(floor="CRITICAL", on_clean=True)[1][:3] == (True, False, 0)


def test_streams_equal_tables(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [{"reason": "false_positive", "category": "a"}, {"reason": "other", "category": "a"}, {"reason": "false_positive", "category": " A"}]
    (log / "1.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n[bad\n")
    (log / "2.json").write_text(json.dumps({"reason": "false_positive", "category": "b"}) + "\n")
    q = stream.running_counts(rules.feedback_stream(spark, str(log))).writeStream.outputMode("complete").format("memory").queryName("fb").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, stream.running_counts(rules.feedback(spark, str(log))).collect()))
    assert sorted(map(tuple, spark.table("fb").collect())) == want == [("a", 2), ("b", 1)]
    snaps = tmp_path / "snaps"
    s = lambda d, n: spark.createDataFrame(list(d.items()), "path string, sha256 string").coalesce(1).write.parquet(f"{snaps}/{n}")
    s({"x": "1", "y": "1"}, "s0")
    src = spark.readStream.schema("path string, sha256 string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(snaps))
    w = lambda: stream.apply_snapshots(src, f"{tmp_path}/state", f"{tmp_path}/diff").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    w()
    s({"x": "2", "z": "1"}, "s1")
    w()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/diff/batch=1").collect())) == [("x", "changed"), ("y", "deleted"), ("z", "added")]


def test_review(spark):
    f = files(spark, {"auth.py": "x = 1\ny = eval(z)\n", "big.py": "x\n" * 600, "off.py": "# tidewrack:disable\nbad()\n"})
    scan = issues(spark, {"category": "semgrep", "file": "auth.py", "line": 2, "title": "eval", "source": "scanner"}).drop("ord")
    model = lambda inv: spark.createDataFrame([("CRITICAL", "P1", "sec.injection", "auth.py", 9, "Eval of input", "eval(z)"), ("HIGH", "P1", "sec.x", "off.py", 2, "Bad", "bad()"), ("CRITICAL", "P1", "sec.y", "auth.py", 1, "Gone", "missing")], "severity string, priority string, category string, file string, line int, title string, quote string")
    out = review.run(f, scan, rules.ignore_rules(spark, ""), spark.createDataFrame([], rules.FEEDBACK), "2026-01-01", model)
    got = {r.title: (r.severity, r.line, r.locationVerified) for r in out["issues"].collect()}
    assert got["Eval of input"] == ("CRITICAL", 2, True) and got["Gone"] == ("HIGH", 1, False) and got["eval"][2] is True and "File has 600 lines" in got
    assert [r.title for r in out["suppressed"].collect()] == ["Bad"]
    assert out["gate"].first().failed is True and out["coverage"].count() == 45
    assert isinstance(datetime.date.today(), datetime.date)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_diagrams_and_prompts(spark):
    from tidewrack.functions import diagrams
    from tidewrack.operators import prompts

    texts = ["x\n```mermaid\ngraph TD\na.b --> c[d]\n```\ny", "graph LR\na --> b\nc[", "nothing", None, "```mermaid\n\n```"]
    got = col(spark, texts, lambda c: diagrams.diagram(c, F.lit("none")))
    assert got == ["graph TD\na_b---c", "graph LR\na---b", "none", "none", "none"]
    f = files(spark, {"a.py": "one two three", "b.py": "four"})
    hits = spark.createDataFrame([("b.py", -1.0), ("a.py", -2.0)], "path string, score double")
    assert prompts.context_block(hits, f, 2).first()[0] == "### a.py\none two\n\n### b.py\nfour"
    p = spark.createDataFrame([("p1", ["r"], ["sec.x", "sec.y"])], "band string, rule_ids array<string>, coverage_ids array<string>")
    packed = f.withColumn("ord", F.when(F.col("relative") == "b.py", 0).otherwise(1))
    text = prompts.pass_prompts(p, packed, {"Evidence": "e", "None": ""}, 5).first().prompt
    assert text == "# Rules\nr\n# Checklist\nsec.x\nsec.y\n\n# Evidence\ne\n\n## b.py\nfour\n\n## a.py\none t\n[cut]"
    d = issues(spark, {"line": 2})
    assert prompts.excerpt_of(d, files(spark, {"a.py": "1\n2\n3"})).first().excerpt == "1\n2\n3"
    assert col(spark, ["- `f` (10-20) -> `n/p.py`", "x"], prompts.move_of) == [("f", 10, 20, "n/p.py"), None]


def test_store_and_sources(spark, tmp_path):
    from tidewrack.sources import store

    s = store.Store(spark, f"file://{tmp_path}/s")
    t = lambda **k: spark.createDataFrame(list(k.items()), "path string, sha256 string")
    assert s.latest("fingerprints") is None
    s.upsert("fingerprints", t(a="1", b="1"))
    s.upsert("fingerprints", t(b="2", c="1"), spark.createDataFrame([("a",)], "path string"))
    assert sorted(map(tuple, s.latest("fingerprints").collect())) == [("b", "2"), ("c", "1")]
    for k in (1, 2, 3):
        s.append("runs", spark.createDataFrame([(k, "ok")], "id int, outcome string"))
    assert [r.id for r in store.recent_runs(s.log("runs", "id int, outcome string"), 2).collect()] == [3, 2]
    assert s.save_report(t(a="1"), True, True) is False and s.latest("report") is None and s.save_report(t(a="1"), True, False)
    assert col(spark, ["a/b", "https://h.org/a/b.git", "git@h:a/b-c", "models/x", "a/b/c", "models/o/n"], store.slug) == ["a/b", "a/b", "a/b-c", None, None, "o/n"]
    assert store.source_kind() == ("path", ".") and store.source_kind(github="a/b") == ("github", "a/b")
    with pytest.raises(ValueError):
        store.source_kind("x", github="a/b")
    assert col(spark, ["import os\nfrom jwt import x\nimport zlib"], lambda c: store.import_risks(c, F.lit("import os"), ["jwt", "os", "zlib"])) == [["jwt", "zlib"]]
