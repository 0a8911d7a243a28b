"""Model answers: streamed with a deadline, cut off, drawn; counters of a running plan; documents written by many tasks."""

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from tests.test_engine import col, issues
from tidewrack.functions import diagrams
from tidewrack.operators import coerce, findings, sinks
from tidewrack.sources import chunks, lists, store
from tidewrack.streaming import answers, progress

LINES = "answer string, ord long, line string, seconds double, asked timestamp"


def said(text):
    return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]})


def put(spark, folder, k, rows):
    spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(f"{folder}/{k}")


def wait(query, out, keys, seconds=90):
    """Answers of the sink once these are there."""
    end = time.time() + seconds
    while time.time() < end:
        if query.exception():
            raise query.exception()
        got = out()
        if keys <= set(got):
            return got
        time.sleep(0.5)
    raise AssertionError(f"{keys} wanted, got {out()}")


def test_streamed_answers_with_a_deadline(spark, tmp_path):
    spark.conf.set(answers.PROVIDER, answers.ROCKSDB)
    src = f"{tmp_path}/in"
    first = [("whole", 2, said("b"), 1.0, None), ("whole", 1, said("a"), 0.5, None), ("whole", 3, "data: [DONE]", 1.5, None), ("none", 1, "data: [DONE]", 0.1, None), ("slow", 1, said("s"), 1.0, datetime.datetime.now() - datetime.timedelta(seconds=50))]
    first += [("over", 1, said("o"), 1.0, None), ("over", 2, said("p"), 99.0, None), ("split", 1, said("x"), 0.1, None)]
    put(spark, src, 1, first)
    lines = spark.readStream.schema(LINES).option("recursiveFileLookup", "true").parquet(src)
    q = answers.fold_stream(lines, "choices", 60.0).writeStream.format("memory").queryName("answers_out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    out = lambda: {r.answer: (r.text, r.status) for r in spark.sql("select * from answers_out").collect()}
    try:
        got = wait(q, out, {"whole", "none", "over"})
        got.pop("slow", None)
        assert got == {"whole": ("ab", "ok"), "none": ("", "empty"), "over": ("op", "late")}
        put(spark, src, 2, [("split", 2, said("y"), 0.2, None), ("split", 3, "data: [DONE]", 0.3, None), ("whole", 4, said("again"), 2.0, None)])
        assert wait(q, out, {"split"})["split"] == ("xy", "ok")
        # no further line comes for it: its timer gives it out
        got = wait(q, out, {"slow"})
        assert got["slow"] == ("s", "late") and got["whole"] == ("ab", "ok")
        assert spark.sql("select * from answers_out").count() == 5
    finally:
        q.stop()
        spark.conf.unset(answers.PROVIDER)
    done = spark.createDataFrame([r for r in first if r[0] in ("whole", "none", "over")], LINES)
    batch = {r.answer: (r.text, r.status) for r in chunks.fold(done, "choices", 60.0).collect()}
    assert {k: got[k] for k in batch} == batch


def test_counters_of_a_batch(spark, tmp_path):
    c = progress.Counters()
    d = spark.createDataFrame([(k, "é" * (k % 3), None if k % 2 else "x") for k in range(100)], "k long, a string, b string").repartition(4)
    d = c.counted(d, "read")
    d = c.counted(d.where("k < 30"), "kept")
    d.write.format("noop").mode("overwrite").save()
    size = lambda n: sum(2 * (k % 3) + (k % 2 == 0) for k in range(n))
    assert c.counts() == {"read": {"rows": 100, "bytes": size(100)}, "kept": {"rows": 30, "bytes": size(30)}}


def test_heartbeat_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"t{i}",) for i in range(10 * k + 1)], "t string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    beats = []
    h = progress.Heartbeat(lambda *x: beats.append(x))
    spark.streams.addListener(h)
    try:
        s = progress.observed(spark.readStream.schema("t string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), "read")
        s = progress.observed(s.where("t <> 't0'"), "kept")
        q = s.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        end = time.time() + 20
        while time.time() < end and h.counts(str(q.id)).get("read", (0, 0))[0] < 33:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(h)
    rows = [f"t{i}" for k in range(3) for i in range(10 * k + 1)]
    assert h.counts(str(q.id)) == {"read": (33, sum(map(len, rows))), "kept": (30, sum(len(t) for t in rows if t != "t0"))}
    read = [b[2] for b in beats if b[1] == "read"]
    assert read == sorted(read) and len(read) >= 3 and read[-1] == 33


WHOLE = {"confidence": "72%", "gaps": ["g"], "issues": [{"title": 'a "}] b\\', "line": 3}, {"title": "two", "nested": {"x": [1, {"y": 2}]}}, {"title": "three"}]}


def test_cut_answers_keep_their_whole_findings(spark):
    text = json.dumps(WHOLE)
    ends = [text.index(json.dumps(x)) + len(json.dumps(x)) for x in WHOLE["issues"]]
    for n in range(len(text) + 1):
        got = coerce._closed(text[:n])
        if n == 0:
            assert got is None
            continue
        doc = json.loads(got)
        assert len(doc.get("issues", [])) == sum(n >= e for e in ends), (n, got)
        # what is left of a list is its beginning
        assert all(WHOLE[k][: len(v)] == v for k, v in doc.items())
    for odd in ("no json", "", None, "}{", "[1, 2"):
        assert coerce._closed(odd) in (None, "{}")
    rows = [("p1", "Here: ```json\n" + text[: ends[1] + 5], "bad end"), ("p2", text, "other"), ("p3", "nothing", None), ("p4", None, "timeout")]
    d = coerce.salvage(spark.createDataFrame(rows, "pass string, raw string, error string"))
    got = {r["pass"]: r for r in d.select("pass", "salvaged", "confidence", "gaps", F.size("issues").alias("n")).collect()}
    assert [(got[p].salvaged, got[p].confidence, got[p].n) for p in ("p1", "p2", "p3", "p4")] == [(True, 72, 2), (False, 72, 3), (False, 0, 0), (False, 0, 0)]
    assert got["p1"].gaps == ["g", "llm.schema_invalid (pass: p1): bad end"] and got["p3"].gaps == ["llm.schema_invalid (pass: p3): "]
    assert [r.title for r in coerce.issues(d.where("pass = 'p1'"), "pass").orderBy("ord").collect()] == ['a "}] b\\', "two"]


ODD = ['"text"', '" "', "3", "null", "[1]", "{}", '{"title":" "}', '{"name":"n","issue":{"title":"in","cwe":"c","line":4}}', '{"issue":{"description":"d","risk":null}}', '{"issue":3,"finding":{"Severity":"high","heading":"h"}}', '{"item":{"x":1}}', '{"title":{"a":1},"Severity":"p1","severity":null}', '{"details":"x","level":"LOW","Priority":"p3","snippet":"s","impact":" "}']


def test_a_finding_is_read_once_for_all_its_names(spark):
    d = coerce.reports(coerce.parse(spark.createDataFrame([(1, '{"issues":[' + ",".join(ODD) + "]}")], "k int, raw string")))
    got = coerce.issues(d, "k")
    rows = {r.ord: r for r in got.collect()}
    assert sorted(rows) == [0, 1, 7, 8, 9, 11, 12]
    assert (rows[7].title, rows[7].cwe, rows[7].line) == ("n", "c", 4) and (rows[8].title, rows[8].impact) == ("d", "") and (rows[9].severity, rows[9].impact, rows[9].title) == ("HIGH", "(no impact given: check by hand)", "h")
    assert (rows[11].title, rows[11].severity) == ('{"a":1}', "HIGH") and (rows[12].severity, rows[12].priority, rows[12].codeExample, rows[12].title) == ("LOW", "P3", "s", "x")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") < 60 and plan.count("try_parse_json") + plan.count("parseJson") < 5


def test_salvaged_answers_are_counted_in_their_rows(spark, tmp_path):
    from tidewrack.plans.catalogue import QUERIES

    d = coerce.reports(coerce.parse(spark.createDataFrame([(1, '{"issues":[' + ",".join(ODD) + "]}"), (2, "no"), (3, None)], "k int, raw string")))
    assert [r.n for r in d.orderBy("k").select(coerce.n_issues(F.col("issues")).alias("n")).collect()] == [7, 0, 0]
    spark.range(300).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    out = QUERIES["salvaged_answers"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 300 and "Join" not in plan and "Aggregate" not in plan


def test_what_needs_coercion(spark):
    raw = ['{"confidence": 9, "issues": [{"severity": "high"}]}', '{"confidence": "9", "issues": []}', '{"issues": ["text"]}', '{"issues": [{"severity": "crit"}]}', "```json\n{}\n```", "x {} y", "no", '{"issues": [{"severity": 3}]}']
    d = coerce.needs_coercion(coerce.parse(spark.createDataFrame(list(enumerate(raw)), "k int, raw string")))
    assert [r.coerced for r in d.orderBy("k").collect()] == [False, True, True, True, False, True, True, False]


def test_diagrams_line_by_line(spark):
    valid = lambda *t: col(spark, list(t), diagrams.is_valid)
    bare = "flowchart TD\n  commands_review.py --> run_mode.py\n"
    fixed = col(spark, [bare, "flowchart TD\n  commands_review_py(commands_review py) --> run_mode_py(run_mode py)\n", None, "graph LR\n1a→>b.c/d\nx y\nz\n  a -->\n..---é"], diagrams.normalise)
    assert fixed == ["flowchart TD\ncommands_review_py---run_mode_py", "flowchart TD\ncommands_review_py---run_mode_py", "", "graph LR\nn_1a---b_c_d\nz\nn_---n_"]
    assert valid(bare, fixed[0], "", None, "flowchart LR\n  A---B\n", "flowchart LR\nA -->", "pie\nA---B", "flowchart LR\nA", "sequenceDiagram\nA->>B: hi", "graph LR\na.b --> c", 'graph LR\na["x.y"] --> c', "graph LR\nA---B" + "x" * 8000) == [False, True, False, False, True, False, False, False, True, False, True, False]
    texts = [f"```mermaid\n{bare}```", "```mermaid\nflowchart LR\n  A---B\n```", "```mermaid\nflowchart LR\n  A -->\n```", "```mermaid\nnot a diagram\n```", "```\nx --> y\nz ==>\n```", None, "```mermaid\ngraph LR\na --> b"]
    got = col(spark, texts, diagrams.result)
    assert [(r.kind, r.mermaid, r.note) for r in got] == [
        ("mermaid", "flowchart TD\ncommands_review_py---run_mode_py", diagrams.NORMALISED), ("mermaid", "flowchart LR\nA---B", None if got[1].note is None else got[1].note), ("textual", None, diagrams.INVALID),
        ("textual", None, diagrams.INVALID), ("mermaid", "flowchart LR\nx---y", diagrams.REPAIRED), ("textual", None, diagrams.INVALID), ("mermaid", "graph LR\na---b", diagrams.NORMALISED),
    ]
    assert got[2].textual.startswith("Textual diagram (Mermaid unavailable):\n- Reason: invalid Mermaid after repair\n") and got[5].textual.endswith("- Raw attempt:\n(empty)")
    assert col(spark, ["y" * 500], lambda c: diagrams.fallback(c, "r"))[0].endswith("y" * 400 + "…")


def test_lists_are_written_as_one_document(spark, tmp_path):
    n = 200_000
    d = spark.range(n).select(F.lit(1).alias("section"), F.lit("").alias("k"), F.col("id").alias("ord"), F.to_json(F.struct("id", F.lit('q"é').alias("t"))).alias("text"))
    d = d.unionByName(spark.range(3).select(F.lit(0).alias("section"), F.chr(F.col("id") + 97).alias("k"), F.lit(0).cast("long").alias("ord"), F.lit('"r"').alias("text"))).repartition(7, "text")
    path = f"{tmp_path}/out/doc.json"
    (tmp_path / "out").mkdir()
    lists.write_lists(d, path, (('{"rules":[', '],"rows":['), ("", "]}")), partitions=6)
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    assert doc["rules"] == ["r"] * 3 and [x["id"] for x in doc["rows"]] == list(range(n)) and doc["rows"][0]["t"] == 'q"é'
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["doc.json"]
    lists.write_lists(d.where("false"), f"file://{path}", (('{"rules":[', '],"rows":['), ("", "]}")))
    assert json.loads((tmp_path / "out/doc.json").read_text()) == {"rules": [], "rows": []}
    with pytest.raises(Exception, match="error"):
        lists.write_lists(d.withColumn("text", F.when(F.col("ord") == 150_000, F.raise_error(F.lit("an error"))).otherwise(F.col("text"))), path, (("", ""), ("", "")), partitions=6)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["doc.json"] and json.loads((tmp_path / "out/doc.json").read_text()) == {"rules": [], "rows": []}


def test_sarif_and_report_as_files(spark, tmp_path):
    d = issues(spark, *[{"title": f"t{k}", "locationVerified": k % 5 > 0, "category": f"c{k % 3}", "line": k + 1} for k in range(60)])
    sinks.write_sarif(d, f"{tmp_path}/a.sarif", partitions=4)
    sinks.write_report(d, f"{tmp_path}/a.json", partitions=4)
    sarif, report = (json.loads((tmp_path / n).read_text()) for n in ("a.sarif", "a.json"))
    assert sarif == json.loads(sinks.sarif(d).first()[0]) and report == json.loads(sinks.json_report(d).first()[0])
    run = sarif["runs"][0]
    assert [r["message"]["text"] for r in run["results"]] == [f"t{k}: e" for k in range(60) if k % 5] and [r["id"] for r in run["tool"]["driver"]["rules"]] == [f"tidewrack/c{k}" for k in range(3)]
    assert [i["title"] for i in report["issues"]] == [f"t{k}" for k in range(60)]
    # parts, and no gathering of all findings before them
    plan = sinks.sarif_parts(d)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_gaps_scores_and_addresses(spark):
    gaps = spark.createDataFrame([(1, 0, "b"), (0, 1, "a"), (0, 0, "c"), (1, 1, "a"), (2, 0, "d")], "part int, ord int, gap string")
    assert [(r.ord, r.gap) for r in findings.merge_gaps(gaps).orderBy("ord").collect()] == [(0, "c"), (1, "a"), (2, "b"), (3, "d")]
    parts = spark.createDataFrame([(0, None), (2, "y"), (1, "x")], "part int, scores string")
    assert findings.first_scores(parts).first()[0] == "x" and findings.first_scores(parts.where("part = 0")).first()[0] is None
    assert col(spark, ["o/r", " o/r.git ", "o", "a/b/c", "a b/c"], lambda c: store.address("github", c)) == ["https://github.com/o/r.git", "https://github.com/o/r.git", None, None, None]
    assert col(spark, ["/datasets/a/b/", "models/a/b", "x/a/b"], lambda c: store.address("hub", c)) == ["https://huggingface.co/datasets/a/b", "https://huggingface.co/a/b", None]
