"""Findings to documents: Markdown, JSON, SARIF, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.lists import write_lists

LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}


def rule_id(cwe: Column, category: Column) -> Column:
    return F.coalesce(F.nullif(F.replace(cwe, F.lit(" "), F.lit("")), F.lit("")), F.concat(F.lit("tidewrack/"), F.regexp_replace(F.lower(category), r"[^a-z0-9._-]+", "-")))


def sarif_rows(issues: DataFrame) -> DataFrame:
    """ord, ruleId, result (JSON) of location-verified issues; end line and column only where known and different."""
    d = issues.where(F.coalesce("locationVerified", F.lit(False)) & ~C.is_unsafe(F.col("file")))
    end, col = (F.col(c) if c in issues.columns else F.lit(None).cast("int") for c in ("end_line", "start_column"))
    rid = rule_id(F.col("cwe"), F.col("category"))
    region = F.struct(F.col("line").alias("startLine"), F.when(end > F.col("line"), end).alias("endLine"), col.alias("startColumn"))
    place = F.struct(F.struct(F.struct(C.norm_route(F.col("file")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(rid.alias("ruleId"), C.lookup(F.col("severity"), LEVELS).alias("level"), F.struct(F.concat(F.col("title"), F.lit(": "), F.substring("explanation", 1, 400)).alias("text")).alias("message"), F.array(place).alias("locations"), F.create_map(F.lit("tidewrack/v1"), C.stable_id(F.col("category"), F.col("file"), F.col("title"), "tidewrack")).alias("partialFingerprints"))
    return d.select("ord", rid.alias("ruleId"), F.to_json(result, {"ignoreNullFields": "true"}).alias("result"), "title")


def sarif_rules(rows: DataFrame) -> DataFrame:
    """ruleId and name, the first of each."""
    return rows.groupBy("ruleId").agg(F.min_by("title", "ord").alias("name"))


#: Opening and closing of a document's lists.
_REPORT = (('{"issues":[', "]}"),)
_SARIF = (('{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"tidewrack","rules":[', ']}},"results":['), ("", "]}]}"))


def sarif_parts(issues: DataFrame) -> DataFrame:
    """section (0 rules, 1 results), k, ord, text: what the SARIF document lists, in order of section, k and ord."""
    rows = sarif_rows(issues)
    rule = F.to_json(F.struct(F.col("ruleId").alias("id"), F.struct(F.col("name").alias("text")).alias("shortDescription")))
    rules = sarif_rules(rows).select(F.lit(0).alias("section"), F.col("ruleId").alias("k"), F.lit(0).cast("long").alias("ord"), rule.alias("text"))
    return rules.unionByName(rows.select(F.lit(1).alias("section"), F.lit("").alias("k"), F.col("ord").cast("long").alias("ord"), F.col("result").alias("text")))


def report_parts(issues: DataFrame) -> DataFrame:
    """section, k, ord, text: the findings of the JSON report."""
    row = F.to_json(F.struct(*[c for c in issues.columns if c != "ord"]))
    return issues.select(F.lit(0).alias("section"), F.lit("").alias("k"), F.col("ord").cast("long").alias("ord"), row.alias("text"))


def write_sarif(issues: DataFrame, path: str, partitions: int | None = None) -> None:
    """The SARIF 2.1.0 document as one file, of findings of any number."""
    write_lists(sarif_parts(issues), path, _SARIF, partitions)


def write_report(issues: DataFrame, path: str, partitions: int | None = None) -> None:
    """The JSON report as one file, of findings of any number."""
    write_lists(report_parts(issues), path, _REPORT, partitions)


def _in_one(parts: DataFrame, lists) -> DataFrame:
    text = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == n, F.struct("k", "ord", "text")))), lambda x: x.getField("text")), ",")
    return parts.agg(F.concat(*[c for n, (a, z) in enumerate(lists) for c in (F.lit(a), text(n), F.lit(z))]).alias("document"))


def sarif(issues: DataFrame) -> DataFrame:
    """One row: the SARIF 2.1.0 document of a few findings (write_sarif takes any number)."""
    return _in_one(sarif_parts(issues), _SARIF)


def fence(text: Column) -> Column:
    """text in a fence longer than any run of backticks in it, after one outer fence is taken off."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\n", ""), r"\n```$", "")
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(t, F.lit("(`+)")), lambda x: F.length(x))), F.lit(0))
    bar = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    return F.concat(bar, F.lit("\n"), t, F.lit("\n"), bar)


def markdown_blocks(issues: DataFrame) -> DataFrame:
    """ord, priority, block: the Markdown of each issue, which sources.rules.markdown_issues reads back."""
    line = lambda name, c: F.concat(F.lit(f"- **{name}:** "), F.coalesce(c, F.lit("")))
    block = F.concat_ws("\n", F.concat(F.lit("### ["), "severity", F.lit("] "), "title"), line("File", F.concat("file", F.lit(":"), "line")), line("Category", F.col("category")), line("Impact", F.col("impact")), line("Why", F.replace("explanation", F.lit("\n"), F.lit(" "))), line("Fix", F.col("recommendedFix")), F.when(F.trim(F.coalesce("codeExample", F.lit(""))) != "", fence(F.col("codeExample"))))
    return issues.select("ord", "priority", block.alias("block"))


def markdown(issues: DataFrame, title: str = "Findings") -> DataFrame:
    """One row: the report, by priority, then order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("priority", "ord", "block"))), lambda x: x.getField("block"))
    return markdown_blocks(issues).agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(parts, "\n\n"), F.lit("\n")).alias("document"))


def json_report(issues: DataFrame) -> DataFrame:
    """One row: the JSON report of a few findings (write_report takes any number)."""
    return _in_one(report_parts(issues), _REPORT)


def focus(issues: DataFrame) -> DataFrame:
    """Critical and high findings, severest first, then by file and line."""
    return issues.where("severity in ('CRITICAL', 'HIGH')").orderBy(-C.sev_rank(F.col("severity")), "file", "line")


def annotations(issues: DataFrame, top: int = 20) -> DataFrame:
    """text: workflow commands of the first findings; a path that isn't safe is left out."""
    d = focus(issues).limit(top)
    safe = ~(F.col("file").contains("..") | F.col("file").rlike(r"[\r\n:]"))
    place = F.when(safe, F.concat(F.lit(" file="), "file", F.lit(",line="), "line")).otherwise("")
    return d.select(F.concat(F.lit("::"), F.when(F.col("severity") == "CRITICAL", "error").otherwise("warning"), place, F.lit("::"), C.escape_workflow(F.col("title"))).alias("text"))


def evidence(issues: DataFrame, rows: int = 40, cap: int = 12_000) -> DataFrame:
    """One row: the first scanner findings as lines of text."""
    d = issues.where(C.infer_source(F.col("source"), F.col("category")) == "scanner").orderBy("ord").limit(rows)
    line = F.concat_ws(" ", F.concat(F.lit("- ["), "severity", F.lit("]")), "category", F.concat("file", F.lit(":"), "line"), "title")
    return d.agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x.getField("l")), "\n"), 1, cap).alias("text"))
