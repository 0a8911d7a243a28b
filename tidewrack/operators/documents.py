"""Whole documents as ordered blocks: the report and the summary of a pull request.

A document is a table (section, lane, rank, file, line, ord, block); its order is that of all columns but the last. It is
written by a range sort, so that no task holds more than its part; `text` joins a document that is known to be short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import findings, sinks

ORDER = ("section", "lane", "rank", "file", "line", "ord")
EXAMPLE_LINES = 40
BANDS = (("P1", "P1 - Security"), ("P2", "P2 - Bugs, reliability, performance"), ("P3", "P3 - Architecture and quality"))
FIELDS = (
    "- **Priority:** P1 security, P2 bugs and reliability, P3 architecture and quality.",
    "- **Fingerprint:** the issue's identity over runs; **Occurrence:** this row of this report.",
    "- **Source:** `scanner`, `heuristic` or `llm`. **Location:** only verified ones go to SARIF.",
)
CLOSING = "_Suggested fixes are for review; nothing is changed by itself._"


def status_label(reused_from: Column, bypassed: Column, skipped: Column) -> Column:
    """What became of the model's part; null if it ran as usual."""
    bypassed, skipped = F.coalesce(bypassed, F.lit(False)), F.coalesce(skipped, F.lit(False))
    return F.when(reused_from != "", F.concat(F.lit("reused from "), reused_from)).when(bypassed, "bypassed (scanners clean at triage floor)").when(skipped, "skipped (no file delta; no prior snapshot)")


def truncation_note(stats: DataFrame, max_files: int) -> DataFrame:
    """note of planning.inventory_stats: null unless files were left out."""
    cap = "uncapped" if max_files <= 0 else str(max_files)
    return stats.select(F.when(F.col("truncated"), F.format_string(f"Inventory truncated: %d of %d matched files (max_files={cap}), by priority band, then path; scanners read the whole tree.", "n_files", "total_matched")).alias("note"))


def short_example(code: Column, most: int = EXAMPLE_LINES) -> Column:
    lines = C.split_lines(code)
    more = F.size(lines) - most
    return F.when(more > 0, F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.format_string("\n# truncated (%d more line(s))", more))).otherwise(code)


def _blocks(d: DataFrame, section: int, block: Column, lane: int = 1, **order: Column) -> DataFrame:
    zero = {"rank": F.lit(0), "file": F.lit(""), "line": F.lit(0), "ord": F.lit(0).cast("long")} | order
    return d.select(F.lit(section).alias("section"), F.lit(lane).alias("lane"), *[zero[c].alias(c) for c in ORDER[2:]], block.alias("block"))


def _section(k: int, heading: str, items: DataFrame, none: str) -> DataFrame:
    """items (blocks of section k) under a heading, which says `none` where there are no items."""
    head = F.when(F.col("n") == 0, f"## {heading}\n\n{none}").otherwise(f"## {heading}")
    return _blocks(items.agg(F.count("*").alias("n")), k, head, lane=0).unionByName(items)


def _counts(issues: DataFrame) -> DataFrame:
    return findings.tally(issues).select(F.format_string("**Counts:** Critical %d, High %d, Medium %d, Low %d", "critical", "high", "medium", "low").alias("counts"))


def _focus_block() -> Column:
    example = C.strip(F.coalesce("codeExample", F.lit("")))
    shown = F.when(example != "", F.concat(F.lit("- **Example:**\n\n"), sinks.fence(short_example(example))))
    return F.concat_ws("\n", F.concat(F.lit("#### ["), "severity", F.lit("] "), "title"), F.concat(F.lit("- **Where:** `"), "file", F.lit(":"), "line", F.lit("`")), F.concat(F.lit("- **Fingerprint:** `"), "stable_id", F.lit("`")), F.concat(F.lit("- **Fix:** "), F.coalesce("recommendedFix", F.lit(""))), shown)


def pr_summary(issues: DataFrame, meta: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """Blocks: counts and status, then each critical or high finding, severest first, then by file and line.

    meta: one row (confidence, reused_from, bypassed, skipped); issues may have stable_id.
    """
    d = issues if "stable_id" in issues.columns else issues.withColumn("stable_id", F.lit(None).cast("string"))
    head = meta.join(_counts(d)).join((suppressed if suppressed is not None else d.limit(0)).agg(F.count("*").alias("n_suppressed")))
    label = status_label(F.col("reused_from"), F.col("bypassed"), F.col("skipped"))
    hidden = F.when(F.col("n_suppressed") > 0, F.format_string("**Suppressed (audit):** %d", "n_suppressed"))
    top = F.concat_ws("\n", F.lit("## Summary for review\n"), F.format_string("**Gate confidence:** %d%%", "confidence"), "counts", F.concat(F.lit("**LLM:** "), label), hidden)
    hot = d.where("severity in ('CRITICAL', 'HIGH')")
    items = _blocks(hot, 1, _focus_block(), rank=-C.sev_rank(F.col("severity")), file=F.col("file"), line=F.col("line"), ord=F.col("ord"))
    tail = _blocks(meta, 2, F.lit(CLOSING), lane=2)
    return _blocks(head, 0, top).unionByName(_section(1, "Suggested fixes (critical and high)", items, "_No critical or high findings._")).unionByName(tail)


def report(issues: DataFrame, meta: DataFrame, runs: DataFrame | None = None, gaps: DataFrame | None = None, suppressed: DataFrame | None = None, themes: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Blocks of the report, sections in their fixed order.

    meta: one row (mode, generated, seconds, confidence, commit_go, push_go, reused_from, bypassed, skipped); runs: ord, tool,
    status, detail, n_findings; gaps: ord, gap; suppressed: ord, title, file, line, reason; themes as score.theme_breakdown
    gives; scores: ord, dimension, score. A part that is not given is left out; an empty one says so.
    """
    stamp = F.date_format("generated", "yyyy-MM-dd HH:mm 'UTC'")
    bold = lambda name, c: F.concat(F.lit(f"**{name}:** "), c)
    head = F.concat_ws("\n", F.concat(F.lit("# Review report, "), stamp, F.lit("\n")), bold("Mode", F.concat(F.lit("`"), "mode", F.lit("`"))), bold("Generated", stamp), bold("Duration", C.duration(F.col("seconds"))), bold("Gate confidence", F.format_string("%d%%", "confidence")), bold("Commit go/no-go", F.col("commit_go")), bold("Push go/no-go", F.col("push_go")))
    verdict = F.concat_ws("\n", F.lit("## Gate verdict\n"), F.concat(F.lit("- "), "counts"), F.concat(F.lit("- **LLM:** "), status_label(F.col("reused_from"), F.col("bypassed"), F.col("skipped"))))
    parts = [_blocks(meta, 0, head), _blocks(meta.join(_counts(issues)), 1, verdict), _blocks(meta, 2, F.lit("\n".join(("## Finding fields\n", *FIELDS))))]
    blocks = sinks.markdown_blocks(issues)
    for k, (band, label) in enumerate(BANDS):
        parts.append(_section(3 + k, label, _blocks(blocks.where(F.col("priority") == band), 3 + k, F.col("block"), ord=F.col("ord")), "_No findings in this band._"))
    if runs is not None:
        n = F.when(F.col("status") == "ran", F.format_string(" (%d finding(s))", "n_findings"))
        line = F.concat_ws("", F.lit("- **"), "tool", F.lit("**: `"), "status", F.lit("`"), F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(", "), "detail")), n)
        parts.append(_section(6, "Automated scanners", _blocks(runs, 6, line, ord=F.col("ord")), "_No scanners requested or configured._"))
    if suppressed is not None:
        line = F.format_string("- %s (`%s:%d`): %s", "title", "file", "line", "reason")
        parts.append(_section(7, "Suppressed", _blocks(suppressed, 7, line, ord=F.col("ord")), "_None._"))
    if "fixTiming" in issues.columns:
        now = issues.where("fixTiming = 'immediately'")
        line = F.format_string("1. **%s** (`%s:%d`): %s", "title", "file", "line", "recommendedFix")
        parts.append(_section(8, "Plan to fix", _blocks(now, 8, line, ord=F.col("ord")), "_No immediate findings._"))
    if gaps is not None:
        real = gaps.where(~C.is_coverage_note(F.col("gap")))
        parts.append(_section(9, "Durability gaps", _blocks(real, 9, F.concat(F.lit("- [ ] "), "gap"), ord=F.col("ord")), "_None called out._"))
    if themes is not None:
        line = F.concat_ws(", ", F.concat(F.lit("- `"), "id", F.lit("`: "), "status"), F.format_string("%d finding(s)", "n_findings"), F.nullif(F.col("notes"), F.lit("")))
        parts.append(_section(10, "Coverage by theme", _blocks(themes, 10, line, ord=F.col("ord").cast("long")), "_No themes._"))
    if scores is not None:
        parts.append(_section(11, "Architecture scores", _blocks(scores, 11, F.format_string("- %s: %d of 10", "dimension", "score"), ord=F.col("ord")), "_Not scored._"))
    return reduce(DataFrame.unionByName, [*parts, _blocks(meta, 12, F.lit(CLOSING))])


def write(document: DataFrame, path: str) -> None:
    """The document as text parts, whose names are in its order."""
    document.orderBy(*ORDER).select(F.concat("block", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def text(document: DataFrame) -> str:
    """The whole text, on the driver: for documents that are known to be short, such as a summary."""
    return "\n\n".join(r.block for r in document.orderBy(*ORDER).select("block").collect()) + "\n"
