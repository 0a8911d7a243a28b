"""Ignore files, feedback logs and reports as tables."""

from __future__ import annotations

import datetime
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered

REASONS = ("false_positive", "wont_fix", "accepted_risk", "other")
RULE = "ord int, stable_id string, file string, category string, reason string, note string, expires date"
FEEDBACK = "stableId string, reason string, category string, file string, title string, note string, ts string"


def ignore_rules(spark: SparkSession, text: str) -> DataFrame:
    """Rules of a TOML text with [[ignore]] tables; a rule needs a known reason, and an id or a file and category."""
    rows = tomllib.loads(text).get("ignore") or []
    if not isinstance(rows, list):
        raise ValueError("[[ignore]] must be an array of tables")
    out = []
    for k, r in enumerate(rows):
        clean = lambda *names: next((str(r[n]).strip() for n in names if r.get(n)), None)  # noqa: E731, B023
        reason, sid, file, cat, exp = clean("reason"), clean("stableId", "stable_id"), clean("file"), clean("category"), r.get("expires")
        if reason not in REASONS:
            raise ValueError(f"ignore[{k}]: reason must be one of {REASONS}")
        if not sid and not (file and cat):
            raise ValueError(f"ignore[{k}]: needs stableId, or file and category")
        if isinstance(exp, datetime.datetime):
            exp = exp.date()
        elif exp and not isinstance(exp, datetime.date):
            exp = datetime.date.fromisoformat(str(exp).strip()[:10])
        out.append((k, sid, file, cat, reason, clean("note") or "", exp or None))
    return spark.createDataFrame(out, RULE)


def faults(entries: DataFrame) -> DataFrame:
    """entries (stable_id, file, category, reason, note, expires) with `fault`: why one is no rule, null if it is."""
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    why = F.when(~F.coalesce(F.col("reason"), F.lit("")).isin(*REASONS), f"reason must be one of {', '.join(REASONS)}").when(~has("stable_id") & ~(has("file") & has("category")), "needs stableId, or file and category")
    return entries.withColumn("fault", why)


def append_rules(store, entries: DataFrame) -> None:
    """Add rules to a store's ignore log; if one of them is none, nothing is added."""
    if bad := faults(entries).where("fault is not null").select("fault").first():
        raise ValueError(bad["fault"])
    store.append("ignore", entries.select("stable_id", "file", "category", "reason", "note", F.col("expires").cast("date").alias("expires"), F.current_timestamp().alias("added")))


def appended_rules(store) -> DataFrame:
    """The rules of a store's log as ignore_rules() gives them, in the order in which they came."""
    d = store.log("ignore", "stable_id string, file string, category string, reason string, note string, expires date, added timestamp")
    out = ordered.numbered(d, *map(F.col, ("added", "stable_id", "file", "category", "reason", "note", "expires")))
    return out.select(F.col("ord").cast("int").alias("ord"), "stable_id", "file", "category", "reason", F.coalesce("note", F.lit("")).alias("note"), "expires")


def ignore_text(rules: DataFrame) -> DataFrame:
    """ord, text: each rule as an [[ignore]] table, which ignore_rules() reads."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name} = "), quoted(c)))
    fields = (("stableId", "stable_id"), ("file", "file"), ("category", "category"), ("reason", "reason"), ("note", "note"))
    return rules.select("ord", F.concat_ws("\n", F.lit("[[ignore]]"), *[line(n, F.col(c)) for n, c in fields], line("expires", F.col("expires").cast("string"))).alias("text"))


def feedback(spark: SparkSession, path: str) -> DataFrame:
    """An append-only JSON-lines log; lines that aren't objects are skipped."""
    return spark.read.schema(FEEDBACK).option("mode", "DROPMALFORMED").json(path)


def feedback_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(FEEDBACK).option("mode", "DROPMALFORMED").json(path)


def latest(listing: DataFrame) -> DataFrame:
    """path of the newest report that isn't SARIF. listing: path, mtime."""
    return listing.where(F.col("path").endswith(".json") & ~F.col("path").endswith(".sarif.json")).agg(F.max_by("path", "mtime").alias("path"))


def markdown_issues(texts: DataFrame) -> DataFrame:
    """path, ord and fields of findings in Markdown reports: `### [SEVERITY] title` heads, `- **Field:** value` lines, a fenced example."""
    blocks = F.filter(F.split("text", r"(?m)^(?=### \[)"), lambda x: x.startswith("### ["))
    b = texts.select("path", F.posexplode(blocks).alias("ord", "b")).withColumn("b", F.element_at(F.split("b", r"(?m)^## "), 1))
    field = lambda name: F.trim(F.regexp_extract("b", rf"(?m)^- \*\*{name}:\*\*[ \t]*(.*)$", 1))
    b = b.withColumn("severity", F.regexp_extract("b", r"^### \[([A-Za-z]+)\]", 1)).withColumn("place", field("File"))
    return b.select("path", "ord", F.upper("severity").alias("severity"), F.trim(F.regexp_extract("b", r"^### \[[A-Za-z]+\][ \t]*(.*)", 1)).alias("title"), F.regexp_extract("place", r"^`?(.*?)(?::(\d+))?`?$", 1).alias("file"), F.coalesce(F.regexp_extract("place", r":(\d+)`?$", 1).try_cast("int"), F.lit(1)).alias("line"), field("Category").alias("category"), field("Impact").alias("impact"), field("Fix").alias("recommendedFix"), field("Why").alias("explanation"), F.regexp_extract("b", r"(?s)\n```[^\n]*\n(.*?)\n```", 1).alias("codeExample"))


def richest(reports: DataFrame) -> DataFrame:
    """path of the report with most findings, the newest of ties. reports: path, n, mtime."""
    return reports.where("n > 0").agg(F.max_by("path", F.struct("n", "mtime")).alias("path"))
