"""Prompt and context texts, assembled in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def context_block(hits: DataFrame, files: DataFrame, tokens: int = 24) -> DataFrame:
    """One row: Markdown of search hits (path, score) with the first tokens of each file."""
    j = hits.join(files.select(F.col("relative").alias("path"), "content"), "path")
    head = F.array_join(F.slice(F.filter(F.split("content", r"\s+"), lambda x: x != ""), 1, tokens), " ")
    line = F.concat(F.lit("### "), "path", F.lit("\n"), head)
    return j.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("score", "path", line.alias("l")))), lambda x: x.getField("l")), "\n\n").alias("text"))


# What the context of a prompt says.
CONTEXT, NOTHING = "## Local learning context (on-disk index)", "(no snippet)"


def learned_context(hits: DataFrame) -> DataFrame:
    """One row, text: Markdown of search hits (path, score, snippet; a few), best first; "" without hits."""
    text = F.coalesce(F.nullif(C.strip(F.coalesce("snippet", F.lit(""))), F.lit("")), F.lit(NOTHING))
    block = F.concat(F.lit("### "), "path", F.lit("\n```\n"), text, F.lit("\n```\n"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("score", "path", block.alias("b")))), lambda x: x.getField("b"))
    return hits.agg(F.when(F.count("*") == 0, "").otherwise(F.concat(F.lit(f"{CONTEXT}\n\n"), F.array_join(blocks, "\n"))).alias("text"))


def pass_prompts(passes: DataFrame, packed: DataFrame, sections: dict[str, str], cap: int = 12_000) -> DataFrame:
    """band, prompt: each pass's rules and checklist, fixed sections, then excerpts of the packed files in order."""
    block = F.concat(F.lit("## "), "relative", F.lit("\n"), C.excerpt(F.col("content"), cap))
    body = packed.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))), lambda x: x.getField("b")), "\n\n").alias("files"))
    fixed = "\n\n".join(f"# {k}\n{v}" for k, v in sections.items() if v)
    head = F.concat(F.lit("# Rules\n"), F.array_join("rule_ids", ", "), F.lit("\n# Checklist\n"), F.array_join("coverage_ids", "\n"))
    return passes.join(body).select("band", F.concat_ws("\n\n", head, F.lit(fixed), "files").alias("prompt"))


def excerpt_of(issue: DataFrame, files: DataFrame) -> DataFrame:
    """ord, excerpt: the lines around each issue."""
    j = issue.join(files.select("relative", "content"), C.norm_route(issue.file) == C.norm_route(F.col("relative")))
    return j.select("ord", C.excerpt_at(F.col("content"), F.col("line")).alias("excerpt"))


def move_of(text):
    """symbol, lines, target of a text such as `name (10-20) -> new/place.py`."""
    p = r"^\s*[-*]?\s*`?([A-Za-z_][\w.]*)`?\s*\((\d+)(?:\s*-\s*(\d+))?\)\s*(?:→|->)\s*`?([^`\s]+)`?"
    g = lambda k: F.regexp_extract(text, p, k)
    return F.when(g(1) != "", F.struct(g(1).alias("symbol"), g(2).cast("int").alias("start"), F.coalesce(g(3).try_cast("int"), g(2).try_cast("int")).alias("end"), g(4).alias("target")))
