"""A review as one plan: files to findings, conformed in a fixed order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import anchors, findings, heuristics, ordered, planning, score

FIELDS = {"severity": "string", "priority": "string", "category": "string", "file": "string", "line": "int", "title": "string", "explanation": "string", "impact": "string", "recommendedFix": "string", "codeExample": "string", "cwe": "string", "source": "string", "quote": "string", "locationVerified": "boolean", "packageName": "string"}


def conform_schema(df: DataFrame, lane: int) -> DataFrame:
    """df with all fields of a finding, missing ones null, and its lane."""
    return df.select(*[(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in FIELDS.items()], F.lit(lane).alias("lane"))


def numbered(parts: list[DataFrame]) -> DataFrame:
    """The union of the lanes with ord, from 1: (lane, file, line, category, title)."""
    all_ = conform_schema(parts[0], 0)
    for k, p in enumerate(parts[1:], 1):
        all_ = all_.unionByName(conform_schema(p, k))
    first = ("lane", "file", "line", "category", "title")
    out = ordered.numbered(all_, *[F.col(c) for c in (*first, *[c for c in FIELDS if c not in first])])
    return out.withColumn("ord", F.col("ord") + 1).drop("lane")


def conform(issues: DataFrame, files: DataFrame, rules: DataFrame, feedback: DataFrame, today: str) -> DataFrame:
    """Sources, ids, feedback, clusters, suppression, places, consistency, verification - in this order."""
    d = issues.withColumn("source", C.stamp_source(F.col("source"), F.col("category"), default_llm=True))
    d = d.withColumn("explanation", F.coalesce("explanation", F.lit(""))).withColumn("stable_id", C.stable_id(F.col("category"), F.col("file"), F.col("title"), "tidewrack"))
    d = findings.cluster(findings.calibrate_by_feedback(findings.calibrate(d), feedback))
    d = findings.suppress_by_comments(findings.suppress_by_rules(d, rules, today), files)
    d = anchors.stamp(d, anchors.nearest(d, files), files)
    return findings.verify(findings.consistency(d))


def run(files: DataFrame, scanner: DataFrame, rules: DataFrame, feedback: DataFrame, today: str, model: Callable[[DataFrame], DataFrame] | None = None, packs=("cloud",), mode: str = "review", full_audit: bool = True, registry: DataFrame | None = None, notes: DataFrame | None = None) -> dict[str, DataFrame]:
    """inventory, issues, suppressed, tally, coverage, gaps, themes, gate, and with a registry of rules (id, band, enabled, body) passes and playbooks.

    model: files to findings, off by default. The mode (review, sentinel, architecture) chooses the checklist's bands, the passes and
    their texts, and the themes; notes (ord, note): what the passes said of their checklist.
    """
    lane = planning.inventory(files, 10_000)
    heur = heuristics.run(lane, packs)
    parts = [scanner, heur, *([model(planning.inventory(files, 200))] if model else [])]
    all_ = conform(findings.merge_reports(numbered(parts)), lane, rules, feedback, today)
    active = all_.where("mechanism is null")
    spark = files.sparkSession
    m = score.matrix(spark)
    mine = m.where(F.col("band").isin(*planning.MODE_BANDS[mode]) & (F.lit(full_audit) | ~F.col("full_audit_only")))
    notes = spark.createDataFrame([], "ord int, note string") if notes is None else notes
    cov = score.evaluate_coverage(mine.select("ord", "id"), active, notes)
    out = {"inventory": lane, "issues": active, "suppressed": all_.where("mechanism is not null"), "tally": findings.tally(active), "coverage": cov, "gaps": score.rewrite_gaps(cov, notes.withColumnRenamed("note", "gap")), "themes": score.theme_breakdown(m, cov, active, full=full_audit or mode == "architecture", mode=mode), "gate": findings.gate(active, "HIGH")}
    if registry is not None:
        out |= {"passes": planning.deep_passes(registry, m, mode, full_audit), "playbooks": planning.playbooks(registry, mode, full_audit)}
    return out
