"""Coverage of a checklist, themes, audit confidence and actionability."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

# The checklist in order, as (band, id, needs a full audit, pack).
MATRIX = (
    ("p1", "sec.injection", False, "core"),
    ("p1", "sec.xss_csrf", False, "core"),
    ("p1", "sec.authn_authz", False, "core"),
    ("p1", "sec.repo_hygiene_secrets", False, "core"),
    ("p1", "sec.data_exposure", False, "core"),
    ("p1", "sec.deps_supply_chain", False, "core"),
    ("p1", "sec.transport_tls", False, "core"),
    ("p1", "sec.crypto_deser", False, "core"),
    ("p1", "sec.input_validation", False, "core"),
    ("p1", "sec.config_env", True, "extended"),
    ("p1", "sec.privacy_pii", True, "extended"),
    ("p1", "sec.upload_path", True, "extended"),
    ("p1", "sec.session_cookies", True, "extended"),
    ("p1", "sec.rate_abuse", True, "extended"),
    ("p1", "sec.build_release", True, "extended"),
    ("p1", "sec.ssrf", True, "extended"),
    ("p1", "sec.xxe", True, "extended"),
    ("p1", "sec.redos", True, "extended"),
    ("p1", "sec.log_injection", True, "extended"),
    ("p1", "sec.jwt_tokens", True, "extended"),
    ("p1", "sec.weak_prng", True, "extended"),
    ("p2", "rel.edge_cases", False, "core"),
    ("p2", "rel.concurrency", False, "core"),
    ("p2", "rel.error_recovery", False, "core"),
    ("p2", "rel.performance", False, "core"),
    ("p3", "arch.structure_size", False, "core"),
    ("p3", "arch.readability_complexity", False, "core"),
    ("p3", "arch.duplication", False, "core"),
    ("p3", "arch.dead_code", False, "core"),
    ("p3", "arch.consistency_style", False, "core"),
    ("p3", "arch.api", False, "extended"),
    ("p3", "arch.testing", False, "extended"),
    ("p3", "arch.ci_durability", False, "extended"),
    ("p3", "arch.database", True, "extended"),
    ("p3", "arch.frontend", True, "extended"),
    ("p3", "arch.a11y", True, "extended"),
    ("p3", "arch.observability", True, "extended"),
    ("p3", "arch.iac_cloud", True, "extended"),
    ("p3", "arch.i18n", True, "extended"),
    ("p3", "arch.pwa", True, "extended"),
    ("p3", "arch.licensing", True, "extended"),
    ("p3", "arch.scalability", True, "extended"),
    ("p3", "arch.documentation", True, "extended"),
    ("p3", "arch.scores", True, "meta"),
    ("p3", "arch.blast_radius", False, "meta"),
)
#: Extended ids that categories don't map to (they are found in text only).
UNMAPPED = ("sec.ssrf", "sec.xxe", "sec.redos", "sec.log_injection", "sec.jwt_tokens", "sec.weak_prng")
RULE_OF = {"p1": "security", "p2": "reliability", "p3": "architecture"}
PACKS = ("core", "extended", "meta")
MATRIX_SCHEMA = "ord int, id string, rule_id string, band string, full_audit_only boolean, pack string"
MAPPED = tuple(i for _, i, _, pack in MATRIX if pack != "meta" and i not in UNMAPPED)


def matrix(spark) -> DataFrame:
    rows = [(k, i, RULE_OF[b], b, full, pack) for k, (b, i, full, pack) in enumerate(MATRIX)]
    return spark.createDataFrame(rows, MATRIX_SCHEMA)


def load_matrix(spark, text: str) -> DataFrame:
    """A checklist from JSON ({"entries": [...]}), as matrix() gives it; entries that are no objects are skipped, bad ones are an error."""
    entries, rows = json.loads(text).get("entries", []), []
    if not isinstance(entries, list):
        raise ValueError("entries must be a list")
    for e in (x for x in entries if isinstance(x, dict)):
        if not (isinstance(e.get("id"), str) and isinstance(e.get("rule_id"), str)):
            raise ValueError(f"an entry needs id and rule_id: {e!r}")
        pack = str(e.get("pack", "core")).lower()
        if pack not in PACKS:
            raise ValueError(f"{e['id']}: pack must be one of {PACKS}")
        rows.append((len(rows), e["id"], e["rule_id"], str(e.get("band", "p3")).lower(), bool(e.get("full_audit_only", False)), pack))
    return spark.createDataFrame(rows, MATRIX_SCHEMA)


def theme_of(category: Column) -> Column:
    """Theme of a category: by the heuristic map, itself if known, or what it is an alias of; else null."""
    c = F.trim(category)
    known = lambda x: F.when(x.isin(*MAPPED), x)
    return F.coalesce(C.lookup(c, C.HEURISTIC_THEMES), known(c), known(C.canonical_id(c)))


def _each(d: DataFrame, ids: DataFrame, of, name: str) -> DataFrame:
    """id and an aggregate of d for each id of a checklist (a list that its readers go through, so a short one)."""
    known = [r["id"] for r in ids.select("id").distinct().collect()]
    one = d.agg(*[of(i).alias(f"c{k}") for k, i in enumerate(known)]) if known else d.limit(0).agg(F.count("*").alias("none"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.col(f"c{k}").alias(name)) for k, i in enumerate(known)]) if known else F.array().cast(f"array<struct<id:string,{name}:boolean>>")).alias("x")).select("x.*")


def evaluate_coverage(ids: DataFrame, issues: DataFrame, notes: DataFrame) -> DataFrame:
    """id, status (covered, na, missed), reason, invalid: evidence in issues first, then a concrete N/A note.

    ids: ord, id; notes: ord, note. The ids are a small checklist: each is a column of one aggregate over the issues.
    """
    want = ids.select("ord", C.canonical_id(F.col("id")).alias("id")).groupBy("id").agg(F.min("ord").alias("ord"))
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "explanation", "category", "impact", "recommendedFix")]))
    hay = issues.select(theme_of(F.col("category")).alias("theme"), text.alias("hay"))
    # an id's last part stands wherever the whole id does
    part = lambda i: i.lower().rpartition(".")[2]
    seen = _each(hay, want, lambda i: F.coalesce(F.bool_or((F.col("theme") == i) | F.col("hay").contains(part(i))), F.lit(False)), "seen").where("seen")
    na = notes.select("ord", C.canonical_id(C.note_id(F.col("note"))).alias("id"), C.note_reason(F.col("note")).alias("reason")).where("id <> ''")
    na = na.groupBy("id").agg(F.max_by("reason", "ord").alias("reason"))
    j = want.join(seen, "id", "left").join(na, "id", "left")
    covered, lazy = F.col("seen").isNotNull(), C.is_lazy(F.col("reason"))
    ok = ~covered & F.col("reason").isNotNull()
    return j.select("ord", "id", F.when(covered, "covered").when(ok & ~lazy, "na").otherwise("missed").alias("status"), F.when(ok, F.col("reason")).alias("reason"), F.coalesce(ok & lazy, F.lit(False)).alias("invalid"))


# How the notes of missed ids are worded.
MISSED, LAZY, NEITHER = "missed", "lazy N/A rejected", "neither issue nor N/A"


def rewrite_gaps(coverage: DataFrame, gaps: DataFrame) -> DataFrame:
    """lane, ord, gap: lane 0, the gaps as they are, but a coverage note with a lazy reason is told as missed, once; then,
    lane 1, a note for each missed id of the checklist that no gap tells already. gaps: ord, gap."""
    note, reason = C.note_id(F.col("gap")), C.note_reason(F.col("gap"))
    lazy = (note != "") & C.is_lazy(reason)
    told = F.concat(F.lit("coverage:"), note, F.lit(f": {MISSED} \u2014 {LAZY} ("), reason, F.lit(")"))
    d = gaps.select("ord", F.when(lazy, told).otherwise(F.col("gap")).alias("gap"), lazy.alias("lazy"))
    nth = F.row_number().over(Window.partitionBy("gap").orderBy("ord"))
    kept = d.withColumn("nth", nth).where(~F.col("lazy") | (F.col("nth") == 1)).select(F.lit(0).alias("lane"), "ord", "gap")
    ids = F.regexp_extract_all("gap", F.lit(rf"coverage:([^:\s]+): {MISSED}"), F.lit(1))
    known = kept.select(F.explode(ids).alias("known")).distinct()
    return kept.unionByName(gap_notes(coverage).join(known, F.col("id") == F.col("known"), "left_anti").select(F.lit(1).alias("lane"), "ord", F.col("note").alias("gap")))


def all_ran_confidence(scanner_runs: DataFrame) -> DataFrame:
    """n_ran and confidence: 75 where every scanner ran, else 55."""
    ran = F.col("status") == "ran"
    return scanner_runs.agg(F.count_if(ran).alias("n_ran"), F.when(F.coalesce(F.bool_and(ran), F.lit(False)), 75).otherwise(55).alias("confidence"))


def gap_notes(coverage: DataFrame) -> DataFrame:
    """One note for each missed id, in checklist order."""
    return coverage.where("status = 'missed'").select("ord", "id", F.concat(F.lit("coverage:"), "id", F.lit(f": {MISSED} \u2014 {NEITHER}")).alias("note"))


def theme_breakdown(matrix_: DataFrame, coverage: DataFrame, issues: DataFrame, full: bool = False, mode: str = "review") -> DataFrame:
    """id, pack, status, n_findings, notes of the themes that pack and mode allow."""
    m = matrix_.where(F.col("pack").isin("core", "extended") if full else F.col("pack") == "core")
    m = m.where(F.col("id").startswith("sec.") & (F.col("pack") == "core")) if mode == "sentinel" else m.where(F.col("id").startswith("arch.")) if mode == "architecture" else m
    hay = issues.select(theme_of(F.col("category")).alias("theme"), F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("category", "title", "explanation")])).alias("hay"))
    n = _each(hay, m, lambda i: F.count_if((F.col("theme") == i) | F.col("hay").contains(i.lower())), "n")
    c = coverage.select("id", "status", "reason")
    return m.join(n, "id", "left").join(c, "id", "left").select("ord", "id", "pack", F.coalesce("status", F.lit("missed")).alias("status"), F.coalesce("n", F.lit(0)).alias("n_findings"), F.when(F.col("status") == "na", F.col("reason")).otherwise("").alias("notes"))


def _penalties(issues: DataFrame) -> DataFrame:
    """One row: sec, rel, arch: what open critical and high findings take off. Bands overlap."""
    bands = {"sec": C.is_security(F.col("priority"), F.col("category")), "rel": C.is_reliability(F.col("priority"), F.col("category")), "arch": C.is_architecture(F.col("priority"), F.col("category"))}
    n = lambda p, s: F.count_if(p & (F.col("severity") == s))
    return issues.agg(*[(F.least(F.lit(60), 20 * n(p, "CRITICAL")) + F.least(F.lit(50), 10 * n(p, "HIGH"))).alias(k) for k, p in bands.items()])


def audit_metrics(passes: DataFrame, coverage: DataFrame, scanner_runs: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: gate, security, reliability, architecture (null where the pass didn't run).

    passes: name, confidence; coverage as evaluate_coverage gives; scanner_runs: tool, status.
    """
    p = passes.agg(*[F.coalesce(F.max(F.when(F.col("name") == a, F.col("confidence"))), F.max(F.when(F.col("name") == b, F.col("confidence")))).alias(k) for k, a, b in (("p1", "p1", "security"), ("p2", "p2", "reliability"), ("p3", "p3", "architecture"))])
    n = lambda prefix, what: F.count_if(F.col("id").startswith(prefix) & what)
    missed, invalid = F.col("status") == "missed", F.col("invalid")
    cov = coverage.agg(*[n(k + ".", w).alias(f"{k}_{name}") for k in ("sec", "rel", "arch") for name, w in (("missed", missed), ("invalid", invalid))])
    runs = scanner_runs.agg((F.coalesce(F.bool_and(F.col("status") == "ran"), F.lit(False))).alias("all_ran"))
    one = p.join(cov).join(_penalties(issues)).join(runs)
    off = lambda m, i: F.least(F.lit(40), 4 * m) + F.least(F.lit(30), 3 * i)
    score = lambda base, k, bonus: C.clamp(F.col(base) - off(F.col(f"{k}_missed"), F.col(f"{k}_invalid")) + bonus - F.col(k))
    bonus = F.when(F.col("all_ran"), 5).otherwise(0)
    # greatest() skips nulls, so a pass that didn't run is told apart first
    one = one.withColumns({name: F.when(F.col(base).isNotNull(), score(base, k, b)) for name, base, k, b in (("security", "p1", "sec", bonus), ("reliability", "p2", "rel", F.lit(0)), ("architecture", "p3", "arch", F.lit(0)))})
    floor = F.coalesce(F.least("p1", "p2", "p3", "security", "reliability", "architecture"), F.lit(0))
    inside = lambda what: sum((F.when(F.col(name).isNotNull(), F.col(f"{k}_{what}")).otherwise(0) for name, k in (("security", "sec"), ("reliability", "rel"), ("architecture", "arch"))), F.lit(0))
    return one.select(C.clamp(floor - off(inside("missed"), inside("invalid"))).alias("gate"), "security", "reliability", "architecture")


def actionability(issues: DataFrame) -> DataFrame:
    """One row of counters and the share of findings with an example (null without findings)."""
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    high, ex = F.col("severity").isin("CRITICAL", "HIGH"), has("codeExample")
    cnt = {"total_issues": F.lit(True), "critical_high": high, "critical_high_with_example": high & ex, "medium_low": ~high, "medium_low_with_example": ~high & ex, "with_example": ex, "with_impact": has("impact"), "scanner_sourced": F.col("source") == "scanner", "llm_sourced": F.col("source") == "llm", "heuristic_sourced": F.col("source") == "heuristic", "location_verified": F.col("locationVerified"), "location_unverified": ~F.col("locationVerified")}
    return issues.agg(*[F.count_if(v).alias(k) for k, v in cnt.items()], F.try_divide(F.count_if(ex), F.count("*")).alias("fix_readiness"))
