"""Findings in, findings out. Every relation carries `ord`, its order; ties are always decided by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import ordered


def keep_first(df: DataFrame, *keys: str) -> DataFrame:
    """The row with the least ord of each key."""
    row = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.col("ord"))
    return df.groupBy(*[F.col(k).alias(f"key_{k}") for k in keys]).agg(row.alias("row")).select("row.*")


def tally(issues: DataFrame) -> DataFrame:
    """critical, high, medium, low; what is none of the first three counts as low."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return issues.agg(n("CRITICAL").alias("critical"), n("HIGH").alias("high"), n("MEDIUM").alias("medium"), F.count_if(~F.coalesce(F.col("severity").isin("CRITICAL", "HIGH", "MEDIUM"), F.lit(False))).alias("low"))


def merge_reports(issues: DataFrame) -> DataFrame:
    """First of equal (file, title), whatever the severities."""
    return keep_first(issues, "file", "title")


def merge_confidence(parts: DataFrame) -> DataFrame:
    """Least confidence of the parts that have issues or gaps; 0 if none has. parts: confidence, n_issues, n_gaps."""
    return parts.agg(F.coalesce(F.min(F.when((F.col("n_issues") > 0) | (F.col("n_gaps") > 0), F.col("confidence"))), F.lit(0)).alias("confidence"))


def merge_gaps(gaps: DataFrame) -> DataFrame:
    """ord, gap: the gaps of all parts in order (part, ord), each once. gaps: part, ord, gap."""
    first = gaps.groupBy("gap").agg(F.min(F.struct("part", "ord")).alias("at"))
    return ordered.numbered(first, F.col("at"), F.col("gap")).select("ord", "gap")


def first_scores(parts: DataFrame) -> DataFrame:
    """One row, scores: those of the first part that has any. parts: part, scores."""
    return parts.agg(F.min_by("scores", F.when(F.col("scores").isNotNull(), F.col("part"))).alias("scores"))


def cluster(issues: DataFrame) -> DataFrame:
    """One row for each (file, category, weakness or title): the severest, first of ties; clusteredCount where more than one."""
    d = issues.withColumn("k_file", C.norm_match(F.col("file"))).withColumn("k_cat", F.lower(F.trim("category")))
    d = d.withColumn("k_id", F.coalesce(F.nullif(F.lower(F.trim("cwe")), F.lit("")), F.lower(C.norm_text(F.col("title")))))
    row = F.max_by(F.struct(*[F.col(c) for c in issues.columns if c != "ord"]), F.struct(C.sev_rank(F.col("severity")), -F.col("ord")))
    g = d.groupBy("k_file", "k_cat", "k_id").agg(row.alias("r"), F.count("*").alias("n"), F.min("ord").alias("ord"))
    return g.select("ord", "r.*", F.when(F.col("n") > 1, F.col("n")).alias("clusteredCount"))


def sca_dedupe(issues: DataFrame) -> DataFrame:
    """One row for each advisory and package of the two package scanners, `osv` preferred; the others come first, unchanged."""
    sca = F.col("category").isin("osv", "trivy") & (C.advisory_id(F.col("title")) != "")
    d = issues.withColumn("adv", C.advisory_id(F.col("title"))).withColumn("pkg", C.package_hint(F.col("title")))
    row = F.min_by(F.struct(*[F.col(c) for c in issues.columns if c != "ord"]), F.struct((F.col("category") != "osv").cast("int"), F.col("ord")))
    one = d.where(sca).groupBy("adv", "pkg").agg(row.alias("r"), F.min("ord").alias("ord")).select("ord", "r.*", F.lit(1).alias("lane"))
    return issues.where(~sca).withColumn("lane", F.lit(0)).unionByName(one)


def coerce_bands(issues: DataFrame) -> DataFrame:
    lower = (F.col("priority") == "P1") & (F.col("category").startswith("heuristic.") | ~C.is_security_category(F.col("category")))
    return issues.withColumn("priority", F.when(lower, "P2").otherwise(F.col("priority")))


# Fixed values.
SUBPROCESS = r"(?i)subprocess\.(?:run|Popen|call|check_call|check_output)\s*\("
ARGV = r"(?i)subprocess\.(?:run|Popen|call|check_call|check_output)\s*\(\s*(?:argv|args|cmd|command|\[[^\]]*\])"
INJECTION = r"(?i)sec\.injection|command\s+injection|subprocess"
SECRET = r"(?i)secret|credential|api[_ ]?key|token|password|gitleaks|hardcoded"
FIXTURE_PATH = r"(?i)(^|/)(tests?/fixtures?/|testdata/|fixtures/)"
EXAMPLE_PATH = r"(?i)(^|/)(examples?/|demos?/|fixtures?/vuln)"
INTENTIONAL = r"(?i)intentional|deliberate|vulnerable\s+example|vuln[_ ]?demo|for\s+training|demo\s+only|example\s+vuln|do\s+not\s+ship"
CALIBRATIONS = ("subprocess_list_not_injection", "test_fixture_secrets", "intentional_vuln_example")


def _text(*names: str):
    return F.concat_ws("\n", *[F.coalesce(F.col(n), F.lit("")) for n in names])


def _demote(issues: DataFrame, tag_column: str) -> DataFrame:
    """Rows with a tag go to LOW and get it as a prefix, unless they are LOW already."""
    hit = F.col(tag_column).isNotNull() & F.col("severity").isin("CRITICAL", "HIGH", "MEDIUM")
    prefix = F.concat(F.lit("[calibrated: "), F.col(tag_column), F.lit("]"))
    text = F.when(F.col("explanation").contains(prefix), F.col("explanation")).otherwise(F.concat(prefix, F.lit(" "), F.col("explanation")))
    return issues.withColumns({"explanation": F.when(hit, text).otherwise(F.col("explanation")), "severity": F.when(hit, "LOW").otherwise(F.col("severity"))}).drop(tag_column)


def calibrate(issues: DataFrame, enabled=CALIBRATIONS) -> DataFrame:
    """Known false positives go to LOW; the first rule that fits gives the tag."""
    text, path = _text("category", "title", "explanation", "codeExample", "recommendedFix"), F.replace(F.coalesce(F.col("file"), F.lit("")), F.lit("\\"), F.lit("/"))
    safe = text.rlike(SUBPROCESS) & ~text.rlike(r"shell\s*=\s*True") & (text.rlike(ARGV) | text.rlike(r"shell\s*=\s*False"))
    rules = {
        CALIBRATIONS[0]: text.rlike(INJECTION) & safe,
        CALIBRATIONS[1]: path.rlike(FIXTURE_PATH) & text.rlike(SECRET),
        CALIBRATIONS[2]: path.rlike(EXAMPLE_PATH) & text.rlike(INTENTIONAL),
    }
    tag = F.coalesce(*[F.when(rules[k], F.lit(k)) for k in CALIBRATIONS if k in enabled], F.lit(None).cast("string"))
    return _demote(issues.withColumn("cal_tag", tag), "cal_tag")


def hot_categories(feedback: DataFrame, least: int = 2) -> DataFrame:
    d = feedback.where(F.trim("reason") == "false_positive").select(F.lower(F.trim("category")).alias("hot"))
    return d.where("hot <> ''").groupBy("hot").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def calibrate_by_feedback(issues: DataFrame, feedback: DataFrame) -> DataFrame:
    """Issues other than scanners' go to LOW where users called the file and category, or the category twice, false."""
    d = feedback.where(F.trim("reason") == "false_positive").select(C.norm_match(F.col("file")).alias("f_file"), F.lower(F.trim("category")).alias("f_cat"))
    pairs = d.where("f_file <> '' and f_cat <> ''").distinct()
    hot = hot_categories(feedback).select("hot")
    j = issues.withColumns({"n_file": C.norm_match(F.coalesce("file", F.lit(""))), "n_cat": F.lower(F.trim(F.coalesce("category", F.lit(""))))})
    j = j.join(pairs, (F.col("n_file") == F.col("f_file")) & (F.col("n_cat") == F.col("f_cat")), "left").join(hot, F.col("n_cat") == F.col("hot"), "left")
    hit = (F.col("f_cat").isNotNull() | F.col("hot").isNotNull()) & (C.infer_source(F.col("source"), F.col("category")) != "scanner")
    j = j.withColumn("cal_tag", F.when(hit, F.lit("feedback_false_positive"))).drop("n_file", "n_cat", "f_file", "f_cat", "hot")
    return _demote(j, "cal_tag")


def suppress_by_rules(issues: DataFrame, rules: DataFrame, today: str) -> DataFrame:
    """issues with `mechanism`, `s_reason`, `rule_ord` of the first active rule that fits by id, or by file and category.

    rules: ord, stable_id, file, category, reason, expires. Two equi-joins stand for the OR.
    """
    act = rules.where(F.col("expires").isNull() | (F.lit(today).cast("date") <= F.col("expires")))
    r = act.select(F.col("ord").alias("rule_ord"), F.lower("stable_id").alias("r_id"), C.norm_match(F.col("file")).alias("r_file"), F.lower(F.trim("category")).alias("r_cat"), F.col("reason").alias("s_reason"))
    key = issues.select(F.col("ord").alias("i_ord"), F.lower("stable_id").alias("i_id"), C.norm_match(F.col("file")).alias("i_file"), F.lower(F.trim("category")).alias("i_cat"))
    by_id = key.join(r.where("r_id is not null"), F.col("i_id") == F.col("r_id")).select("i_ord", "rule_ord", "s_reason")
    by_file = key.join(r.where("r_file is not null and r_cat is not null"), (F.col("i_file") == F.col("r_file")) & (F.col("i_cat") == F.col("r_cat"))).select("i_ord", "rule_ord", "s_reason")
    first = by_id.unionAll(by_file).groupBy("i_ord").agg(F.min(F.struct("rule_ord", "s_reason")).alias("m")).select("i_ord", "m.*")
    return issues.join(first, issues.ord == first.i_ord, "left").drop("i_ord").withColumn("mechanism", F.when(F.col("rule_ord").isNotNull(), "ignore_file"))


def disabled_lines(files: DataFrame, marker: str = "tidewrack") -> DataFrame:
    """(relative, line) that disable comments cover: whole-line `# marker:disable` to `enable`, and disable-next-line."""
    # texts without the marker's words cover nothing; their lines never become rows
    files = files.where(F.lower("content").contains(f"{marker}:disable".lower()))
    d = files.select("relative", F.posexplode(C.split_lines(F.col("content"))).alias("line", "text")).withColumn("line", F.col("line") + 1)
    t = F.trim("text")
    kind = F.when(t.rlike(rf"(?i)^(?:#|//)\s*{marker}:enable\s*$"), "on").when(t.rlike(rf"(?i)^(?:#|//)\s*{marker}:disable(?:\s+\S+)?\s*$"), "off").when(t.rlike(rf"(?i)^(?:#|//)\s*{marker}:disable-next-line(?:\s+\S+)?\s*$"), "next")
    d = d.withColumn("mark", kind)
    w = Window.partitionBy("relative").orderBy("line")
    state = F.last(F.when(F.col("mark").isin("on", "off"), F.col("mark")), ignorenulls=True).over(w)
    covered = (F.col("mark").isNull() & (state == "off")) | F.coalesce(F.lag("mark").over(w) == "next", F.lit(False))
    return d.withColumn("hit", covered).where("hit").select("relative", "line")


def suppress_by_comments(issues: DataFrame, files: DataFrame, marker: str = "tidewrack") -> DataFrame:
    """Issues other than scanners' on covered lines get mechanism disable_comment, where they have none."""
    lines = disabled_lines(files, marker).select(C.norm_route(F.col("relative")).alias("d_file"), F.col("line").alias("d_line"))
    hit = (C.norm_route(issues.file) == F.col("d_file")) & (issues.line == F.col("d_line")) & (C.infer_source(issues.source, issues.category) != "scanner")
    j = issues.join(lines.distinct(), hit, "left")
    mech = F.when(F.col("d_file").isNotNull(), "disable_comment")
    mech = F.coalesce(F.col("mechanism"), mech) if "mechanism" in issues.columns else mech
    return j.withColumn("mechanism", mech).drop("d_file", "d_line")


def consistency(issues: DataFrame, include_high: bool = False, tag: str = "[unverified location]") -> DataFrame:
    """CRITICAL (and HIGH, if asked) rows of other than scanners whose location is known to be wrong go one severity down."""
    sev, wanted = F.col("severity"), ["CRITICAL", "HIGH"] if include_high else ["CRITICAL"]
    hit = sev.isin(*wanted) & (C.infer_source(F.col("source"), F.col("category")) != "scanner") & F.col("locationVerified").eqNullSafe(F.lit(False))
    lower = F.when(sev == "CRITICAL", "HIGH").when(sev == "HIGH", "MEDIUM").otherwise("LOW")
    return issues.withColumns({"explanation": F.when(hit, C.tagged(F.col("explanation"), tag)).otherwise(F.col("explanation")), "severity": F.when(hit, lower).otherwise(sev)})


def verify(issues: DataFrame, tag: str = "[location not verified]") -> DataFrame:
    """CRITICAL rows that are not verified get a tag; severity stays."""
    hit = (F.col("severity") == "CRITICAL") & ~F.coalesce(F.col("locationVerified"), F.lit(False))
    return issues.withColumn("explanation", F.when(hit, C.tagged(F.col("explanation"), tag)).otherwise(F.col("explanation")))


def apply_decisions(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: n (order), ord, severity. The last decision for a row counts; a raise is refused."""
    last = decisions.groupBy(F.col("ord").alias("d_ord")).agg(F.max_by("severity", "n").alias("d_sev"))
    j = issues.join(last, issues.ord == last.d_ord, "left")
    ok = C.sev_rank(F.col("d_sev")) < C.sev_rank(F.col("severity"))
    return j.withColumn("severity", F.when(ok, F.col("d_sev")).otherwise(F.col("severity"))).drop("d_ord", "d_sev")


def gate(issues: DataFrame, fail_on: str, scanner_only: bool = False) -> DataFrame:
    """One row: failed (any issue at or over the level), n_hits. An unknown level is an error."""
    if fail_on.upper() not in C.SEVERITIES:
        raise ValueError(f"unknown severity {fail_on!r}")
    hit = C.at_least(F.col("severity"), fail_on)
    if scanner_only:
        hit = hit & (C.infer_source(F.col("source"), F.col("category")) == "scanner")
    return issues.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("failed"), F.count_if(hit).alias("n_hits"))


def reuse(prior: DataFrame, new: DataFrame) -> DataFrame:
    """The prior rows, then new rows of other (file, line, title), first of equal ones."""
    fresh = keep_first(new.join(prior.select("file", "line", "title"), ["file", "line", "title"], "left_anti").select(*new.columns), "file", "line", "title")
    return prior.withColumn("lane", F.lit(0)).unionByName(fresh.withColumn("lane", F.lit(1)))


def find_issue(issues: DataFrame, uuid: str) -> DataFrame:
    """The issue of this run id, else the first of this stable id."""
    rank = F.when(F.lower("runId") == uuid.lower(), 0).when(F.lower("stableId") == uuid.lower(), 1)
    return issues.withColumn("rank", rank).where("rank is not null").orderBy("rank", "ord").limit(1).drop("rank")


def violations(issues: DataFrame) -> DataFrame:
    """`violations`: what keeps a row from being a finding (closed values, line, evidence of high severities)."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    high = F.col("severity").isin("CRITICAL", "HIGH")
    checks = {"severity": ~F.coalesce(F.col("severity").isin(*C.SEVERITIES), F.lit(False)), "priority": ~F.coalesce(F.col("priority").isin("P1", "P2", "P3"), F.lit(False)), "line": ~F.coalesce(F.col("line") >= 1, F.lit(False)), "impact": high & blank("impact"), "codeExample": high & blank("codeExample")}
    return issues.withColumn("violations", F.filter(F.array(*[F.when(v, k) for k, v in checks.items()]), lambda x: x.isNotNull()))


def issue_meta(issues: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (stable_id) with category, file and title of the first issue of the id, active or suppressed; blank where there is none."""
    first = issues.groupBy(F.lower("stable_id").alias("m_id")).agg(F.min_by(F.struct("category", "file", "title"), "ord").alias("m"))
    j = ids.join(first, F.lower(F.trim("stable_id")) == F.col("m_id"), "left")
    return j.select("stable_id", *[F.coalesce(f"m.{c}", F.lit("")).alias(c) for c in ("category", "file", "title")])


def is_vacuous(reports: DataFrame) -> DataFrame:
    """reports (confidence, n_issues, n_gaps) with `vacuous`: no confidence, no findings, no gaps."""
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    return reports.withColumn("vacuous", none("confidence") & none("n_issues") & none("n_gaps"))
