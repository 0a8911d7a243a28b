"""Scanner reports (JSON text) to findings. Input: a frame with `json`, one report a row; output in document order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT = ("severity", "priority", "category", "file", "line", "title", "explanation", "packageName", "installedVersion", "fixedVersion", "advisoryId")


def _or(c: Column, default) -> Column:
    """The value, or the default where it is null, empty or zero."""
    d = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), d)


def _line(c: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(c.cast("int"), F.lit(1)))


def _issue(df: DataFrame, tool: str, severity: Column, priority: Column, **cols: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    c = {"severity": severity, "priority": priority, "category": F.lit(tool), **cols}
    return df.select(*[c.get(k, none).alias(k) for k in OUT])


def _band(sev: Column) -> Column:
    return F.when(sev.isin("CRITICAL", "HIGH"), "P1").otherwise("P2")


def _severity(c: Column) -> Column:
    s = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(s.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), s).when(s.isin("ERROR", "SEVERE"), "HIGH").when(s.isin("WARNING", "MODERATE"), "MEDIUM").when(s.isin("INFO", "NEGLIGIBLE"), "LOW").otherwise("MEDIUM")


def gitleaks(raw: DataFrame) -> DataFrame:
    t = "array<struct<File:string,StartLine:int,RuleID:string,Description:string>>"
    d = raw.select(F.explode(F.from_json("json", t)).alias("x"))
    rule = _or(F.col("x.RuleID"), _or(F.col("x.Description"), "secret"))
    return _issue(d, "gitleaks", F.lit("HIGH"), F.lit("P1"), file=_or(F.col("x.File"), "unknown"), line=_line(F.col("x.StartLine")), title=F.concat(F.lit("Secret detected: "), rule), explanation=_or(F.col("x.Description"), rule))


def semgrep(raw: DataFrame) -> DataFrame:
    t = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<severity:string,message:string>>>>"
    d = raw.select(F.explode(F.from_json("json", t)["results"]).alias("x"))
    s = F.upper(F.coalesce("x.extra.severity", F.lit("WARNING")))
    sev = F.when(s == "ERROR", "HIGH").when(s == "INFO", "LOW").otherwise("MEDIUM")
    rule = _or(F.col("x.check_id"), "semgrep")
    return _issue(d, "semgrep", sev, _band(sev), file=_or(F.col("x.path"), "unknown"), line=_line(F.col("x.start.line")), title=F.concat(F.lit("Semgrep: "), rule), explanation=_or(F.col("x.extra.message"), rule))


def osv(raw: DataFrame) -> DataFrame:
    t = "struct<results:array<struct<source:struct<path:string>,packages:array<struct<package:struct<name:string>,vulnerabilities:array<struct<id:string,summary:string>>>>>>>"
    d = raw.select(F.explode(F.from_json("json", t)["results"]).alias("r")).select("r.source.path", F.explode("r.packages").alias("p")).select("path", "p.package.name", F.explode("p.vulnerabilities").alias("v"))
    i, pkg = _or(F.col("v.id"), "CVE"), _or(F.col("name"), "package")
    return _issue(d, "osv", F.lit("HIGH"), F.lit("P1"), file=_or(F.col("path"), "dependencies"), line=F.lit(1), title=F.concat(i, F.lit(" in "), pkg), explanation=_or(F.col("v.summary"), i), packageName=pkg, advisoryId=i)


def trivy(raw: DataFrame) -> DataFrame:
    t = "struct<Results:array<struct<Target:string,Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,Title:string,FixedVersion:string,InstalledVersion:string,Description:string,Severity:string>>,Misconfigurations:array<struct<ID:string,AvdID:string,Title:string,Description:string,Severity:string,PrimaryURL:string,CauseMetadata:struct<StartLine:int>>>>>>"
    r = raw.select(F.explode(F.from_json("json", t)["Results"]).alias("r")).select(_or(F.col("r.Target"), "unknown").alias("tgt"), "r.*")
    v = r.select("tgt", F.explode("Vulnerabilities").alias("x"))
    i, pkg = _or(F.col("x.VulnerabilityID"), "CVE"), _or(F.col("x.PkgName"), "package")
    title = _or(F.col("x.Title"), i)
    a = _issue(v, "trivy", _severity(F.col("x.Severity")), F.lit("P1"), file=F.col("tgt"), line=F.lit(1), title=F.substring(F.concat(i, F.lit(" in "), pkg, F.lit(": "), title), 1, 200), explanation=F.substring(_or(F.col("x.Description"), title), 1, 2000), packageName=pkg, installedVersion=F.nullif(F.trim("x.InstalledVersion"), F.lit("")), fixedVersion=F.nullif(F.trim("x.FixedVersion"), F.lit("")), advisoryId=i)
    m = r.select("tgt", F.explode("Misconfigurations").alias("x"))
    i = _or(F.col("x.ID"), _or(F.col("x.AvdID"), "misconfig"))
    title, url = _or(F.col("x.Title"), i), F.trim(F.coalesce("x.PrimaryURL", F.lit("")))
    text = F.concat(F.substring(_or(F.col("x.Description"), title), 1, 2000), F.when(url != "", F.concat(F.lit("\n"), url)).otherwise(""))
    b = _issue(m, "trivy", _severity(F.col("x.Severity")), F.lit("P1"), file=F.col("tgt"), line=_line(F.col("x.CauseMetadata.StartLine")), title=F.substring(F.concat(i, F.lit(": "), title), 1, 200), explanation=text)
    return a.unionAll(b)


def checkov(raw: DataFrame, root: str = "") -> DataFrame:
    """A report is an object or a list of objects; paths lose the root or a leading slash."""
    item = "struct<results:struct<failed_checks:array<struct<check_id:string,check_name:string,repo_file_path:string,file_path:string,file_line_range:array<int>,severity:string,guideline:string>>>>"
    one = F.when(F.trim("json").startswith("["), F.from_json("json", f"array<{item}>")).otherwise(F.array(F.from_json("json", item)))
    d = raw.select(F.explode(one).alias("b")).select(F.explode("b.results.failed_checks").alias("x"))
    i = _or(F.col("x.check_id"), "CKV")
    name, guide = _or(F.col("x.check_name"), i), F.trim(F.coalesce("x.guideline", F.lit("")))
    path = F.trim(_or(F.col("x.repo_file_path"), _or(F.col("x.file_path"), "unknown")))
    path = F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))).otherwise(F.ltrim(path, F.lit("/"))) if root else F.ltrim(path, F.lit("/"))
    text = F.concat(name, F.when(guide != "", F.concat(F.lit("\n"), guide)).otherwise(""))
    return _issue(d, "checkov", _severity(F.col("x.severity")), F.lit("P1"), file=path, line=_line(F.get(F.col("x.file_line_range"), F.lit(0))), title=F.substring(F.concat(i, F.lit(": "), name), 1, 200), explanation=text)


ADAPTERS = {"gitleaks": gitleaks, "semgrep": semgrep, "osv": osv, "trivy": trivy, "checkov": checkov}


def resolve(flag: str, configured=("gitleaks", "semgrep", "osv")) -> list[str]:
    """`auto` (the configured ones), `off`, or a comma-separated list; an unknown name is an error."""
    names = list(configured) if flag == "auto" else [] if flag == "off" else [x.strip().lower() for x in flag.split(",") if x.strip()]
    if bad := [x for x in names if x not in ADAPTERS]:
        raise ValueError(f"unknown scanners: {bad}")
    return names


def run(reports: DataFrame, tools) -> tuple[DataFrame, DataFrame]:
    """reports: tool, status (ran, skipped, failed), json. Findings with tool_ord, and runs (tool, status, n_findings).

    A report that ran but isn't JSON failed.
    """
    ok = reports.withColumn("status", F.when((F.col("status") == "ran") & (F.trim(F.coalesce("json", F.lit(""))) != "") & F.try_parse_json("json").isNull(), "failed").otherwise(F.col("status")))
    parts = [ADAPTERS[t](ok.where((F.col("tool") == t) & (F.col("status") == "ran"))).withColumn("tool_ord", F.lit(k)) for k, t in enumerate(tools)]
    found = reduce(DataFrame.unionAll, parts)
    n = found.groupBy(F.col("category").alias("t")).agg(F.count("*").alias("n"))
    runs = ok.where(F.col("tool").isin(*tools)).join(n, F.col("tool") == F.col("t"), "left").select("tool", "status", F.coalesce("n", F.lit(0)).alias("n_findings"))
    return found, runs


def gaps(runs: DataFrame) -> DataFrame:
    """tool, gap of scanners that were skipped or failed. runs: tool, status, detail."""
    failed = F.concat(F.lit("scanner:"), "tool", F.lit(" failed: "), F.coalesce("detail", F.lit("")))
    gap = F.when(F.col("status") == "skipped", F.concat(F.lit("scanner:"), "tool", F.lit(" missing: install it by hand"))).when(F.col("status") == "failed", failed)
    return runs.select("tool", gap.alias("gap")).where("gap is not null")


def missing_required(tools: DataFrame, runs: DataFrame) -> DataFrame:
    """Tools (tool) that were asked for and were skipped."""
    return tools.join(runs.where("status = 'skipped'").select("tool").distinct(), "tool", "left_semi")


COPYLEFT = ("GPL", "AGPL", "LGPL", "SSPL", "OSL", "CPAL", "EUPL")
# What a component's note says of such a licence, and of one without id and name.
OBLIGATIONS, UNNAMED = " [copyleft \u2014 review distribution obligations]", "unknown"
_BOM = "struct<components:array<struct<name:string,version:string,licenses:array<struct<license:string,expression:string>>>>>"


def _components() -> Column:
    """The components of `json` in one array of structs: ord, component, version, entries."""

    def text(x: Column) -> Column:
        lic = x.getField("license")
        known, is_object = ~lic.isin("", "{}"), lic.startswith("{")
        named = F.coalesce(F.nullif(F.get_json_object(lic, "$.id"), F.lit("")), F.nullif(F.get_json_object(lic, "$.name"), F.lit("")))
        one = F.when(known & is_object, named).when(known, lic).otherwise(F.nullif(x.getField("expression"), F.lit("")))
        return F.struct(one.alias("text"), F.when(known & is_object, UNNAMED).alias("unnamed"))

    def entry(x: Column) -> Column:
        return F.struct(F.nullif(F.trim(x.getField("text")), F.lit("")).alias("id"), F.coalesce(x.getField("text"), x.getField("unnamed")).alias("label"))

    def component(c: Column, i: Column) -> Column:
        # each licence's text is worked out once, by a transform of its own
        entries = F.transform(F.transform(F.coalesce(c.getField("licenses"), F.expr("array()").cast("array<struct<license:string,expression:string>>")), text), entry)
        known = F.filter(entries, lambda e: e.getField("label").isNotNull())
        return F.when(c.isNotNull(), F.struct(i.alias("ord"), _or(c.getField("name"), "package").alias("component"), F.trim(F.coalesce(c.getField("version"), F.lit(""))).alias("version"), known.alias("entries")))

    return F.transform(F.from_json("json", _BOM)["components"], component)


def _of_documents(raw: DataFrame, cs: Column) -> DataFrame:
    """doc and a row for each of some components."""
    doc = raw["doc"] if "doc" in raw.columns else F.monotonically_increasing_id().alias("doc")
    return raw.select(doc, F.explode(cs).alias("c")).select("doc", "c.*")


def components(raw: DataFrame) -> DataFrame:
    """doc, ord (position in its document), component, version, entries (its licences' id and label) of CycloneDX documents.

    raw: json, and `doc` if documents have an order of their own. An entry is a license object, a license text or an
    expression; its id is null where it has neither id nor name.
    """
    return _of_documents(raw, F.filter(_components(), lambda c: c.isNotNull()))


def is_copyleft(text: Column) -> Column:
    return F.upper(text).rlike("|".join(COPYLEFT))


def licenses(raw: DataFrame) -> DataFrame:
    """doc, ord, component, nth, license, copyleft: a row for each named licence of each component."""
    d = components(raw).select("doc", "ord", "component", F.posexplode("entries").alias("nth", "e"))
    return d.select("doc", "ord", "component", "nth", F.col("e.id").alias("license")).where("license is not null").withColumn("copyleft", is_copyleft(F.col("license")))


def license_ids(lic: DataFrame, cap: int = 80) -> DataFrame:
    """The first `cap` distinct licences as the documents name them, in order of their names."""
    first = lic.groupBy("license").agg(F.min(F.struct("doc", "ord", "nth")).alias("at"))
    return first.orderBy("at", "license").limit(cap).select("license").orderBy("license")


def license_notes(raw: DataFrame, cap: int | None = 40) -> DataFrame:
    """doc, ord, note: `name@version: licences` of the first `cap` components of each document (a row of raw) that have any; of all with None."""
    # a document's list is made within its row: nothing is shuffled or sorted
    licensed = F.filter(_components(), lambda c: F.size(c.getField("entries")) > 0)
    d = _of_documents(raw, licensed if cap is None else F.slice(licensed, 1, cap))
    label = F.when(F.col("version") != "", F.concat("component", F.lit("@"), "version")).otherwise(F.col("component"))
    d = d.select("doc", "ord", label.alias("label"), F.array_join(F.transform("entries", lambda e: e.getField("label")), ", ").alias("ids"))
    return d.select("doc", "ord", F.concat("label", F.lit(": "), "ids", F.when(is_copyleft(F.col("ids")), OBLIGATIONS).otherwise("")).alias("note"))


def supply_chain(raw: DataFrame) -> DataFrame:
    """One row for all documents: n_components, n_licensed (components with a named licence), n_copyleft (licences), license_ids, gap (a note where there is no document)."""
    known = raw.agg(F.coalesce(F.bool_or(F.try_parse_json("json").isNotNull()), F.lit(False)).alias("known"))
    named = F.filter("entries", lambda e: e.getField("id").isNotNull())
    n = components(raw).agg(
        F.count("*").alias("n_components"), F.count_if(F.size(named) > 0).alias("n_licensed"),
        F.coalesce(F.sum(F.size(F.filter("entries", lambda e: is_copyleft(e.getField("id"))))), F.lit(0)).cast("long").alias("n_copyleft"),
    )
    ids = license_ids(licenses(raw)).agg(F.array_sort(F.collect_set("license")).alias("license_ids"))
    return n.join(known).join(ids).select("n_components", "n_licensed", "n_copyleft", "license_ids", F.when(~F.col("known"), "sbom: no document").otherwise("").alias("gap"))
