"""Registered queries of the engine's operators over general tables, each with its DuckDB oracle where SQL can say it."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import diagrams
from ..operators import anchors, coerce, documents, explain, findings, heuristics, ordered, planning, score, search, segments, sinks, symbols
from ..shared import cut, shared_dir
from ..sources import chunks, store
from ..sources import rules as report_rules
from ..sources import scanners
from . import views as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None, deal: bool = False, **inputs: str):
    """Register fn(spark, **frames); inputs name mappings of views (dealt out by rows with `deal`), which the oracle sees as CTEs."""

    def add(fn):
        name = fn.__name__

        def run(spark, sf_dir):
            return fn(spark, **{k: V.view(spark, sf_dir, sql, deal) for k, sql in inputs.items()})

        QUERIES[name] = run
        if oracle is not None:
            ctes = ", ".join(f"{k} AS ({re.sub(r'{(\w+)}', r'\1', sql)})" for k, sql in inputs.items())
            ORACLES[name] = oracle if oracle in ORACLES.values() else f"WITH {ctes}{', ' if not oracle.lstrip().upper().startswith('SELECT') else ' '}{oracle}" if ctes else oracle
        return fn

    return add


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _has(expr: str, values) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{v}')" for v in values) + ")"


RANK = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"
NAME, EXT = "string_split(relative, '/')[-1]", r"regexp_extract(string_split(relative, '/')[-1], '^.+?(\.[^.]+)$', 1)"
LINES = r"CASE WHEN length(content) = 0 THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END END"
BAND = f"CASE WHEN {_has('lower(relative)', C.BAND1_HINTS)} THEN 1 WHEN {_has('lower(relative)', C.BAND2_HINTS)} THEN 2 ELSE 3 END"
IGNORED = f"(list_has_any(string_split(relative, '/'), [{', '.join(repr(x) for x in C.IGNORED_DIRS)}]) OR lower({EXT}) IN {_in(C.IGNORED_SUFFIXES)} OR regexp_matches(lower({NAME}), '\\.min\\.(js|css)$'))"
SCANNER = _has("lower(category)", C.SCANNERS)
SOURCE = f"coalesce(source, CASE WHEN {SCANNER} THEN 'scanner' WHEN starts_with(lower(category), 'heuristic.') OR starts_with(lower(category), 'pack.') THEN 'heuristic' ELSE 'llm' END)"
NORM = "ltrim(lower(replace(trim({}), chr(92), '/')), './')"
SECCAT = f"(starts_with(lower(category), 'sec.') OR starts_with(lower(category), 'security') OR {SCANNER})"


# ---- inventory ----


@_query(f"SELECT relative, size, {BAND}::INT AS priority_band FROM files WHERE NOT {IGNORED} AND size <= 200000 ORDER BY 3, 1 LIMIT 200", files=V.FILES)
def inventory_topn(spark, files):
    return planning.inventory(files).select("relative", "size", "priority_band")


@_query(f"SELECT {BAND}::INT AS priority_band, count(*) AS n, sum(size)::BIGINT AS bytes FROM files WHERE NOT {IGNORED} AND size <= 200000 GROUP BY 1", files=V.FILES)
def inventory_band_counts(spark, files):
    return planning.inventory(files, 0).groupBy("priority_band").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@_query(f"n AS (SELECT count(*) AS total FROM files WHERE NOT {IGNORED} AND size <= 200000) SELECT total AS total_matched, least(total, 200) AS n_files, total > 200 AS truncated FROM n", files=V.FILES)
def inventory_stats(spark, files):
    return planning.inventory_stats(files)


# ---- heuristics ----


@_query(rf"SELECT relative AS file, 1 AS line, 'File has ' || ({LINES}) || ' lines' AS title, 'MEDIUM' AS severity, 'P2' AS priority, 'heuristic.mega_file' AS category FROM files WHERE ({LINES}) >= 40 AND NOT regexp_matches(relative, '/[^/]*\.(md|xcuserstate|pbxproj)$') AND NOT list_has_any(string_split(relative, '/'), ['docs', '.superpowers', 'xcuserdata'])", files=V.FILES)
def mega_files(spark, files):
    return heuristics.mega_files(files, 40)


#: The driver's texts hold no open markers and no commented code: common words stand in for them.
_OPEN = V.FILES.replace("coalesce(text, '')", "replace(replace(replace(coalesce(text, ''), ' the ', ' TODO '), ' of ', ' FIXME: '), ' is ', concat(chr(10), ' # import '))")


@_query(r"c AS (SELECT relative, len(regexp_extract_all(content, '\b(TODO|FIXME|XXX|HACK)\b')) + len(regexp_extract_all(content, '(?m)^\s*(#|//)\s*(def |class |function |const |let |var |import |return |if |for )')) AS n FROM files WHERE NOT starts_with(relative, 'tests/fixtures/')) SELECT relative AS file, 1 AS line, 'Open markers: ' || n AS title, 'LOW' AS severity, 'P3' AS priority, 'heuristic.todo_density' AS category FROM c WHERE n >= 8", files=_OPEN)
def todo_density(spark, files):
    return heuristics.todo_density(files, 8)


@_query(rf"c AS (SELECT *, lower({NAME}) AS name FROM files WHERE NOT starts_with(relative, 'tests/fixtures/')) SELECT relative AS file, 1 AS line, 'Script handles credentials in plain text' AS title, CASE WHEN contains(name, 'notarize') OR contains(lower(content), 'password') THEN 'MEDIUM' ELSE 'LOW' END AS severity, 'P2' AS priority, 'heuristic.scripts_hygiene' AS category FROM c WHERE (lower({EXT}) IN {_in(heuristics.SCRIPTS)} OR contains(name, 'notarize')) AND regexp_matches(content, '{heuristics.PASSWORD}') AND NOT regexp_matches(content, '{heuristics.KEYCHAIN}')", files=V.FILES)
def script_hygiene(spark, files):
    return heuristics.script_hygiene(files)


_SIBLING = f"""p AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in heuristics.PREFIX_PAIRS)}) AS t(l, r)),
s AS (SELECT relative, CASE WHEN contains(relative, '/') THEN regexp_extract(relative, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir, {EXT} AS ext, left({NAME}, length({NAME}) - length({EXT})) AS stem FROM files WHERE NOT starts_with(relative, 'tests/fixtures/')),
k AS (SELECT s.*, l, r, true AS is_left, substr(stem, length(l) + 1) AS shared FROM s JOIN p ON starts_with(stem, l) UNION ALL SELECT s.*, l, r, false, substr(stem, length(r) + 1) FROM s JOIN p ON starts_with(stem, r))
SELECT dir, ext, l AS left_prefix, r AS right_prefix, shared, max(relative) FILTER (is_left) AS left_file, max(relative) FILTER (NOT is_left) AS right_file FROM k WHERE regexp_matches(shared, '^[A-Z]') GROUP BY ALL HAVING count(*) FILTER (is_left) > 0 AND count(*) FILTER (NOT is_left) > 0"""


@_query(_SIBLING, files=V.FILES)
def sibling_pairs(spark, files):
    return heuristics.sibling_pairs(files)


# ---- findings ----


@_query("SELECT count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM issues", issues=V.ISSUES)
def severity_tally(spark, issues):
    return findings.tally(issues)


@_query(f"SELECT coalesce(bool_or({RANK} >= 3 AND {SOURCE} = 'scanner'), false) AS failed, count(*) FILTER ({RANK} >= 3 AND {SOURCE} = 'scanner') AS n_hits FROM issues", issues=V.ISSUES)
def gate_decision(spark, issues):
    return findings.gate(issues, "HIGH", scanner_only=True)


_KEY = "'tidewrack|' || lower(trim(category)) || '|' || lower(trim(replace(file, chr(92), '/'))) || '|' || trim(regexp_replace(title, '\\s+', ' ', 'g'))"


@_query(f"h AS (SELECT ord, sha1(unhex('{C.NAMESPACE}') || encode({_KEY})) AS h FROM issues) SELECT ord, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(h, 17, 1))::INT + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS stable_id FROM h", issues=V.ISSUES)
def stable_ids(spark, issues):
    return issues.select("ord", C.stable_id(F.col("category"), F.col("file"), F.col("title"), "tidewrack").alias("stable_id"))


@_query(f"SELECT {SOURCE} AS source, count(*) AS n, count(CASE WHEN source IS NOT NULL OR {SOURCE} <> 'llm' THEN 1 END) AS stamped FROM issues GROUP BY 1", issues=V.ISSUES)
def infer_source_counts(spark, issues):
    s = C.infer_source(F.col("source"), F.col("category"))
    return issues.groupBy(s.alias("s")).agg(F.count("*").alias("n"), F.count(C.stamp_source(F.col("source"), F.col("category"))).alias("stamped")).withColumnRenamed("s", "source")


@_query("SELECT ord, file, title, severity FROM issues QUALIFY row_number() OVER (PARTITION BY file, title ORDER BY ord) = 1", issues=V.ISSUES)
def merge_keep_first(spark, issues):
    return findings.merge_reports(issues).select("ord", "file", "title", "severity")


@_query(f"k AS (SELECT *, {NORM.format('file')} AS kf, lower(trim(category)) AS kc, coalesce(nullif(lower(trim(cwe)), ''), lower(trim(regexp_replace(title, '\\s+', ' ', 'g')))) AS ki, {RANK} AS rk FROM issues) SELECT min(ord) AS ord, arg_max(file, rk::BIGINT * 1000000000000 - ord) AS file, arg_max(title, rk::BIGINT * 1000000000000 - ord) AS title, arg_max(severity, rk::BIGINT * 1000000000000 - ord) AS severity, CASE WHEN count(*) > 1 THEN count(*) END AS clusteredCount FROM k GROUP BY kf, kc, ki", issues=V.ISSUES)
def cluster_near_dupes(spark, issues):
    return findings.cluster(issues).select("ord", "file", "title", "severity", "clusteredCount")


_ADV = r"upper(regexp_extract(title, '(?i)\b(CVE-[0-9]{4}-[0-9]{4,}|GHSA(?:-[0-9a-z]{4}){3})\b', 1))"
_PKG = r"lower(regexp_extract(title, '(?i)\b(?:in|for)\s+([A-Za-z0-9_.@/+-]+)', 1))"
_SCA = V.ISSUES.replace("(o_orderkey) % 12 WHEN 0 THEN 'sec.injection' WHEN 1 THEN 'heuristic.mega_file'", "(o_orderkey) % 12 WHEN 0 THEN 'trivy' WHEN 1 THEN 'osv'")


@_query(f"a AS (SELECT *, {_ADV} AS adv, {_PKG} AS pkg FROM issues), s AS (SELECT min(ord) AS ord, arg_min(title, CASE WHEN category = 'osv' THEN 0 ELSE 1000000000000 END + ord) AS title, arg_min(category, CASE WHEN category = 'osv' THEN 0 ELSE 1000000000000 END + ord) AS category, 1 AS lane FROM a WHERE adv <> '' AND category IN ('osv', 'trivy') GROUP BY adv, pkg) SELECT ord, title, category, 0 AS lane FROM a WHERE NOT (adv <> '' AND category IN ('osv', 'trivy')) UNION ALL SELECT * FROM s", issues=_SCA)
def sca_dedupe(spark, issues):
    return findings.sca_dedupe(issues).select("ord", "title", "category", "lane")


@_query(f"SELECT ord, CASE WHEN priority = 'P1' AND (starts_with(category, 'heuristic.') OR NOT {SECCAT}) THEN 'P2' ELSE priority END AS priority FROM issues", issues=V.ISSUES)
def band_coercion(spark, issues):
    return findings.coerce_bands(issues).select("ord", "priority")


_TXT = "category || chr(10) || title || chr(10) || explanation || chr(10) || codeExample || chr(10) || recommendedFix"


def _rx(e: str, p: str) -> str:
    return f"regexp_matches({e}, '{p}')"


@_query(
    f"x AS (SELECT *, {_TXT} AS txt FROM issues), t AS (SELECT *, CASE WHEN {_rx('txt', findings.INJECTION)} AND {_rx('txt', findings.SUBPROCESS)} AND NOT {_rx('txt', r'shell\s*=\s*True')} AND ({_rx('txt', findings.ARGV)} OR {_rx('txt', r'shell\s*=\s*False')}) THEN 'subprocess_list_not_injection'"
    f" WHEN {_rx('file', findings.FIXTURE_PATH)} AND {_rx('txt', findings.SECRET)} THEN 'test_fixture_secrets' WHEN {_rx('file', findings.EXAMPLE_PATH)} AND {_rx('txt', findings.INTENTIONAL)} THEN 'intentional_vuln_example' END AS tag FROM x)"
    " SELECT ord, CASE WHEN tag IS NOT NULL THEN 'LOW' ELSE severity END AS severity, CASE WHEN tag IS NOT NULL AND severity <> 'LOW' THEN '[calibrated: ' || tag || '] ' || explanation ELSE explanation END AS explanation FROM t",
    issues=V.ISSUES,
)
def fp_calibration(spark, issues):
    return findings.calibrate(issues).select("ord", "severity", "explanation")


@_query(
    f"f AS (SELECT {NORM.format('file')} AS ff, lower(trim(category)) AS fc FROM feedback WHERE reason = 'false_positive'), pairs AS (SELECT DISTINCT ff, fc FROM f WHERE ff <> '' AND fc <> ''), hot AS (SELECT fc FROM f WHERE fc <> '' GROUP BY fc HAVING count(*) >= 2)"
    f" SELECT ord, CASE WHEN {SOURCE} <> 'scanner' AND (EXISTS (SELECT 1 FROM pairs WHERE ff = {NORM.format('file')} AND fc = lower(category)) OR lower(category) IN (SELECT fc FROM hot)) THEN 'LOW' ELSE severity END AS severity FROM issues",
    issues=V.ISSUES, feedback=V.FEEDBACK,
)
def feedback_calibration(spark, issues, feedback):
    return findings.calibrate_by_feedback(issues, feedback).select("ord", "severity")


@_query("SELECT lower(trim(category)) AS hot, count(*) AS n FROM feedback WHERE reason = 'false_positive' AND trim(category) <> '' GROUP BY 1 HAVING count(*) >= 2", feedback=V.FEEDBACK)
def feedback_hot_categories(spark, feedback):
    return findings.hot_categories(feedback)


_SUP = V.ISSUES.replace("SELECT o_orderkey AS ord", "SELECT concat('ID-', CAST(o_orderkey AS VARCHAR(20))) AS stable_id, o_orderkey AS ord")


@_query(f"SELECT i.ord, min(r.ord) AS rule_ord, arg_min(r.reason, r.ord) AS s_reason, CASE WHEN min(r.ord) IS NOT NULL THEN 'ignore_file' END AS mechanism FROM issues i LEFT JOIN rules r ON (r.expires IS NULL OR DATE '2026-01-01' <= r.expires) AND (lower(r.stable_id) = lower(i.stable_id) OR ({NORM.format('r.file')} = {NORM.format('i.file')} AND lower(trim(r.category)) = lower(trim(i.category)))) GROUP BY i.ord", issues=_SUP, rules=V.RULES)
def suppress_rules(spark, issues, rules):
    return findings.suppress_by_rules(issues, rules, "2026-01-01").select("ord", "rule_ord", "s_reason", "mechanism")


_MARKED = "SELECT concat('f', CAST(doc_id AS VARCHAR(20))) AS relative, concat(replace(replace(replace(coalesce(text, ''), ' the ', concat(chr(10), '# tidewrack:disable', chr(10))), ' of ', concat(chr(10), '// tidewrack:enable', chr(10))), ' is ', concat(chr(10), '# tidewrack:disable-next-line x', chr(10)))) AS content FROM {documents}"


@_query(
    r"l AS (SELECT relative, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files), k AS (SELECT *, CASE WHEN regexp_matches(trim(t), '(?i)^(#|//)\s*tidewrack:enable\s*$') THEN 'on' WHEN regexp_matches(trim(t), '(?i)^(#|//)\s*tidewrack:disable(\s+\S+)?\s*$') THEN 'off' WHEN regexp_matches(trim(t), '(?i)^(#|//)\s*tidewrack:disable-next-line(\s+\S+)?\s*$') THEN 'next' END AS mark FROM l),"
    " s AS (SELECT *, last_value(CASE WHEN mark IN ('on', 'off') THEN mark END IGNORE NULLS) OVER w AS st, lag(mark) OVER w AS prev, max(line) OVER (PARTITION BY relative) AS n, last_value(t) OVER (PARTITION BY relative ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lt FROM k WINDOW w AS (PARTITION BY relative ORDER BY line)) SELECT relative, line::INT AS line FROM s WHERE ((mark IS NULL AND st = 'off') OR prev = 'next') AND NOT (line = n AND lt = '')",
    files=_MARKED,
)
def disable_lines(spark, files):
    return findings.disabled_lines(files)


@_query(f"SELECT ord, CASE WHEN severity = 'CRITICAL' AND {SOURCE} <> 'scanner' AND locationVerified IS FALSE THEN 'HIGH' WHEN severity = 'HIGH' AND {SOURCE} <> 'scanner' AND locationVerified IS FALSE THEN 'MEDIUM' ELSE severity END AS severity FROM issues", issues=V.ISSUES)
def consistency(spark, issues):
    return findings.consistency(issues, include_high=True).select("ord", "severity")


@_query("n AS (SELECT * FROM issues WHERE ord % 3 = 0), p AS (SELECT * FROM issues WHERE ord % 3 <> 0) SELECT ord, 0 AS lane FROM p UNION ALL (SELECT ord, 1 FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.file = n.file AND p.line = n.line AND p.title = n.title) QUALIFY row_number() OVER (PARTITION BY file, line, title ORDER BY ord) = 1)", issues=V.ISSUES)
def merge_reused(spark, issues):
    return findings.reuse(issues.where("ord % 3 <> 0"), issues.where("ord % 3 = 0")).select("ord", "lane")


@_query("SELECT v AS violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN severity IN ('CRITICAL', 'HIGH') AND trim(impact) = '' THEN 'impact' END, CASE WHEN severity IN ('CRITICAL', 'HIGH') AND trim(codeExample) = '' THEN 'codeExample' END], lambda x: x IS NOT NULL)) AS v FROM issues) GROUP BY 1", issues=V.ISSUES)
def schema_violations(spark, issues):
    return findings.violations(issues).select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


# ---- snapshots, routing, budgets ----


@_query("SELECT path, CASE WHEN o.sha256 IS NULL THEN 'added' WHEN n.sha256 IS NULL THEN 'deleted' WHEN o.sha256 <> n.sha256 THEN 'changed' ELSE 'unchanged' END AS status FROM old o FULL JOIN new n USING (path)", old=V.OLD, new=V.NEW)
def fingerprint_diff(spark, old, new):
    return planning.fingerprint_diff(old, new)


_OLD_FILES = "SELECT relative AS path, CASE WHEN ord % 9 = 0 THEN 'x' ELSE CAST(size AS VARCHAR(20)) END AS sha256 FROM (" + V.FILES + ") f WHERE ord % 13 <> 5"
_DELTA = "d AS (SELECT n.relative FROM files n LEFT JOIN old o ON n.relative = o.path WHERE o.path IS NULL OR o.sha256 <> CAST(n.size AS VARCHAR))"


def _pack(mode):
    def run(files, old):
        new = files.select(F.col("relative").alias("path"), F.col("size").cast("string").alias("sha256"))
        diff = planning.fingerprint_diff(old.groupBy("path").agg(F.max("sha256").alias("sha256")), new.groupBy("path").agg(F.max("sha256").alias("sha256")))
        return planning.adaptive_pack(planning.inventory(files, 0), diff, mode).select("relative", "priority_band").distinct()

    return run


_GROUPED = "o AS (SELECT path, max(sha256) AS s FROM old GROUP BY 1), n AS (SELECT relative AS path, max(CAST(size AS VARCHAR)) AS s FROM files GROUP BY 1), d AS (SELECT n.path FROM n LEFT JOIN o USING (path) WHERE o.s IS NULL OR o.s <> n.s)"


@_query(f"{_GROUPED} SELECT DISTINCT relative, {BAND}::INT AS priority_band FROM files WHERE NOT {IGNORED} AND size <= 200000 AND (relative IN (SELECT path FROM d) OR {BAND} <= 1)", files=V.FILES, old=_OLD_FILES)
def adaptive_pack_auto(spark, files, old):
    return _pack("auto")(files, old)


@_query(f"{_GROUPED} SELECT DISTINCT relative, {BAND}::INT AS priority_band FROM files WHERE NOT {IGNORED} AND size <= 200000 AND relative IN (SELECT path FROM d)", files=V.FILES, old=_OLD_FILES)
def adaptive_pack_changed(spark, files, old):
    return _pack("changed")(files, old)


_ALL = f"SELECT DISTINCT relative, {BAND}::INT AS priority_band FROM files WHERE NOT {IGNORED} AND size <= 200000"


@_query(_ALL, files=V.FILES, old=_OLD_FILES)
def adaptive_pack_full(spark, files, old):
    return _pack("full")(files, old)


_SAME = "SELECT relative AS path, CAST(size AS VARCHAR(20)) AS sha256 FROM (" + V.FILES + ") f"


@_query(_ALL, files=V.FILES, old=_SAME)
def adaptive_pack_unchanged(spark, files, old):
    """Mode auto where nothing has changed: everything."""
    return _pack("auto")(files, old)


@_query(f"h AS (SELECT ltrim(replace(file, chr(92), '/'), './') AS f FROM issues WHERE {SOURCE} = 'scanner' AND {RANK} >= 3) SELECT count(*) > 0 AS invoke, count(*) = 0 AS bypassed, count(*) AS n_hits, least(count(DISTINCT f), 4) AS n_files, count(DISTINCT f) > 4 AS truncated, CASE WHEN count(*) = 0 THEN 'no hit at the floor: bypassed' WHEN count(DISTINCT f) > 4 THEN 'pack cut to 4 of ' || count(DISTINCT f) ELSE '' END AS note FROM h", issues=V.ISSUES, files=V.FILES)
def triage_decision(spark, issues, files):
    return planning.triage_plan(issues, files, max_files=4)[1]


@_query(f"SELECT ltrim(replace(file, chr(92), '/'), './') AS pack_file, min(ord) AS ord FROM issues WHERE {SOURCE} = 'scanner' AND {RANK} >= 3 GROUP BY 1 ORDER BY 2 LIMIT 4", issues=V.ISSUES)
def triage_pack(spark, issues):
    return planning.triage(issues, max_files=4)


_GRP = "SELECT doc_id AS ord, coalesce(source, '') AS grp, n_chars AS size, concat('f', CAST(doc_id AS VARCHAR(20))) AS relative FROM {documents}"


@_query("RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ord) AS k FROM files), g AS (SELECT grp, ord, size, k, CASE WHEN size <= 100000 THEN size ELSE 0 END AS used, size <= 100000 AS got FROM r WHERE k = 1 UNION ALL SELECT r.grp, r.ord, r.size, r.k, CASE WHEN g.used + r.size <= 100000 THEN g.used + r.size ELSE g.used END, g.used + r.size <= 100000 FROM r JOIN g ON r.grp = g.grp AND r.k = g.k + 1) SELECT grp, ord, size FROM g WHERE got", files=_GRP)
def deep_pack_budget(spark, files):
    return planning.budget_pack(files, 100_000).select("grp", "ord", "size")


ORACLES["deep_pack_budget"] = ORACLES["deep_pack_budget"].replace("WITH ", "WITH RECURSIVE ", 1).replace(", RECURSIVE r AS", ", r AS")


@_query("r AS (SELECT llm_seconds FROM runs WHERE outcome = 'ok' AND llm_seconds IS NOT NULL ORDER BY id DESC LIMIT 20) SELECT greatest(120.0::DOUBLE, least(3600.0::DOUBLE, quantile_disc(llm_seconds, 0.95) * 1.3::DOUBLE)) AS timeout FROM r", runs=V.RUNS)
def timeout_p95(spark, runs):
    return planning.timeout_p95(runs)


@_query("SELECT relative, row_number() OVER (ORDER BY relative, ord) AS nth FROM files", files=V.FILES)
def global_numbers(spark, files):
    """Every file's place in the order of all paths."""
    return ordered.numbered(files.select("relative", "ord"), F.col("relative"), F.col("ord"), name="nth").select("relative", (F.col("nth") + 1).alias("nth"))


_ONE = _GRP.replace("coalesce(source, '') AS grp", "'all' AS grp")


@_query(files=_ONE)
def deep_pack_one_group(spark, files):
    """All files as one group, packed in rounds over range partitions; no task sees the group."""
    return planning.budget_pack(files, 100_000, few=50).select("grp", "ord", "size")


ORACLES["deep_pack_one_group"] = ORACLES["deep_pack_budget"].replace("coalesce(source, '') AS grp", "'all' AS grp")


# ---- scores ----

_MATRIX = ", ".join(f"({k}, '{i}', {str(full).lower()}, '{pack}')" for k, (_, i, full, pack) in enumerate(score.MATRIX))
_THEME = f"CASE {' '.join(f"WHEN trim(category) = '{a}' THEN '{b}'" for a, b in (C.HEURISTIC_THEMES | C.ALIASES).items())} WHEN trim(category) IN {_in(score.MAPPED)} THEN trim(category) END"
_COV = (
    f"m(ord, id, full_audit, pack) AS (VALUES {_MATRIX}), h AS (SELECT {_THEME} AS theme, lower(title || ' ' || explanation || ' ' || category || ' ' || impact || ' ' || recommendedFix) AS hay, lower(category || ' ' || title || ' ' || explanation) AS hay3 FROM issues),"
    " seen AS (SELECT DISTINCT id FROM m JOIN h ON theme = id OR contains(hay, id) OR contains(hay, string_split(id, '.')[-1])),"
    r" na AS (SELECT regexp_extract(note, '(?i)^coverage:([^\s:]+)\s*:\s*N/A\s*[—-]\s*(.+)$', 1) AS id, arg_max(trim(regexp_extract(note, '(?i)^coverage:([^\s:]+)\s*:\s*N/A\s*[—-]\s*(.+)$', 2)), ord) AS reason FROM notes GROUP BY 1),"
    f" lz AS (SELECT id, reason, ({_has('lower(reason)', C.ALWAYS_LAZY)} OR ({_has('lower(reason)', C.SOFT_LAZY)} AND NOT {_has('lower(reason)', C.CONCRETE)})) AS lazy FROM na WHERE id <> ''),"
    " cov AS (SELECT m.ord, m.id, m.pack, CASE WHEN seen.id IS NOT NULL THEN 'covered' WHEN lz.id IS NOT NULL AND NOT lazy THEN 'na' ELSE 'missed' END AS status, CASE WHEN seen.id IS NULL THEN reason END AS reason, coalesce(seen.id IS NULL AND lazy, false) AS invalid FROM m LEFT JOIN seen ON m.id = seen.id LEFT JOIN lz ON m.id = lz.id)"
)


def _cov(spark, issues, notes):
    return score.evaluate_coverage(score.matrix(spark).select("ord", "id"), issues, notes)


@_query(f"{_COV} SELECT id, status, reason, invalid FROM cov", issues=V.ISSUES, notes=V.NOTES)
def coverage_eval(spark, issues, notes):
    return _cov(spark, issues, notes).select("id", "status", "reason", "invalid")


#: Gaps of many passes: valid, lazy and missed notes, and others.
_GAPS = f"""SELECT o_orderkey AS ord, concat({V.pick('o_custkey', 'coverage:sec.xxe: N/A - no xml parser in part ', 'coverage:arch.i18n: N/A - not reviewed ', 'coverage:rel.concurrency: N/A - could be improved, pass ', 'scanner:osv missing: install it by hand ', 'coverage:arch.pwa: missed ', 'note coverage:sec.jwt_tokens: missed here ', 'coverage:arch.a11y: N/A - no user interface in part ')}, CAST(o_custkey % 40 AS VARCHAR(20))) AS note FROM {{orders}}"""
_LAZY = f"({_has('lower(reason)', C.ALWAYS_LAZY)} OR ({_has('lower(reason)', C.SOFT_LAZY)} AND NOT {_has('lower(reason)', C.CONCRETE)}))"
_NA = r"regexp_extract(note, '(?i)^coverage:([^\s:]+)\s*:\s*N/A\s*[—-]\s*(.+)$', {})"


@_query(
    f"{_COV}, g AS (SELECT ord, note, {_NA.format(1)} AS id, trim({_NA.format(2)}) AS reason FROM notes), l AS (SELECT *, id <> '' AND {_LAZY} AS lazy FROM g),"
    " t AS (SELECT ord, lazy, CASE WHEN lazy THEN 'coverage:' || id || ': missed — lazy N/A rejected (' || reason || ')' ELSE note END AS gap FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY gap ORDER BY ord) AS nth FROM t),"
    " kept AS (SELECT 0 AS lane, ord, gap FROM k WHERE NOT lazy OR nth = 1) SELECT * FROM kept UNION ALL SELECT 1, ord, 'coverage:' || id || ': missed — neither issue nor N/A' FROM cov WHERE status = 'missed' AND NOT EXISTS (SELECT 1 FROM kept WHERE contains(gap, 'coverage:' || cov.id || ': missed'))",
    issues=V.ISSUES, notes=_GAPS,
)
def gap_rewrite(spark, issues, notes):
    return score.rewrite_gaps(_cov(spark, issues, notes), notes.withColumnRenamed("note", "gap"))


@_query(f"{_COV} SELECT cov.id, cov.pack, cov.status, (SELECT count(*) FROM h WHERE theme = cov.id OR contains(hay3, cov.id)) AS n_findings, CASE WHEN cov.status = 'na' THEN cov.reason ELSE '' END AS notes FROM cov WHERE cov.pack IN ('core', 'extended')", issues=V.ISSUES, notes=V.NOTES)
def theme_breakdown(spark, issues, notes):
    return score.theme_breakdown(score.matrix(spark), _cov(spark, issues, notes), issues, full=True).drop("ord")


_THEMES = f"{_COV} SELECT cov.id, cov.pack, cov.status, (SELECT count(*) FROM h WHERE theme = cov.id OR contains(hay3, cov.id)) AS n_findings, CASE WHEN cov.status = 'na' THEN cov.reason ELSE '' END AS notes FROM cov WHERE "


@_query(_THEMES + "cov.pack = 'core' AND starts_with(cov.id, 'sec.')", issues=V.ISSUES, notes=V.NOTES)
def theme_breakdown_sentinel(spark, issues, notes):
    return score.theme_breakdown(score.matrix(spark), _cov(spark, issues, notes), issues, mode="sentinel").drop("ord")


@_query(_THEMES + "cov.pack IN ('core', 'extended') AND starts_with(cov.id, 'arch.')", issues=V.ISSUES, notes=V.NOTES)
def theme_breakdown_architecture(spark, issues, notes):
    return score.theme_breakdown(score.matrix(spark), _cov(spark, issues, notes), issues, full=True, mode="architecture").drop("ord")


_SECI, _RELI, _ARCI = f"(priority = 'P1' OR {SECCAT})", "(priority = 'P2' OR starts_with(lower(category), 'rel.'))", "(priority = 'P3' OR starts_with(lower(category), 'arch.') OR starts_with(lower(category), 'heuristic.'))"


def _pen(p: str) -> str:
    return f"(least(60, 20 * count(*) FILTER ({p} AND severity = 'CRITICAL')) + least(50, 10 * count(*) FILTER ({p} AND severity = 'HIGH')))"


def _off(prefix: str) -> str:
    return f"(SELECT least(40, 4 * count(*) FILTER (status = 'missed')) + least(30, 3 * count(*) FILTER (invalid)) FROM cov WHERE starts_with(id, '{prefix}'))"


@_query(
    f"{_COV}, pen AS (SELECT {_pen(_SECI)} AS s, {_pen(_RELI)} AS r FROM issues), b AS (SELECT greatest(0, least(100, 92 - {_off('sec.')} + 5 - s))::INT AS security, greatest(0, least(100, 88 - {_off('rel.')} - r))::INT AS reliability FROM pen)"
    " SELECT greatest(0, least(100, least(92, 88, security, reliability) - (SELECT least(40, 4 * count(*) FILTER (status = 'missed')) + least(30, 3 * count(*) FILTER (invalid)) FROM cov WHERE starts_with(id, 'sec.') OR starts_with(id, 'rel.'))))::INT AS gate, security, reliability, CAST(NULL AS INT) AS architecture FROM b",
    issues=V.ISSUES, notes=V.NOTES,
)
def audit_metrics(spark, issues, notes):
    passes = spark.createDataFrame([("p1", 92), ("reliability", 88)], "name string, confidence int")
    runs = spark.createDataFrame([("gitleaks", "ran"), ("osv", "ran")], "tool string, status string")
    out = score.audit_metrics(passes, _cov(spark, issues, notes), runs, issues)
    return out.select(*[F.col(c).cast("int").alias(c) for c in out.columns])


@_query(
    f"{_COV}, pen AS (SELECT {_pen(_SECI)} AS s, {_pen(_RELI)} AS r, {_pen(_ARCI)} AS a FROM issues), b AS (SELECT greatest(0, least(100, 92 - {_off('sec.')} - s))::INT AS security, greatest(0, least(100, 88 - {_off('rel.')} - r))::INT AS reliability, greatest(0, least(100, 85 - {_off('arch.')} - a))::INT AS architecture FROM pen)"
    " SELECT greatest(0, least(100, least(92, 88, 85, security, reliability, architecture) - (SELECT least(40, 4 * count(*) FILTER (status = 'missed')) + least(30, 3 * count(*) FILTER (invalid)) FROM cov WHERE starts_with(id, 'sec.') OR starts_with(id, 'rel.') OR starts_with(id, 'arch.'))))::INT AS gate, security, reliability, architecture FROM b",
    issues=V.ISSUES, notes=V.NOTES,
)
def audit_metrics_architecture(spark, issues, notes):
    """With the architecture pass, and a scanner that was skipped."""
    passes = spark.createDataFrame([("p1", 92), ("p2", 88), ("p3", 85)], "name string, confidence int")
    runs = spark.createDataFrame([("gitleaks", "ran"), ("osv", "skipped")], "tool string, status string")
    out = score.audit_metrics(passes, _cov(spark, issues, notes), runs, issues)
    return out.select(*[F.col(c).cast("int").alias(c) for c in out.columns])


_EX = "trim(codeExample) <> ''"
_CH = "severity IN ('CRITICAL', 'HIGH')"


@_query(f"SELECT count(*) AS total_issues, count(*) FILTER ({_CH}) AS critical_high, count(*) FILTER ({_CH} AND {_EX}) AS critical_high_with_example, count(*) FILTER (NOT {_CH}) AS medium_low, count(*) FILTER (NOT {_CH} AND {_EX}) AS medium_low_with_example, count(*) FILTER ({_EX}) AS with_example, count(*) FILTER (trim(impact) <> '') AS with_impact, count(*) FILTER (source = 'scanner') AS scanner_sourced, count(*) FILTER (source = 'llm') AS llm_sourced, count(*) FILTER (source = 'heuristic') AS heuristic_sourced, count(*) FILTER (locationVerified) AS location_verified, count(*) FILTER (NOT locationVerified) AS location_unverified, count(*) FILTER ({_EX}) / count(*)::DOUBLE AS fix_readiness FROM issues", issues=V.ISSUES)
def actionability(spark, issues):
    return score.actionability(issues)


# ---- anchors, usage, search ----

_QUOTES = "SELECT doc_id AS ord, concat('./f', CAST(doc_id AS VARCHAR(20))) AS file, CAST(doc_id % 12 + 1 AS INT) AS line, substr(text, CAST(1 + (doc_id * 7) % 60 AS INT), 6) AS quote FROM {documents} WHERE text IS NOT NULL"
_CONTENT = "SELECT concat('f', CAST(doc_id AS VARCHAR(20))) AS relative, text AS content FROM {documents} WHERE text IS NOT NULL"


_BLANKS = " || ".join(f"chr({k})" for k in (32, 9, 10, 13, 11, 12, 28, 29, 30, 31, 133, 160, 8232, 8233, 12288))


@_query(
    f"q AS (SELECT ord, substr(file, 3) AS relative, line AS hint, trim(quote, {_BLANKS}) AS quote FROM issues WHERE trim(quote, {_BLANKS}) <> ''), l AS (SELECT relative, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS ln FROM files),"
    " c AS (SELECT ord, relative, ln, strpos(t, quote) AS col, abs(ln - hint) AS off FROM q JOIN l USING (relative) WHERE NOT contains(quote, chr(10)) AND strpos(t, quote) > 0),"
    " m AS (SELECT ord, relative, length(quote) - length(replace(quote, chr(10), '')) AS n, string_split(content, quote)[1] AS head FROM q JOIN files USING (relative) WHERE contains(quote, chr(10)) AND contains(content, quote))"
    " SELECT ord, relative, arg_min(ln, off * 1000000 + ln)::INT AS start_line, arg_min(ln, off * 1000000 + ln)::INT AS end_line, arg_min(col, off * 1000000 + ln)::INT AS start_column FROM c GROUP BY ord, relative"
    " UNION ALL SELECT ord, relative, (length(head) - length(replace(head, chr(10), '')) + 1)::INT, (length(head) - length(replace(head, chr(10), '')) + 1 + n)::INT, CAST(NULL AS INT) FROM m",
    issues=_QUOTES, files=_CONTENT,
)
def anchor_nearest(spark, issues, files):
    return anchors.nearest(issues, files)


_TERMS = ["the", "tion", "der", "que"]


@_query(
    f"d AS (SELECT relative AS path, list_filter(string_split_regex(lower(relative || ' ' || content), '[^a-z0-9]+'), lambda x: x <> '') AS ts FROM files WHERE trim(content) <> ''), q AS (SELECT unnest([{', '.join(repr(t) for t in _TERMS)}]) AS term), tf AS (SELECT path, term, len(list_filter(ts, lambda x: x = term)) AS tf, len(ts) AS len FROM d CROSS JOIN q), n AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY 1), a AS (SELECT count(*) AS n_docs, avg(len(ts)) AS av FROM d)"
    " SELECT path, round(-sum(greatest(ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / av))), 6) AS score FROM tf JOIN n USING (term) CROSS JOIN a WHERE tf > 0 GROUP BY 1 ORDER BY 2, 1 LIMIT 20",
    files=_CONTENT,
)
def bm25_topk(spark, files):
    p, d = search.build(files, cap=None, only=_TERMS)
    return search.query(p, d, [[t] for t in _TERMS], 20).select("path", F.round("score", 6).alias("score"))


@_query(ORACLES["bm25_topk"], files=_CONTENT)
def bm25_pruned(spark, files):
    """bm25_topk's answer from the blocks of files whose bounds reach the best scores."""
    p, d = (cut(x, "searched") for x in search.build(files, cap=None, only=_TERMS))
    blocks = 1 << max(4, (d.count() // 64).bit_length())
    out, _ = search.query_pruned(p, d, cut(search.bounds(p, d, blocks), "block_bounds"), blocks, _TERMS, 20)
    return out.select("path", F.round("score", 6).alias("score"))


#: Two snapshots of the files: some are new in the second, some gone, some changed.
_OLD_FILES = _CONTENT + " AND doc_id % 7 <> 1"
_NEW_FILES = _CONTENT.replace("text AS content", "CASE WHEN doc_id % 5 = 0 THEN concat(text, ' tion changed words') ELSE text END AS content") + " AND doc_id % 11 <> 2"


def _kept_up(spark, old, new) -> segments.SegmentIndex:
    """An index of the first snapshot, brought to the second by their fingerprint difference, and its two segments merged."""
    prints = lambda d: d.select(F.col("relative").alias("path"), C.file_hash(F.col("content")).alias("sha256"))
    index = segments.SegmentIndex(spark, f"{shared_dir(spark)}/tidewrack/index-{uuid.uuid4().hex}", fan=2)
    nothing = old.limit(0)
    for before, now in ((nothing, old), (old, new)):
        index.apply(now, planning.fingerprint_diff(prints(before), prints(now)), cap=None)
    # the folder is this query's own: nobody reads its older versions
    index.sweep()
    return index


@_query("t AS (SELECT relative, unnest(string_split_regex(lower(relative || ' ' || content), '[^a-z0-9]+')) AS term FROM new WHERE trim(content) <> '') SELECT term, count(DISTINCT relative) AS n_files, count(*) AS n FROM t WHERE term <> '' GROUP BY term", old=_OLD_FILES, new=_NEW_FILES)
def index_upkeep_terms(spark, old, new):
    """Every term of the kept-up index, as a fresh one would have it."""
    return _kept_up(spark, old, new).postings().groupBy("term").agg(F.count("*").alias("n_files"), F.sum("tf").alias("n"))


@_query(ORACLES["bm25_topk"].removeprefix(f"WITH files AS ({re.sub(r'{(\w+)}', r'\1', _CONTENT)}), ").replace("FROM files", "FROM new"), old=_OLD_FILES, new=_NEW_FILES)
def index_upkeep_topk(spark, old, new):
    """The best files for some terms, from their buckets alone."""
    return _kept_up(spark, old, new).query([[t] for t in _TERMS], 20).select("path", F.round("score", 6).alias("score"))


@_query(files=_CONTENT)
def porter_bm25(spark, files):
    """Stemmed terms and a phrase; tests hold the search against another engine's."""
    terms = [[search.porter(w) for w in t] for t in (["the"], ["ation"], ["the", "and"], ["and", "the"])]
    p, d = search.build(files, stem=True, cap=None, only=sorted({w for t in terms for w in t}))
    return search.query(p, d, terms, 20).select("path", F.round("score", 6).alias("score"))


_PACKAGES = "SELECT * FROM (VALUES (1, 'the', 'osv'), (2, 'left-pad', 'trivy'), (3, 'der', 'osv'), (4, 'no_such_pkg', 'osv'), (5, 'the', 'semgrep'), (6, CAST(NULL AS VARCHAR(40)), 'osv'), (7, 'que', 'trivy'), (8, 'zz-top', 'trivy'), (9, ' una ', 'osv')) AS t(ord, packageName, category)"
_SOURCES = "SELECT concat(CASE WHEN doc_id % 5 = 0 THEN 'dist/f' ELSE 'src/f' END, CAST(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 3 = 0 THEN '.png' ELSE '.py' END) AS relative, concat(coalesce(text, ''), CASE WHEN doc_id = 7 THEN concat(chr(10), 'import zz_top') ELSE '' END) AS content FROM {documents}"


@_query(
    r"f AS (SELECT content FROM files WHERE starts_with(relative, 'src/') AND ends_with(relative, '.py')), n AS (SELECT ord, trim(packageName) AS p, category IN ('osv', 'trivy') AND coalesce(trim(packageName), '') <> '' AS wanted FROM issues)"
    r" SELECT ord, CASE WHEN wanted THEN CASE WHEN EXISTS (SELECT 1 FROM f WHERE regexp_matches(content, '\b(import|from)\s+' || replace(p, '-', '_') || '\b|\b' || p || '\b')) THEN 'referenced_in_source' ELSE 'no_reference_found' END END AS usageHint FROM n",
    issues=_PACKAGES, files=_SOURCES,
)
def usage_hints(spark, issues, files):
    return anchors.usage_hints(issues, files, max_files=None, most=None).select("ord", "usageHint")


_CODE = "SELECT concat('f', CAST(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 2 = 0 THEN '.ts' ELSE '.go' END) AS relative, replace(replace(coalesce(text, ''), ' the ', concat(chr(10), 'export async function ')), ' of ', concat(chr(10), '  class ')) AS content FROM {documents}"


@_query(
    r"l AS (SELECT relative, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS ln FROM files), s AS (SELECT *, regexp_extract(t, '^\s*(?:export\s+)?(?:async\s+)?(?:function|def|class|fn|func)\s+([A-Za-z_][\p{L}\p{N}_]*)', 1) AS name FROM l)"
    " SELECT relative, CASE WHEN contains(split_part(t, '(', 1), 'class') THEN 'class' ELSE 'function' END AS kind, name, ln::INT AS start_line, ln::INT AS end_line FROM s WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY relative ORDER BY ln) <= 48",
    files=_CODE,
)
def symbols_outline(spark, files):
    return symbols.symbols(files).drop("n_symbols")


# ---- scanner reports, model output, documents ----

_OSV = """SELECT concat('{"results":[{"source":{"path":"lock', CAST(p_partkey % 7 AS VARCHAR(20)), '"},"packages":[{"package":{"name":"pkg', CAST(p_partkey AS VARCHAR(20)), '"},"vulnerabilities":[{"id":"CVE-2024-', CAST(p_partkey AS VARCHAR(20)), '","summary":"', p_type, '"},{"id":"","summary":null}]}]},{"packages":[]}]}') AS json, p_partkey AS k, p_type FROM {part}"""


@_query(
    "a AS (SELECT 'lock' || (k % 7) AS file, 'pkg' || k AS packageName, 'CVE-2024-' || k AS advisoryId, p_type AS explanation FROM raw UNION ALL SELECT 'lock' || (k % 7), 'pkg' || k, 'CVE', 'CVE' FROM raw) SELECT 'HIGH' AS severity, 'P1' AS priority, 'osv' AS category, file, 1 AS line, advisoryId || ' in ' || packageName AS title, explanation, packageName, advisoryId FROM a",
    raw=_OSV,
)
def osv_explode(spark, raw):
    return scanners.osv(raw).drop("installedVersion", "fixedVersion")


_TRIVY = """SELECT concat('{"Results":[{"Target":"t', CAST(p_partkey AS VARCHAR(20)), '","Vulnerabilities":[{"VulnerabilityID":"CVE-2023-', CAST(p_partkey AS VARCHAR(20)), '","PkgName":"', p_brand, '","Title":"', p_type, '","InstalledVersion":" 1.0 ","FixedVersion":"","Severity":"', CASE p_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN ' Error ' WHEN 2 THEN 'NEGLIGIBLE' WHEN 3 THEN 'moderate' ELSE 'odd' END, '"}],"Misconfigurations":[{"ID":"","AvdID":"AVD-', CAST(p_partkey AS VARCHAR(20)), '","Title":"bad","Description":"","Severity":"low","PrimaryURL":"http://u","CauseMetadata":{"StartLine":', CAST(p_partkey % 9 AS VARCHAR(20)), '}}]},{"Target":"none"}]}') AS json, p_partkey AS k, p_brand, p_type FROM {part}"""


@_query(
    "SELECT CASE k % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'LOW' ELSE 'MEDIUM' END AS severity, 'P1' AS priority, 'trivy' AS category, 't' || k AS file, 1 AS line, 'CVE-2023-' || k || ' in ' || p_brand || ': ' || p_type AS title, p_type AS explanation, p_brand AS packageName, '1.0' AS installedVersion, CAST(NULL AS VARCHAR) AS fixedVersion, 'CVE-2023-' || k AS advisoryId FROM raw"
    " UNION ALL SELECT 'LOW', 'P1', 'trivy', 't' || k, greatest(1, k % 9)::INT, 'AVD-' || k || ': bad', 'bad' || chr(10) || 'http://u', NULL, NULL, NULL, NULL FROM raw",
    raw=_TRIVY,
)
def trivy_explode(spark, raw):
    return scanners.trivy(raw)


_SBOM = """SELECT concat('{"components":[{"name":"n","version":"1","licenses":[{"license":{"id":"MIT-', CAST(p_partkey % 50 AS VARCHAR(20)), '","name":""}},{"expression":"GPL-3.0 OR X', CAST(p_partkey % 3 AS VARCHAR(20)), '"},{"license":{"id":"","name":"named"}}]},{"name":"bare"}]}') AS json, p_partkey AS k FROM {part}"""


@_query("SELECT DISTINCT 'MIT-' || (k % 50) AS license FROM raw UNION SELECT DISTINCT 'GPL-3.0 OR X' || (k % 3) FROM raw UNION SELECT DISTINCT 'named' FROM raw ORDER BY 1 LIMIT 80", raw=_SBOM)
def license_ids(spark, raw):
    return scanners.license_ids(scanners.licenses(raw))


@_query(
    "n AS (SELECT count(*) AS n FROM raw), i AS (SELECT 'MIT-' || (k % 50) AS id FROM raw UNION SELECT 'GPL-3.0 OR X' || (k % 3) FROM raw UNION SELECT 'named' FROM raw)"
    " SELECT 2 * n AS n_components, n AS n_licensed, n AS n_copyleft, (SELECT string_agg(id, ',' ORDER BY id) FROM i) AS license_ids, CASE WHEN n = 0 THEN 'sbom: no document' ELSE '' END AS gap FROM n",
    raw=_SBOM,
)
def supply_chain_block(spark, raw):
    return scanners.supply_chain(raw).withColumn("license_ids", F.array_join("license_ids", ","))


#: Documents with up to 52 licensed components, licence texts, and components without a name or a licence.
_SBOMS = "SELECT p_partkey AS doc, concat('{\"components\":[{\"name\":\"n\",\"version\":\" ', CAST(p_size AS VARCHAR(20)), ' \",\"licenses\":[{\"license\":{\"id\":\"MIT\"}},{\"license\":{}},{\"expression\":\"', p_brand, '\"}]},{\"licenses\":[{\"license\":\"LGPL-2.1\"}]},{\"name\":\"bare\",\"licenses\":[]},{\"name\":\"odd\",\"licenses\":[{\"license\":{\"url\":\"u\"}}]}', repeat(',{\"name\":\"m\",\"licenses\":[{\"expression\":\"X\"}]}', CAST(p_partkey % 50 AS INT)), ']}') AS json, p_brand, p_size, CAST(p_partkey % 50 AS INT) AS more FROM {part}"


@_query(
    "a AS (SELECT doc, 0 AS ord, 'n@' || p_size || ': MIT, ' || p_brand AS note FROM raw UNION ALL SELECT doc, 1, 'package: LGPL-2.1 [copyleft \u2014 review distribution obligations]' FROM raw UNION ALL SELECT doc, 3, 'odd: unknown' FROM raw"
    " UNION ALL SELECT doc, (4 + i)::INT, 'm: X' FROM (SELECT doc, unnest(range(more)) AS i FROM raw)) SELECT doc, ord::INT AS ord, note FROM a",
    deal=True, raw=_SBOMS,
)
def license_notes(spark, raw):
    return scanners.license_notes(raw, cap=None)


_OUTPUT = """SELECT o_orderkey AS k, concat(CASE WHEN o_orderkey % 7 = 0 THEN 'Here it is: ' ELSE '' END, '{"confidence":"72%","findings":[{"', CASE WHEN o_orderkey % 2 = 0 THEN 'title' ELSE 'summary' END, '":" T', CAST(o_orderkey AS VARCHAR(20)), ' ","severity":"', CASE o_orderkey % 6 WHEN 0 THEN 'crit' WHEN 1 THEN 'Warn' WHEN 2 THEN 'p1' WHEN 3 THEN 'very low risk' WHEN 4 THEN 'odd' ELSE '' END, '","line":', CASE o_custkey % 6 WHEN 0 THEN '7' WHEN 1 THEN '"L12"' WHEN 2 THEN 'true' WHEN 3 THEN '3.9' WHEN 4 THEN 'null' ELSE '"none"' END, ',"when":"', CASE o_orderkey % 5 WHEN 0 THEN 'Immediately' WHEN 1 THEN 'soon after' WHEN 2 THEN 'later on' WHEN 3 THEN 'before launch' ELSE '' END, '","path":"f', CAST(o_custkey AS VARCHAR(20)), '.py"},{},{"issue":{"name":"N"}}]}') AS raw, o_custkey AS c FROM {orders}"""


@_query(
    "a AS (SELECT k, 0 AS ord, CASE k % 6 WHEN 0 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'LOW' ELSE 'MEDIUM' END AS severity, CASE c % 6 WHEN 0 THEN 7 WHEN 1 THEN 12 WHEN 3 THEN 3 ELSE 1 END AS line, CASE k % 5 WHEN 0 THEN 'immediately' WHEN 1 THEN 'after launch' WHEN 2 THEN 'if time permits' ELSE 'before launch' END AS fixTiming, 'T' || k AS title, 'f' || c || '.py' AS file FROM raw"
    " UNION ALL SELECT k, 2, 'MEDIUM', 1, 'before launch', 'N', '(unspecified)' FROM raw) SELECT k, ord, severity, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'P1' WHEN severity = 'MEDIUM' THEN 'P2' ELSE 'P3' END AS priority, line, fixTiming, title, title AS explanation, file FROM a",
    deal=True, raw=_OUTPUT,
)
def llm_issue_coercion(spark, raw):
    got = coerce.issues(coerce.reports(coerce.parse(raw)), "k")
    return got.select("k", "ord", "severity", "priority", "line", "fixTiming", "title", "explanation", "file")


@_query("SELECT 72 AS confidence, k % 7 <> 0 AS strict, count(*) AS n, sum(3)::BIGINT AS n_issues FROM raw GROUP BY 2", deal=True, raw=_OUTPUT)
def llm_report_coercion(spark, raw):
    d = coerce.reports(coerce.parse(raw))
    return d.groupBy("confidence", "strict").agg(F.count("*").alias("n"), F.sum(F.size("issues")).alias("n_issues"))


@_query(
    "SELECT ord, CASE WHEN cwe IS NOT NULL THEN cwe ELSE 'tidewrack/' || lower(category) END AS ruleId, CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level, ltrim(file, './') AS uri, line AS start_line, title || ': ' || explanation AS message FROM issues WHERE locationVerified",
    issues=V.ISSUES,
)
def sarif_rows(spark, issues):
    at = lambda path: F.get_json_object("result", path)
    place = "$.locations[0].physicalLocation"
    return sinks.sarif_rows(issues).select("ord", "ruleId", at("$.level").alias("level"), at(f"{place}.artifactLocation.uri").alias("uri"), at(f"{place}.region.startLine").cast("int").alias("start_line"), at("$.message.text").alias("message"))


@_query("SELECT CAST(ord AS VARCHAR) AS path, severity, title, file, line, category, impact, recommendedFix, explanation, CASE WHEN trim(codeExample) = '' THEN '' ELSE codeExample END AS codeExample FROM issues", issues=V.ISSUES)
def markdown_roundtrip(spark, issues):
    """Every finding written as its block of a report and read back."""
    blocks = sinks.markdown_blocks(issues).select(F.col("ord").cast("string").alias("path"), F.col("block").alias("text"))
    return report_rules.markdown_issues(blocks).select("path", "severity", "title", "file", "line", "category", "impact", "recommendedFix", "explanation", "codeExample")


# ---- documents, explanations, captured answers ----


def _meta(spark):
    return spark.sql("SELECT 'review' AS mode, TIMESTAMP '2026-01-02 03:04:00' AS generated, 61 AS seconds, 80 AS confidence, 'GO' AS commit_go, 'NO-GO' AS push_go, CAST(NULL AS STRING) AS reused_from, true AS bypassed, false AS skipped")


@_query(
    "SELECT 'Critical ' || count(*) FILTER (severity = 'CRITICAL') || ', High ' || count(*) FILTER (severity = 'HIGH') || ', Medium ' || count(*) FILTER (severity = 'MEDIUM') || ', Low ' || count(*) FILTER (severity = 'LOW') AS block, 0 AS section, 0::BIGINT AS ord FROM issues"
    " UNION ALL SELECT '#### [' || severity || '] ' || title || chr(10) || '- **Where:** `' || file || ':' || line || '`' || chr(10) || '- **Fix:** fix it' || CASE WHEN codeExample = 'x = 1' THEN chr(10) || '- **Example:**' || chr(10) || chr(10) || '```' || chr(10) || 'x = 1' || chr(10) || '```' ELSE '' END, 1, ord FROM issues WHERE severity IN ('CRITICAL', 'HIGH')",
    issues=V.ISSUES,
)
def pr_summary(spark, issues):
    """The counts, and the block of every critical or high finding."""
    d = documents.pr_summary(issues, _meta(spark))
    counts = F.regexp_extract("block", r"\*\*Counts:\*\* (.*)", 1)
    return d.where("section < 2 and lane = 1").select(F.when(F.col("section") == 0, counts).otherwise(F.col("block")).alias("block"), "section", "ord")


@_query(
    "n AS (SELECT CASE priority WHEN 'P1' THEN 3 WHEN 'P2' THEN 4 ELSE 5 END AS section, count(*) AS n_blocks FROM issues GROUP BY 1 UNION ALL SELECT 8, count(*) FROM issues WHERE fixTiming = 'immediately' UNION ALL SELECT 9, 1 UNION ALL SELECT range, 1 FROM range(3) UNION ALL SELECT 12, 1) SELECT section::INT AS section, n_blocks + CASE WHEN section IN (3, 4, 5, 8, 9) THEN 1 ELSE 0 END AS n_blocks FROM n",
    issues=V.ISSUES.replace(" AS locationVerified FROM", " AS locationVerified, CASE WHEN o_orderkey % 9 = 0 THEN 'immediately' ELSE 'before launch' END AS fixTiming FROM"),
    notes=V.NOTES,
)
def report_sections(spark, issues, notes):
    """Blocks of each section of the whole report, headings included."""
    doc = documents.report(issues, _meta(spark), gaps=notes.select("ord", F.col("note").alias("gap")))
    return doc.groupBy("section").agg(F.count("*").alias("n_blocks"))


_ORDERED = "SELECT row_number() OVER (ORDER BY section, lane, rank, file, line, ord)::BIGINT AS nth, block FROM b"
_COUNTS = "'Critical ' || count(*) FILTER (severity = 'CRITICAL') || ', High ' || count(*) FILTER (severity = 'HIGH') || ', Medium ' || count(*) FILTER (severity = 'MEDIUM') || ', Low ' || count(*) FILTER (severity = 'LOW')"
_EXAMPLE = "chr(10) || chr(10) || '```' || chr(10) || 'x = 1' || chr(10) || '```'"
_CLOSING = "'_Suggested fixes are for review; nothing is changed by itself._'"
_AT = "0 AS rank, '' AS file, 0 AS line, 0::BIGINT AS ord"


def _in_order(document):
    """Every block of a document with its place, from 1."""
    return ordered.numbered(document, *map(F.col, documents.ORDER), name="nth").select((F.col("nth") + 1).alias("nth"), "block")


@_query(
    f"b AS (SELECT 0 AS section, 1 AS lane, {_AT}, '## Summary for review' || chr(10) || chr(10) || '**Gate confidence:** 80%' || chr(10) || '**Counts:** ' || {_COUNTS} || chr(10) || '**LLM:** bypassed (scanners clean at triage floor)' AS block FROM issues"
    f" UNION ALL SELECT 1, 0, {_AT}, '## Suggested fixes (critical and high)' || CASE WHEN count(*) = 0 THEN chr(10) || chr(10) || '_No critical or high findings._' ELSE '' END FROM issues WHERE severity IN ('CRITICAL', 'HIGH')"
    f" UNION ALL SELECT 1, 1, -({RANK}), file, line, ord, '#### [' || severity || '] ' || title || chr(10) || '- **Where:** `' || file || ':' || line || '`' || chr(10) || '- **Fix:** fix it' || CASE WHEN codeExample = 'x = 1' THEN chr(10) || '- **Example:**' || {_EXAMPLE} ELSE '' END FROM issues WHERE severity IN ('CRITICAL', 'HIGH')"
    f" UNION ALL SELECT 2, 2, {_AT}, {_CLOSING}) {_ORDERED}",
    issues=V.ISSUES,
)
def pr_summary_text(spark, issues):
    """The whole summary, block by block, in order."""
    return _in_order(documents.pr_summary(issues, _meta(spark)))


_TIMED = V.ISSUES.replace(" AS locationVerified FROM", " AS locationVerified, CASE WHEN o_orderkey % 9 = 0 THEN 'immediately' ELSE 'before launch' END AS fixTiming FROM")
_FIELD = "chr(10) || '- **{}:** ' || {}"


@_query(
    f"b AS (SELECT 0 AS section, 1 AS lane, {_AT}, '# Review report, 2026-01-02 03:04 UTC' || chr(10) || chr(10) || '**Mode:** `review`' || chr(10) || '**Generated:** 2026-01-02 03:04 UTC' || chr(10) || '**Duration:** 1m 1s (61s)' || chr(10) || '**Gate confidence:** 80%' || chr(10) || '**Commit go/no-go:** GO' || chr(10) || '**Push go/no-go:** NO-GO' AS block"
    f" UNION ALL SELECT 1, 1, {_AT}, '## Gate verdict' || chr(10) || chr(10) || '- **Counts:** ' || {_COUNTS} || chr(10) || '- **LLM:** bypassed (scanners clean at triage floor)' FROM issues"
    f" UNION ALL SELECT 2, 1, {_AT}, '## Finding fields' || chr(10) || {' || '.join(f"chr(10) || '{x}'" for x in ('- **Priority:** P1 security, P2 bugs and reliability, P3 architecture and quality.', '- **Fingerprint:** the issue' + chr(39) * 2 + 's identity over runs; **Occurrence:** this row of this report.', '- **Source:** `scanner`, `heuristic` or `llm`. **Location:** only verified ones go to SARIF.'))}"
    + "".join(f" UNION ALL SELECT {3 + k}, 0, {_AT}, '## {label}' || CASE WHEN count(*) = 0 THEN chr(10) || chr(10) || '_No findings in this band._' ELSE '' END FROM issues WHERE priority = '{band}'" for k, (band, label) in enumerate((("P1", "P1 - Security"), ("P2", "P2 - Bugs, reliability, performance"), ("P3", "P3 - Architecture and quality"))))
    + " UNION ALL SELECT CASE priority WHEN 'P1' THEN 3 WHEN 'P2' THEN 4 ELSE 5 END, 1, 0, '', 0, ord, '### [' || severity || '] ' || title || "
    + " || ".join(_FIELD.format(n, c) for n, c in (("File", "file || ':' || line"), ("Category", "category"), ("Impact", "impact"), ("Why", "explanation"), ("Fix", "recommendedFix")))
    + " || CASE WHEN codeExample = 'x = 1' THEN chr(10) || '```' || chr(10) || 'x = 1' || chr(10) || '```' ELSE '' END FROM issues"
    f" UNION ALL SELECT 8, 0, {_AT}, '## Plan to fix' || CASE WHEN count(*) = 0 THEN chr(10) || chr(10) || '_No immediate findings._' ELSE '' END FROM issues WHERE fixTiming = 'immediately'"
    " UNION ALL SELECT 8, 1, 0, '', 0, ord, '1. **' || title || '** (`' || file || ':' || line || '`): fix it' FROM issues WHERE fixTiming = 'immediately'"
    f" UNION ALL SELECT 9, 0, {_AT}, '## Durability gaps' UNION ALL SELECT 9, 1, 0, '', 0, ord, '- [ ] ' || note FROM notes WHERE NOT starts_with(note, 'coverage:')"
    f" UNION ALL SELECT 12, 1, {_AT}, {_CLOSING}) {_ORDERED}",
    issues=_TIMED, notes=V.NOTES,
)
def report_text(spark, issues, notes):
    """The whole report, block by block, in order."""
    return _in_order(documents.report(issues, _meta(spark), gaps=notes.select("ord", F.col("note").alias("gap"))))


_STEPS = ("Consider refactor of the larger parts as appropriate, once the tests are there", "Move load_all out", "Put it there -> b.py", "", "Refactor the thing that is long enough to be over forty-eight characters", "Write down what the next person has to read first, then ask them to act on it", "preload_all", "read LOADING.py first")
_PLAN = f"SELECT o_orderkey AS ord, {V.pick('o_custkey', *_STEPS)} AS step, {V.pick('o_orderkey', 'load_all (10-20) -> src/loading.py', 'notes', 'person')} AS move FROM {{orders}}"


@_query(
    r"w AS (SELECT *, lower(step) AS t, CASE WHEN contains(move, '(') THEN ['load_all', 'loading.py', 'loading'] ELSE [move] END AS names FROM plans) SELECT ord, CASE WHEN step = '' THEN true WHEN contains(step, '->') THEN false WHEN len(list_filter(names, lambda x: regexp_matches(t, '(^|[^a-z0-9_])' || x || '($|[^a-z0-9_])'))) > 0 THEN false ELSE contains(t, 'consider refactor') OR contains(t, 'as appropriate') OR (starts_with(t, 'refactor') AND length(step) < 180) OR length(step) < 48 END AS vague FROM w",
    plans=_PLAN,
)
def vague_steps(spark, plans):
    return plans.select("ord", explain.is_vague(F.col("step"), F.array("move")).alias("vague"))


_LINES = """SELECT o_custkey AS answer, o_orderkey AS ord, CAST(o_orderkey % 10 AS DOUBLE) AS seconds, concat(CASE WHEN o_orderkey % 5 = 0 THEN 'event: x' ELSE 'data: ' END, CASE o_orderkey % 3 WHEN 0 THEN concat('{"choices":[{"delta":{"content":"', CAST(o_orderkey AS VARCHAR(20)), ' "}}]}') WHEN 1 THEN '[DONE]' ELSE '{"choices":[]}' END) AS line FROM {orders}"""


@_query("p AS (SELECT *, CASE WHEN starts_with(line, 'data:') AND contains(line, 'content') THEN ord || ' ' END AS p FROM lines) SELECT answer, coalesce(string_agg(p, '' ORDER BY ord), '') AS text, CASE WHEN max(seconds) > 8 THEN 'late' WHEN count(p) = 0 THEN 'empty' ELSE 'ok' END AS status FROM p GROUP BY answer", lines=_LINES)
def captured_answers(spark, lines):
    """Captured lines of streamed answers put together, with a deadline of 8 seconds."""
    return chunks.fold(lines, "choices", 8.0)


_BLOCK_LINES = """SELECT o_custkey AS answer, o_orderkey AS ord, CAST(o_orderkey % 9 AS DOUBLE) AS seconds, concat('data: ', CASE o_orderkey % 4 WHEN 0 THEN concat('{"type":"content_block_delta","delta":{"type":"text_delta","text":"', CAST(o_orderkey AS VARCHAR(20)), ';"}}') WHEN 1 THEN '{"type":"content_block_delta","delta":{"type":"input_json_delta","text":"no"}}' WHEN 2 THEN '{"type":"message_stop"}' ELSE '{"type":"ping","delta":{"type":"text_delta","text":"no"}}' END) AS line FROM {orders}"""


@_query("SELECT answer, coalesce(string_agg(CASE WHEN ord % 4 = 0 THEN ord || ';' END, '' ORDER BY ord), '') AS text, CASE WHEN max(seconds) > 7.5 THEN 'late' WHEN count(*) FILTER (ord % 4 = 0) = 0 THEN 'empty' ELSE 'ok' END AS status FROM lines GROUP BY answer", lines=_BLOCK_LINES)
def captured_blocks(spark, lines):
    """Captured lines of the other dialect, with a deadline of 7.5 seconds."""
    return chunks.fold(lines, "blocks", 7.5)


_NL = "chr(10)"
_DRAWN = f"""SELECT o_orderkey AS k, CASE o_orderkey % 8
 WHEN 0 THEN concat('text', {_NL}, '```mermaid', {_NL}, 'flowchart TD', {_NL}, '  run_', CAST(o_orderkey AS VARCHAR(20)), '.py --> b.py', {_NL}, '```', {_NL}, 'more')
 WHEN 1 THEN concat('graph LR', {_NL}, 'a', CAST(o_orderkey AS VARCHAR(20)), '(some label) ==> b["x y"]', {_NL}, 'note: dropped')
 WHEN 2 THEN concat('```', {_NL}, 'x -.-> y', CAST(o_orderkey AS VARCHAR(20)), {_NL}, 'z -->', {_NL}, '```')
 WHEN 3 THEN concat('no diagram ', CAST(o_orderkey AS VARCHAR(20)))
 WHEN 4 THEN concat('flowchart LR', {_NL}, 'A---B', CAST(o_orderkey AS VARCHAR(20)))
 WHEN 5 THEN concat('```mermaid', {_NL}, 'flowchart LR', {_NL}, CAST(o_orderkey AS VARCHAR(20)), ' → node/two')
 WHEN 6 THEN concat('flowchart LR', {_NL}, 'lone', CAST(o_orderkey AS VARCHAR(20)), {_NL}, 'A --')
 ELSE '' END AS raw FROM {{orders}}"""
_TOLD = "'Textual diagram (Mermaid unavailable):' || chr(10) || '- Reason: invalid Mermaid after repair' || chr(10) || '- Flow: [problem] → [impact] → [fix options] → [next step]' || chr(10) || '- Raw attempt:' || chr(10) || "


@_query(
    "d AS (SELECT k, CASE k % 8 WHEN 0 THEN 'flowchart TD' || chr(10) || 'run_' || k || '_py---b_py' WHEN 1 THEN 'graph LR' || chr(10) || 'a' || k || '---b' WHEN 2 THEN 'flowchart LR' || chr(10) || 'x---y' || k WHEN 4 THEN raw WHEN 5 THEN 'flowchart LR' || chr(10) || 'n_' || k || '---node_two' END AS mermaid FROM answers)"
    " SELECT k, CASE WHEN mermaid IS NULL THEN 'textual' ELSE 'mermaid' END AS kind, mermaid,"
    f" CASE WHEN mermaid IS NULL THEN {_TOLD} CASE k % 8 WHEN 3 THEN 'no diagram ' || k WHEN 6 THEN 'flowchart LR' || chr(10) || 'lone' || k ELSE '(empty)' END END AS textual,"
    " CASE k % 8 WHEN 2 THEN 'diagram.mermaid_repaired' WHEN 4 THEN NULL ELSE CASE WHEN mermaid IS NULL THEN 'diagram.mermaid_invalid' ELSE 'diagram.mermaid_normalized' END END AS note FROM d JOIN answers USING (k)",
    answers=_DRAWN,
)
def diagrams_of_answers(spark, answers):
    """Diagrams in model answers: normalised, repaired, or told in words."""
    return diagrams.drawn(answers, "raw").select("k", "diagram.*")


_TORN = """SELECT o_orderkey AS pass, substr(concat('{"confidence": 70, "gaps": ["g"], "issues": [', repeat('{"title":"T, } ]","line":"L12"},', 9), '{"title":"last"}]}'), 1, CAST(45 + o_orderkey % 320 AS INT)) AS raw, concat('cut ', CAST(o_orderkey % 7 AS VARCHAR(20))) AS error FROM {orders}"""


@_query(
    "n AS (SELECT pass, error, length(raw) AS n, 45 AS head, 31 AS one FROM answers), w AS (SELECT *, CASE WHEN n >= head + 9 * (one + 1) + 16 THEN 10 ELSE least(9, (n - head + 1) // (one + 1)) END AS whole FROM n)"
    " SELECT pass, 70 AS confidence, whole AS n_findings, n < head + 9 * (one + 1) + 18 AS salvaged, 'g|llm.schema_invalid (pass: ' || pass || '): ' || error AS gaps FROM w",
    deal=True, answers=_TORN,
)
def salvaged_answers(spark, answers):
    """Answers that were cut off: the findings that are whole in them, and a gap that tells the error."""
    d = coerce.salvage(answers)
    return d.select("pass", F.col("confidence").cast("int").alias("confidence"), coerce.n_issues(F.col("issues")).cast("long").alias("n_findings"), "salvaged", F.array_join("gaps", "|").alias("gaps"))


_PYTHON = f"""SELECT doc_id AS k, concat('f', CAST(doc_id AS VARCHAR(20)), '.py') AS relative, concat('def a', CAST(doc_id AS VARCHAR(20)), '():', {_NL}, repeat(concat('    x = 1', {_NL}), CAST(doc_id % 5 + 1 AS INT)), 'class K:', {_NL}, '    async def m(self):', {_NL}, '        pass', {_NL}, CASE WHEN doc_id % 4 = 0 THEN 'def broken(' ELSE '' END) AS content FROM {{documents}}"""


@_query(
    "f AS (SELECT relative, k, k % 5 + 1 AS n FROM files WHERE k % 4 <> 0) SELECT relative, 'function' AS kind, 'a' || k AS name, 1 AS start_line, (n + 1)::INT AS end_line FROM f"
    " UNION ALL SELECT relative, 'class', 'K', (n + 2)::INT, (n + 4)::INT FROM f UNION ALL SELECT relative, 'async_method', 'K.m', (n + 3)::INT, (n + 4)::INT FROM f",
    files=_PYTHON,
)
def python_outline(spark, files):
    """Outlines of Python texts; one that doesn't parse has none."""
    return symbols.symbols(files.select("relative", "content")).drop("n_symbols")


_PARTS = f"""SELECT CAST(o_orderkey % 5 AS INT) AS part, CAST(floor(o_orderkey / 5) AS BIGINT) AS ord, concat({V.pick('o_custkey', 'scanner:osv missing ', 'gap ', 'coverage:sec.xxe: missed ')}, CAST(o_custkey % 90 AS VARCHAR(20))) AS gap FROM {{orders}}"""


@_query("f AS (SELECT gap, min(part * 100000000000 + ord) AS place FROM gaps GROUP BY gap) SELECT row_number() OVER (ORDER BY place, gap) - 1 AS ord, gap FROM f", gaps=_PARTS)
def merged_gaps(spark, gaps):
    """Gaps of all passes in their order, each once."""
    return findings.merge_gaps(gaps)


@_query("SELECT CASE WHEN k % 6 = 0 THEN 'https://github.com/o' || k || '/r.x.git' WHEN k % 6 = 1 THEN 'https://github.com/a/b.git' END AS github, CASE WHEN k % 6 IN (0, 1) THEN 'https://bitbucket.org/' || CASE k % 6 WHEN 0 THEN 'o' || k || '/r.x' ELSE 'a/b' END || '.git' END AS bitbucket, CASE k % 6 WHEN 0 THEN 'https://huggingface.co/o' || k || '/r.x' WHEN 1 THEN 'https://huggingface.co/a/b.git' WHEN 2 THEN 'https://huggingface.co/datasets/d/' || k WHEN 3 THEN 'https://huggingface.co/m/' || k END AS hub, k FROM names", names="SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN concat(' o', CAST(o_orderkey AS VARCHAR(20)), '/r.x ') WHEN 1 THEN 'a/b.git' WHEN 2 THEN concat('/datasets/d/', CAST(o_orderkey AS VARCHAR(20))) WHEN 3 THEN concat('models/m/', CAST(o_orderkey AS VARCHAR(20))) WHEN 4 THEN 'a b/c' END AS name FROM {orders}")
def source_addresses(spark, names):
    """Where named repositories and hub ids are cloned from."""
    return names.select("k", *[store.address(kind, F.col("name")).alias(kind) for kind in ("github", "bitbucket", "hub")])
