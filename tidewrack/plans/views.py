"""Relations of the engine over general tables, in SQL that Spark and DuckDB both read.

{name} stands for a table. These mappings only supply inputs; no operator's logic is in them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def pick(expr: str, *options: str) -> str:
    """One of the options by expr modulo their number."""
    return f"CASE ({expr}) % {len(options)} " + " ".join(f"WHEN {k} THEN '{o}'" for k, o in enumerate(options)) + " END"


_DIRS = ("src/auth", "src/services", "node_modules/x", "docs", "src/ui", "tests/fixtures/a", "lib", "api")
_VERBS = ("Extract", "Replace", "Open", "Close", "plain", "Get", "Set", "Main")
_EXT = (".py", ".ts", ".md", ".sh", ".swift", ".min.js", ".lock", ".json")
FILES = f"""SELECT doc_id AS ord, concat({pick("doc_id", *_DIRS)}, '/', {pick("CAST(floor(doc_id / 8) AS BIGINT)", *_VERBS)}, 'Tool', CAST(CAST(floor(doc_id / 64) AS BIGINT) AS VARCHAR(20)), {pick("CAST(floor(doc_id / 64) AS BIGINT)", *_EXT)}) AS relative, n_chars AS size, concat(coalesce(text, ''), CASE WHEN doc_id % 3 = 0 THEN ' passwd' ELSE '' END) AS content FROM {{documents}}"""
_CATS = ("sec.injection", "heuristic.mega_file", "semgrep.rule", "arch.duplication", "rel.performance", "gitleaks", "Security.misc", "llm.note", "sec.secrets", "osv", "heuristic.todo_density", "pack.cloud")
_TITLES = ("Shell command injection", "Hardcoded secret token", "Large file", "Slow loop", "CVE-2024-12345 in left-pad", "Missing test", "CVE-2024-12345 for left-pad", "GHSA-ab12-cd34-ef56 in requests")
_EXPL = ("subprocess.run([argv]) is used", "intentional demo only sample", "password in tests", "coverage is low", "no note", "api misuse", "subprocess.call(cmd, shell=True)")
_FILES = ("src/auth/a.py", "./src/b.py", "tests/fixtures/c.py", "examples/d.py", "SRC/Auth/A.py", "src/e.py", "lib/f.py")
ISSUES = f"""SELECT o_orderkey AS ord, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 {pick("o_custkey", "P1", "P2", "P3")} AS priority, {pick("o_orderkey", *_CATS)} AS category, {pick("o_custkey", *_FILES)} AS file, CAST(o_orderkey % 400 + 1 AS INT) AS line,
 {pick("CAST(floor(o_orderkey / 12) AS BIGINT)", *_TITLES)} AS title, {pick("o_orderkey + o_custkey", *_EXPL)} AS explanation, {pick("o_orderkey", "data loss", "", "leak")} AS impact,
 'fix it' AS recommendedFix, {pick("o_custkey", "x = 1", "", "  ")} AS codeExample, CASE WHEN o_orderkey % 4 = 0 THEN 'CWE-78' END AS cwe,
 CASE o_orderkey % 5 WHEN 0 THEN 'llm' WHEN 1 THEN 'scanner' END AS source, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS locationVerified FROM {{orders}}"""
OLD = "SELECT concat('f/', CAST(p_partkey AS VARCHAR(20))) AS path, p_name AS sha256 FROM {part} WHERE p_partkey % 7 <> 1"
NEW = "SELECT concat('f/', CAST(p_partkey AS VARCHAR(20))) AS path, CASE WHEN p_partkey % 5 = 0 THEN concat(p_name, '!') ELSE p_name END AS sha256 FROM {part} WHERE p_partkey % 11 <> 2"
RUNS = "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome, value AS llm_seconds FROM {events}"
FEEDBACK = f"SELECT event_id AS ord, {pick('user_id', *_FILES[:3])} AS file, {pick('event_id', *_CATS[:5], '')} AS category, CASE WHEN event_type IN ('click', 'signup') AND event_id % 50 < 3 THEN 'false_positive' ELSE 'other' END AS reason FROM {{events}}"
RULES = "SELECT * FROM (VALUES (1, CAST(NULL AS VARCHAR(40)), 'src/auth/a.py', 'sec.injection', 'wont_fix', CAST(NULL AS DATE)), (2, CAST(NULL AS VARCHAR(40)), './SRC/auth/A.py', 'Gitleaks', 'accepted_risk', DATE '2030-01-01'), (3, 'id-24', CAST(NULL AS VARCHAR(40)), CAST(NULL AS VARCHAR(40)), 'other', CAST(NULL AS DATE)), (4, CAST(NULL AS VARCHAR(40)), 'lib/f.py', 'osv', 'other', DATE '2020-01-01'), (5, CAST(NULL AS VARCHAR(40)), 'src/b.py', 'arch.duplication', 'other', CAST(NULL AS DATE))) AS t(ord, stable_id, file, category, reason, expires)"
NOTES = "SELECT * FROM (VALUES (1, 'coverage:sec.xss_csrf: N/A - no html surface'), (2, 'coverage:arch.i18n: N/A - not reviewed'), (3, 'coverage:rel.concurrency: N/A - could be improved'), (4, 'coverage:arch.pwa: N/A - partially addressed, desktop app'), (5, 'coverage:rel.concurrency: N/A - no network use'), (6, 'coverage:arch.a11y: N/A - could be improved'), (7, 'unrelated')) AS t(ord, note)"


#: Rows of a table that a task turns into long texts, where a mapping is dealt out.
DEALT = 25_000


def view(spark: SparkSession, sf_dir: str, sql: str, deal: bool = False) -> DataFrame:
    """A mapping over the tables of a folder.

    deal: the tables' rows are dealt out first, by their number. A mapping may make long texts of a few short columns, so that
    one task would otherwise work on millions of them, from a file that is too small to split.
    """
    names = ("documents", "orders", "part", "events", "pages", "customer", "lineitem")

    def table(m: re.Match) -> str:
        path = f"parquet.`{sf_dir}/{m[1]}.parquet`"
        if not deal:
            return path
        n = spark.sql(f"SELECT count(*) FROM {path}").first()[0]
        return f"(SELECT /*+ REPARTITION({max(1, -(-n // DEALT))}) */ * FROM {path})"

    sql = re.sub(rf"{{({'|'.join(names)})}}", table, sql)
    return spark.sql(sql.replace("VARCHAR(20)", "STRING").replace("VARCHAR(40)", "STRING"))
