"""Column functions over paths, texts and findings. All are Spark built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
IGNORED_DIRS = (
    ".git", ".hg", ".svn", ".venv", "venv", "node_modules", "dist", "build", "__pycache__", ".pytest_cache",
    ".mypy_cache", ".ruff_cache", ".reviews", "reports", ".tox", "coverage", ".idea", ".vscode", ".superpowers",
)
IGNORED_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".pdf", ".zip", ".gz", ".tar", ".woff", ".woff2", ".ttf", ".eot", ".mp3", ".mp4", ".wasm", ".lock")
BAND1_HINTS = (".env", "secret", "password", "credential", "auth", "jwt", "oauth", "session", "security", "crypto", "tls", "ssl", "firewall", "permission", "rbac")
BAND2_HINTS = ("controller", "service", "model", "route", "api/", "handlers")
SCANNERS = ("gitleaks", "semgrep", "osv", "trivy", "checkov")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
SEVERITY_ALIASES = {
    "CRIT": "CRITICAL", "CRITICAL": "CRITICAL", "P1": "HIGH", "HIGH": "HIGH", "SEVERE": "HIGH", "ERROR": "HIGH", "P2": "MEDIUM", "MEDIUM": "MEDIUM",
    "MODERATE": "MEDIUM", "WARN": "MEDIUM", "WARNING": "MEDIUM", "P3": "LOW", "LOW": "LOW", "INFO": "LOW", "INFORMATIONAL": "LOW", "MINOR": "LOW",
}
#: Name space of stable ids: the standard DNS one.
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
#: Line ends besides \r\n that Python's splitlines knows.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def strip(c: Column) -> Column:
    """c without white space at its ends, line ends included."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def any_of(c: Column, needles) -> Column:
    """True where c contains one of the strings."""
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def lookup(c: Column, table: dict) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return m[c]


# ---- paths ----


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"^.+?(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    n = file_name(path)
    return F.substring(n, F.lit(1), F.length(n) - F.length(suffix(path)))


def folder(path: Column) -> Column:
    d = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path.contains("/"), d).otherwise(F.lit("."))


def is_ignored(path: Column) -> Column:
    """A component is an ignored directory, or the suffix or minified ending is ignored."""
    dirs = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED_DIRS)))
    return dirs | F.lower(suffix(path)).isin(*IGNORED_SUFFIXES) | F.lower(file_name(path)).rlike(r"\.min\.(js|css)$")


def is_unsafe(path: Column) -> Column:
    """An absolute path or one with a `..` component."""
    return path.startswith("/") | F.array_contains(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), "..")


def is_test_fixture(path: Column) -> Column:
    p = F.split(path, "/")
    return F.coalesce((F.get(p, F.lit(0)) == "tests") & (F.get(p, F.lit(1)) == "fixtures"), F.lit(False))


def band(path: Column) -> Column:
    low = F.lower(path)
    return F.when(any_of(low, BAND1_HINTS), 1).when(any_of(low, BAND2_HINTS), 2).otherwise(3)


def norm_id(path: Column) -> Column:
    return F.lower(strip(F.replace(path, F.lit("\\"), F.lit("/"))))


def norm_route(path: Column) -> Column:
    return F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("./"))


def norm_match(path: Column) -> Column:
    return F.ltrim(F.lower(F.replace(strip(path), F.lit("\\"), F.lit("/"))), F.lit("./"))


def norm_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def glob_regex(glob: str) -> str:
    """Regular expression of a right-anchored path pattern; a leading `**/` asks for a parent."""
    out = ""
    for part in glob.split("/"):
        out += ("/" if out else "") + ("[^/]+" if part == "**" else "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() else c for c in part))
    return f"(^|/){out}$"


# ---- texts ----


def line_count(text: Column) -> Column:
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(n + F.when(text.endswith("\n"), 0).otherwise(1)).cast("long")


def split_lines(text: Column) -> Column:
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def excerpt(text: Column, cap: int = 12_000, marker: str = "\n[cut]") -> Column:
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit(marker))).otherwise(text)


def excerpt_at(text: Column, line: Column, before: int = 8, after: int = 12, cap: int = 2000) -> Column:
    """Lines around a line: `before` of them, then `after` from the line on."""
    lines, start = split_lines(text), F.greatest(line - before, F.lit(1))
    n = F.least(line + after, F.size(lines) + 1) - start
    return F.substring(F.array_join(F.slice(lines, start, F.greatest(n, F.lit(0))), "\n"), 1, cap)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    head = F.substring(text, F.lit(1), offset)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")


def escape_workflow(text: Column) -> Column:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (":", "%3A")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def redact_git(text: Column) -> Column:
    """First useful line of an error, without credentials, of 300 characters at most."""
    t = F.regexp_replace(text, r"(?i)(authorization:\s*)\S+(\s+\S+)?", "$1***")
    t = F.regexp_replace(t, r"://[^/@\s]+@", "://***@")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    return F.substring(F.trim(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))), 1, 300)


# What ids of advisories and issues look like.
ADVISORY = r"(?i)\b(CVE-\d{4}-\d{4,}|GHSA-[a-z0-9]{4}-[a-z0-9]{4}-[a-z0-9]{4})\b"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def advisory_id(text: Column) -> Column:
    return F.upper(F.regexp_extract(text, ADVISORY, 1))


def package_hint(title: Column) -> Column:
    return F.lower(F.regexp_extract(title, r"(?i)\b(?:in|for)\s+([A-Za-z0-9_.@/+-]+)", 1))


# The ways that sources name a package.
PACKAGE_SHAPES = (
    r"\bimport\s+{dotted}\b",
    r"\bfrom\s+{dotted}\b",
    r"""require\(\s*['"]{escaped}['"]\s*\)""",
    r"""from\s+['"]{escaped}['"]""",
    r"""import\(\s*['"]{escaped}['"]\s*\)""",
    r"\b{escaped}\b",
)


def package_patterns(name: Column) -> Column:
    """One pattern of all shapes: `escaped` is the name, `dotted` the name as imports write it, with underscores for hyphens."""
    quote = lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))
    pattern = F.replace(F.lit("(?U)" + "|".join(PACKAGE_SHAPES)), F.lit("{dotted}"), quote(F.replace(name, F.lit("-"), F.lit("_"))))
    return F.replace(pattern, F.lit("{escaped}"), quote(name))


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID) & ~c.endswith("\n"), F.lit(False))


def run_id(known: Column) -> Column:
    """The id that a row has, else a fresh random one (never the same twice: keep it out of comparisons)."""
    return F.coalesce(known, F.uuid())


def file_hash(content: Column) -> Column:
    """SHA-256 of a file's bytes."""
    return F.sha2(content.cast("binary"), 256)


def is_coverage_note(gap: Column) -> Column:
    """Notes that carry coverage (N/A or missed) and are no gap of their own."""
    return F.coalesce(F.trim(gap).rlike(r"(?i)^coverage:[^\s:]+\s*:\s*(N/A|missed)\b"), F.lit(False))


def mentions(text: Column, token: Column) -> Column:
    """The token of two characters or more stands in text as a whole, whatever its case."""
    return (F.length(token) >= 2) & F.rlike(text, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])\Q"), token, F.lit(r"\E(?![A-Za-z0-9_])")))


# ---- findings ----


def sev_rank(sev: Column) -> Column:
    return F.when(sev == "CRITICAL", 4).when(sev == "HIGH", 3).when(sev == "MEDIUM", 2).when(sev == "LOW", 1)


def at_least(sev: Column, floor: str) -> Column:
    """Severity reaches the floor; an unknown floor counts as HIGH."""
    f = floor.upper()
    return sev_rank(sev) >= (SEVERITIES.index(f) + 1 if f in SEVERITIES else 3)


def uuid5(key: Column, namespace: str = NAMESPACE) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(key, "UTF-8")))
    v = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8).cast("long")))
    s = lambda a, n: F.substring(h, a, n)
    return F.concat(s(1, 8), F.lit("-"), s(9, 4), F.lit("-5"), s(14, 3), F.lit("-"), v, s(18, 3), F.lit("-"), s(21, 12))


def stable_id(category: Column, file: Column, title: Column, prefix: str) -> Column:
    """Name-based id of a finding: category and file lowered, the title's case kept, white space collapsed."""
    return uuid5(F.concat_ws("|", F.lit(prefix), F.lower(F.trim(category)), norm_id(file), norm_text(title)))


def infer_source(source: Column, category: Column) -> Column:
    c = F.lower(category)
    guess = F.when(any_of(c, SCANNERS), "scanner").when(c.startswith("heuristic.") | c.startswith("pack."), "heuristic").otherwise("llm")
    return F.coalesce(source, guess)


def stamp_source(source: Column, category: Column, default_llm: bool = False) -> Column:
    """As infer_source, but what looks like neither scanner nor heuristic stays null unless default_llm."""
    got = infer_source(source, category)
    return got if default_llm else F.when(source.isNotNull() | (got != "llm"), got)


def is_security_category(category: Column) -> Column:
    c = F.lower(F.trim(category))
    return c.startswith("sec.") | c.startswith("security") | any_of(c, SCANNERS)


def is_security(priority: Column, category: Column) -> Column:
    return (priority == "P1") | is_security_category(category)


def is_reliability(priority: Column, category: Column) -> Column:
    return (priority == "P2") | F.lower(category).startswith("rel.")


def is_architecture(priority: Column, category: Column) -> Column:
    c = F.lower(category)
    return (priority == "P3") | c.startswith("arch.") | c.startswith("heuristic.")


def tagged(explanation: Column, tag: str) -> Column:
    return F.when(explanation.contains(tag), explanation).otherwise(F.concat(F.lit(tag + " "), explanation))


def coerce_severity(raw: Column) -> Column:
    t = F.replace(F.upper(strip(F.coalesce(raw, F.lit("")))), F.lit(" "), F.lit("_"))
    out = F.coalesce(lookup(t, SEVERITY_ALIASES))
    for name in reversed(SEVERITIES):
        out = F.coalesce(out, F.when(t.contains(name), F.lit(name)))
    return F.coalesce(out, F.lit("MEDIUM"))


def priority_of(sev: Column) -> Column:
    return F.when(sev.isin("CRITICAL", "HIGH"), "P1").when(sev == "MEDIUM", "P2").otherwise("P3")


def coerce_priority(raw: Column, sev: Column) -> Column:
    t = F.upper(strip(F.coalesce(raw, F.lit(""))))
    return F.when(t.isin("P1", "1", "HIGH", "CRITICAL"), "P1").when(t.isin("P2", "2", "MEDIUM"), "P2").when(t.isin("P3", "3", "LOW"), "P3").otherwise(priority_of(sev))


def coerce_timing(raw: Column) -> Column:
    t = F.lower(strip(F.coalesce(raw, F.lit(""))))
    exact = F.when(t.isin("immediately", "before launch", "after launch", "if time permits"), t)
    return F.coalesce(exact, F.when(t.contains("immediate"), "immediately").when(t.contains("after"), "after launch").when(t.contains("permit") | t.contains("later"), "if time permits").otherwise("before launch"))


def coerce_line(v: Column) -> Column:
    """Line of a VARIANT: a boolean is 1, a number is floored, a string gives its first digits; at least 1."""
    kind = F.schema_of_variant(v)
    text = v.cast("string")
    number = F.when(kind == "BOOLEAN", F.lit(1)).when(kind == "STRING", F.regexp_extract(text, r"(\d{1,9})", 1).try_cast("int")).otherwise(F.floor(text.try_cast("double")).cast("int"))
    return F.greatest(F.lit(1), F.coalesce(number, F.lit(1)))


def first_text(*values: Column) -> Column:
    """First value that isn't null or blank, trimmed; else an empty string."""
    return F.coalesce(*[F.nullif(strip(v), F.lit("")) for v in values], F.lit(""))


# ---- coverage ----

# Fixed values.
ALWAYS_LAZY = ("not reviewed", "not explicitly reviewed", "not addressed in this document")
SOFT_LAZY = ("could be improved", "partially addressed")
CONCRETE = ("no http", "no html", "no sql", "no orm", "no network", "not present", "out of scope", "n/a for", "in pack", "in provided", "in reviewed", "desktop app")
ALIASES = {"sec.secrets": "sec.repo_hygiene_secrets", "sec.deps_config": "sec.deps_supply_chain"}
HEURISTIC_THEMES = {
    "heuristic.mega_file": "arch.structure_size",
    "heuristic.sibling_duplication": "arch.duplication",
    "heuristic.gitignore_secrets": "sec.repo_hygiene_secrets",
    "heuristic.scripts_hygiene": "arch.dead_code",
    "heuristic.todo_density": "arch.dead_code",
    "heuristic.ci_gaps": "arch.ci_durability",
}


def is_lazy(reason: Column) -> Column:
    t = F.lower(strip(reason))
    return (t == "") | any_of(t, ALWAYS_LAZY) | (any_of(t, SOFT_LAZY) & ~any_of(t, CONCRETE))


def canonical_id(cov: Column) -> Column:
    return F.coalesce(lookup(cov, ALIASES), cov)


def note_id(note: Column) -> Column:
    return F.regexp_extract(F.trim(note), r"(?i)^coverage:([^\s:]+)\s*:\s*N/A\s*[—-]\s*(.+)$", 1)


def note_reason(note: Column) -> Column:
    return F.trim(F.regexp_extract(F.trim(note), r"(?i)^coverage:([^\s:]+)\s*:\s*N/A\s*[—-]\s*(.+)$", 2))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), c))


def stamp(when: Column) -> Column:
    """Part of a report's file name: the UTC minute."""
    return F.date_format(when, "yyyy-MM-dd_HHmm")


def report_name(mode: Column, when: Column) -> Column:
    known = F.nullif(F.replace(F.lower(F.trim(mode)), F.lit(" "), F.lit("_")), F.lit(""))
    return F.concat(F.lit("review_report_"), F.coalesce(known, F.lit("review")), F.lit("_"), stamp(when))


def is_safe_rule_id(c: Column) -> Column:
    """An id that cannot leave the rules' folder."""
    return F.coalesce((c != "") & ~c.isin(".", "..") & ~c.rlike(r"[/\\]"), F.lit(False))


def duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    text = F.concat(F.when(h > 0, F.concat(h, F.lit("h "))).otherwise(F.lit("")), F.when((h > 0) | (m > 0), F.concat(m, F.lit("m "))).otherwise(F.lit("")), s % 60, F.lit("s"))
    return F.when(s >= 60, F.concat(text, F.lit(" ("), s, F.lit("s)"))).otherwise(text)
