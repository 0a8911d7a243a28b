"""Table functions from files to findings: path, title, severity, priority, category, line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

# Fixed values.
MEGA_EXCLUDES = ("**/*.md", "**/docs/**", "**/.superpowers/**", "**/xcuserdata/**", "**/*.xcuserstate", "**/*.pbxproj")
PREFIX_PAIRS = (("Extract", "Replace"), ("Create", "Delete"), ("Add", "Remove"), ("Insert", "Delete"), ("Open", "Close"), ("Start", "Stop"), ("Begin", "End"), ("Get", "Set"), ("Show", "Hide"), ("Enable", "Disable"))
SCRIPTS = (".sh", ".bash", ".zsh", ".ps1")
PASSWORD = r"(?i)(password|passwd|apple[_ -]?id|notarize|notarytool|APP_PASSWORD|NOTARIZE)"
KEYCHAIN = r"(?i)(keychain|security find-generic-password|op read|secret.?manager|1password|vault)"
TODO = r"\b(TODO|FIXME|XXX|HACK)\b"
COMMENTED = r"(?m)^\s*(#|//)\s*(def |class |function |const |let |var |import |return |if |for )"
MANIFESTS = ("package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "requirements.txt", "pyproject.toml", "Pipfile", "Pipfile.lock", "poetry.lock", "go.mod", "Cargo.toml", "Gemfile", "composer.json", "pom.xml", "build.gradle", "build.gradle.kts")
UPDATE_FILES = (".github/dependabot.yml", ".github/dependabot.yaml")
ANALYSIS_FILES = (".github/workflows/codeql.yml", ".github/workflows/codeql.yaml", ".github/workflows/codeql-analysis.yml", ".github/workflows/codeql-analysis.yaml")


def _found(df: DataFrame, category: str, title, severity, priority: str, file="relative") -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.col(file).alias("file"), F.lit(1).alias("line"), title.alias("title"), sev.alias("severity"), F.lit(priority).alias("priority"), F.lit(f"heuristic.{category}").alias("category"))


def mega_files(files: DataFrame, least: int = 500, excludes=MEGA_EXCLUDES) -> DataFrame:
    d = files.withColumn("lines", C.line_count(F.col("content"))).where(F.col("lines") >= least)
    for g in excludes:
        tree = g[3:-3] if g.startswith("**/") and g.endswith("/**") else ""
        hit = F.col("relative").rlike(C.glob_regex(g))
        d = d.where(~(hit | F.array_contains(F.split("relative", "/"), tree)) if tree else ~hit)
    return _found(d, "mega_file", F.concat(F.lit("File has "), F.col("lines"), F.lit(" lines")), "MEDIUM", "P2")


def sibling_pairs(files: DataFrame) -> DataFrame:
    """dir, ext, left_prefix, right_prefix, shared, left_file, right_file: files of one folder whose names are a verb pair."""
    d = files.where(~C.is_test_fixture(F.col("relative"))).select("relative", C.folder(F.col("relative")).alias("dir"), C.suffix(F.col("relative")).alias("ext"), C.stem(F.col("relative")).alias("stem"))
    pairs = F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("r"), F.lit(s == 0).alias("is_left"), F.lit((a, b)[s]).alias("p")) for a, b in PREFIX_PAIRS for s in (0, 1)])
    d = d.select("*", F.explode(pairs).alias("q")).where(F.col("stem").startswith(F.col("q.p")))
    d = d.withColumn("shared", F.substring(F.col("stem"), F.length("q.p") + 1, F.length("stem"))).where(F.col("shared").rlike("^[A-Z]"))
    side = lambda left: F.max(F.when(F.col("q.is_left") == left, F.col("relative")))
    g = d.groupBy("dir", "ext", F.col("q.l").alias("left_prefix"), F.col("q.r").alias("right_prefix"), "shared").agg(side(True).alias("left_file"), side(False).alias("right_file"))
    return g.where("left_file is not null and right_file is not null")


def siblings(files: DataFrame) -> DataFrame:
    title = F.concat(F.lit("Parallel files: "), C.file_name(F.col("left_file")), F.lit(" and "), C.file_name(F.col("right_file")))
    return _found(sibling_pairs(files), "sibling_duplication", title, "MEDIUM", "P2", "left_file")


def ignored_secrets(files: DataFrame) -> DataFrame:
    """MEDIUM where env or notarize scripts exist and the root's ignore file lacks secret patterns (our definition)."""
    name = F.lower(C.file_name(F.col("relative")))
    script = C.suffix(name).isin(*SCRIPTS) & (name.contains("env") | name.contains("notarize") | F.col("content").rlike(PASSWORD))
    ok = (F.col("relative") == ".gitignore") & F.col("content").rlike(r"(?m)^\s*(\*?\.env|\.env\*|\*\.pem|\*secret)")
    g = files.agg(F.min(F.when(script & ~C.is_test_fixture(F.col("relative")), F.col("relative"))).alias("relative"), F.coalesce(F.bool_or(ok), F.lit(False)).alias("ok"))
    return _found(g.where("relative is not null and not ok"), "gitignore_secrets", F.lit("Ignore file lacks .env or secret patterns"), "MEDIUM", "P2")


def script_hygiene(files: DataFrame) -> DataFrame:
    name = F.lower(C.file_name(F.col("relative")))
    d = files.where(~C.is_test_fixture(F.col("relative")) & (F.lower(C.suffix(F.col("relative"))).isin(*SCRIPTS) | name.contains("notarize")))
    d = d.where(F.col("content").rlike(PASSWORD) & ~F.col("content").rlike(KEYCHAIN))
    sev = F.when(name.contains("notarize") | F.lower("content").contains("password"), "MEDIUM").otherwise("LOW")
    return _found(d, "scripts_hygiene", F.lit("Script handles credentials in plain text"), sev, "P2")


def todo_density(files: DataFrame, least: int = 8, todo: str = TODO) -> DataFrame:
    d = files.where(~C.is_test_fixture(F.col("relative"))).withColumn("n", F.regexp_count("content", F.lit(todo)) + F.regexp_count("content", F.lit(COMMENTED)))
    return _found(d.where(F.col("n") >= least), "todo_density", F.concat(F.lit("Open markers: "), F.col("n")), "LOW", "P3")


def ci_gaps(files: DataFrame) -> DataFrame:
    """One LOW finding on the first manifest if update or analysis automation is missing."""
    workflow = F.col("relative").rlike(r"^\.github/workflows/[^/]*\.y[^/]*ml$") & F.lower("content").contains("codeql")
    g = files.agg(F.min(F.when(C.file_name(F.col("relative")).isin(*MANIFESTS), F.col("relative"))).alias("relative"), F.coalesce(F.bool_or(F.col("relative").isin(*UPDATE_FILES)), F.lit(False)).alias("updates"), F.coalesce(F.bool_or(F.col("relative").isin(*ANALYSIS_FILES) | workflow), F.lit(False)).alias("analysis"))
    missing = F.concat_ws(" and ", F.when(~F.col("updates"), "dependency updates"), F.when(~F.col("analysis"), "code analysis"))
    return _found(g.where("relative is not null and not (updates and analysis)"), "ci_gaps", F.concat(F.lit("Missing automation: "), missing), "LOW", "P3")


#: Bytes of a file that the cloud pack looks at.
CLOUD_BYTES = 400_000
# What the cloud-automation pack looks at and for, as (title, pattern, severity); every match is a finding.
CLOUD_SUFFIXES = (".json", ".bicep", ".arm", ".yml", ".yaml", ".xml", ".txt")
GUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
CLOUD = (
    ("Tenant id in source", rf"""(?i)["']?(tenant[_-]?id|tenantid)["']?\s*[=:]\s*["']?({GUID})["']?""", "MEDIUM"),
    ("Subscription id in source", rf"""(?i)["']?(subscription[_-]?id|subscriptionid)["']?\s*[=:]\s*["']?({GUID})["']?""", "MEDIUM"),
    ("Secret in source", r"""(?i)["']?(client[_-]?secret|shared[_-]?key|primary[_-]?key|password)["']?\s*[=:]\s*["']([^"']{8,})["']""", "HIGH"),
)


def cloud_pack(files: DataFrame) -> DataFrame:
    """A finding for each match, with its line: the text is split at matches, and the lengths before each give its place."""
    d = files.where(F.lower(C.suffix(F.col("relative"))).isin(*CLOUD_SUFFIXES) & (F.col("size") <= CLOUD_BYTES))
    out = []
    for title, pattern, sev in CLOUD:
        m = d.select("relative", F.regexp_extract_all("content", F.lit(f"({pattern})"), F.lit(1)).alias("ms"), F.split("content", pattern, -1).alias("parts")).where(F.size("ms") > 0)
        m = m.select("relative", "parts", "ms", F.posexplode("ms").alias("k", "m"))
        before = F.concat(F.array_join(F.slice("parts", F.lit(1), F.col("k") + 1), ""), F.array_join(F.slice("ms", F.lit(1), F.col("k")), ""))
        line = (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")
        out.append(m.select(F.col("relative").alias("file"), line.alias("line"), F.lit(title).alias("title"), F.lit(sev).alias("severity"), F.lit("P1" if sev == "HIGH" else "P2").alias("priority"), F.lit("pack.cloud").alias("category")))
    return reduce(DataFrame.unionAll, out)


#: Stages in order; packs are registered under a name: (files) to findings.
STAGES = (mega_files, siblings, ignored_secrets, script_hygiene, todo_density, ci_gaps)
PACKS = {"cloud": cloud_pack}


def resolve_packs(names) -> list[str]:
    """Known names, lowered, once each, in order."""
    return list(dict.fromkeys(n.strip().lower() for n in names if n.strip().lower() in PACKS))


def run(files: DataFrame, packs=()) -> DataFrame:
    """All stages' findings with `stage`; their order is (stage, file, line, category, title)."""
    fs = [*STAGES, *(PACKS[p] for p in resolve_packs(packs))]
    return reduce(DataFrame.unionByName, [f(files).withColumn("stage", F.lit(k)) for k, f in enumerate(fs)])


def hot_paths(found: DataFrame) -> DataFrame:
    """Files of mega, sibling and pack findings, in order of stage, each once."""
    hot = F.col("category").isin("heuristic.mega_file", "heuristic.sibling_duplication") | F.col("category").startswith("pack.")
    return found.where(hot).groupBy(F.col("file").alias("relative")).agg(F.min("stage").alias("stage"))
