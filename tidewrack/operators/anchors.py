"""Places of quotes in files, and packages in sources."""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..shared import maybe_broadcast

#: White space that is no part of a quote at its ends.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"


#: Quotes that meet a file's text at once.
QUOTES = 4_096
_PLACES = "ord long, relative string, start_line int, end_line int, start_column int"


def _places(content: str, quotes: list[dict]) -> Iterator[tuple[int, int, int, int | None]]:
    """(ord, start_line, end_line, start_column) of the quotes that stand in a text, found in one pass."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for q in {x["quote"] for x in quotes}:
        found.add_word(q, q)
    found.make_automaton()
    lines = content.splitlines(keepends=True)
    starts = list(itertools.accumulate(map(len, lines), initial=0))
    ends = [s + len(t.splitlines()[0]) for s, t in zip(starts, lines, strict=False)]
    first: dict[str, int] = {}
    hits: dict[str, tuple[list[int], list[int]]] = {}
    for end, q in found.iter(content):
        at = end - len(q) + 1
        first.setdefault(q, at)
        line = bisect.bisect_right(starts, at) - 1
        if end < ends[line]:
            of, columns = hits.setdefault(q, ([], []))
            if not of or of[-1] != line + 1:
                of.append(line + 1)
                columns.append(at - starts[line] + 1)
    for x in quotes:
        q, hint = x["quote"], x["hint"]
        if q in hits:
            of, columns = hits[q]
            k = bisect.bisect_left(of, hint)
            k = min((j for j in (k - 1, k) if 0 <= j < len(of)), key=lambda j: (abs(of[j] - hint), j))
            yield x["ord"], of[k], of[k], columns[k]
        elif q in first:
            line = content.count("\n", 0, first[q]) + 1
            yield x["ord"], line, line + q.count("\n"), None


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for relative, content, quotes in zip(*(b.column(c) for c in ("relative", "content", "quotes")), strict=True):
            rows += [(o, relative.as_py(), *place) for o, *place in _places(content.as_py(), quotes.as_py())]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["ord", "relative", "start_line", "end_line", "start_column"])


def nearest(issues: DataFrame, files: DataFrame, at_once: int = QUOTES) -> DataFrame:
    """ord, relative, start_line, end_line, start_column: where an issue's quote stands.

    Of the lines that hold the quote the nearest to `line`, first of ties; a quote that no line holds is searched for in the
    whole text. issues: ord, file, line, quote; files: relative, content. A file's quotes are gathered, `at_once` together at most, and its
    text meets them once; quotes of a file that many issues name are dealt out.
    """
    q = issues.withColumn("quote", F.btrim("quote", F.lit(BLANKS))).where("quote <> ''")
    key = F.regexp_replace(F.replace(F.col("file"), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    q = q.select(key.alias("key"), F.struct(F.col("ord").cast("long").alias("ord"), F.coalesce("line", F.lit(1)).alias("hint"), "quote").alias("x"))
    many = q.groupBy(F.col("key").alias("m_key")).agg(F.count("*").alias("n")).where(F.col("n") > at_once)
    blocks = F.coalesce(F.ceil(F.col("n") / at_once), F.lit(1)).cast("int")
    q = q.join(maybe_broadcast(many), F.col("key") == F.col("m_key"), "left").withColumn("block", F.pmod(F.xxhash64("x"), blocks).cast("int"))
    q = q.groupBy("key", "block").agg(F.collect_list("x").alias("quotes"))
    f = files.where(~C.is_unsafe(F.col("relative")) & F.col("content").isNotNull()).select("relative", "content")
    return q.join(f, F.col("key") == F.col("relative")).select("relative", "content", "quotes").mapInArrow(_search, _PLACES)


def stamp(issues: DataFrame, anchors: DataFrame, files: DataFrame) -> DataFrame:
    """issues with line and locationVerified: an anchor verifies; a scanner's line in a known file is trusted."""
    a = anchors.select(F.col("ord").alias("a_ord"), "start_line")
    known = files.select(C.norm_route(F.col("relative")).alias("k_file")).distinct()
    j = issues.join(a, issues.ord == a.a_ord, "left").join(known, C.norm_route(issues.file) == F.col("k_file"), "left")
    scanner = (C.infer_source(F.col("source"), F.col("category")) == "scanner") & F.col("k_file").isNotNull()
    ok = F.col("start_line").isNotNull() | scanner
    return j.withColumns({"line": F.coalesce("start_line", "line"), "locationVerified": F.coalesce(ok, F.lit(False))}).drop("a_ord", "start_line", "k_file")


# Where packages are looked for, and what is said of them.
SKIPPED = (".git", ".hg", ".svn", "node_modules", "vendor", "dist", "build", ".venv", "venv", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", "reports")
TEXT_SUFFIXES = (".py", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".go", ".rb", ".php", ".java", ".kt", ".cs", ".rs", ".swift", ".scala", ".toml", ".cfg", ".ini", ".yml", ".yaml", ".json", ".md", ".txt", ".sh")
TEXT_NAMES = ("Dockerfile", "Makefile", "Pipfile")
FOUND, MISSING = "referenced_in_source", "no_reference_found"
SAYS = (
    ("Package name ", " appears in project source (import/require/text match). This is a usage hint, not reachability."),
    ("No import/require/text match for ", " in scanned source. This does not prove the package is unused or unreachable."),
)


def searchable(files: DataFrame, most: int | None = 400_000) -> DataFrame:
    """Text files of up to so many bytes (None: of any size) outside skipped directories."""
    skipped = F.arrays_overlap(F.split("relative", "/"), F.array(*map(F.lit, SKIPPED)))
    text = F.lower(C.suffix(F.col("relative"))).isin(*TEXT_SUFFIXES) | C.file_name(F.col("relative")).isin(*TEXT_NAMES)
    small = F.lit(True) if most is None else F.octet_length("content") <= most
    return files.where(~skipped & text & small).select("relative", "content")


def usage_hints(issues: DataFrame, files: DataFrame, max_files: int | None = 2_000, most: int | None = 400_000) -> DataFrame:
    """issues with usageHint and usageHintDetail, for package scanners' issues that name a package, else null.

    Files meet packages by a word: the longest word of a name, as it is or as imports write it. Only such pairs are matched
    against the package's pattern. The first max_files files by path are looked at, of up to `most` bytes, as in the reference; None for all.
    """
    wanted = F.col("category").isin("osv", "trivy") & (F.trim(F.coalesce("packageName", F.lit(""))) != "")
    names = issues.where(wanted).select(F.trim("packageName").alias("pkg")).distinct()
    longest = lambda c: F.array_max(F.transform(F.split(c, r"(?U)\W+"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))).getField("w")
    keys = names.select("pkg", F.explode(F.array_distinct(F.array(longest(F.col("pkg")), longest(F.replace("pkg", F.lit("-"), F.lit("_")))))).alias("key")).where("key <> ''")
    f = searchable(files, most)
    f = f if max_files is None else f.orderBy("relative").limit(max_files)
    words = f.select("relative", F.explode(F.array_distinct(F.split("content", r"(?U)\W+"))).alias("word"))
    pairs = words.join(keys, F.col("word") == F.col("key")).select(F.col("relative").alias("p_file"), "pkg").distinct()
    used = f.join(pairs, f.relative == F.col("p_file")).where(F.rlike("content", C.package_patterns(F.col("pkg")))).select(F.col("pkg").alias("used")).distinct()
    j = issues.join(used, F.trim(issues.packageName) == used.used, "left")
    found, quoted = F.col("used").isNotNull(), F.concat(F.lit("'"), F.trim("packageName"), F.lit("'"))
    detail = F.when(found, F.concat(F.lit(SAYS[0][0]), quoted, F.lit(SAYS[0][1]))).otherwise(F.concat(F.lit(SAYS[1][0]), quoted, F.lit(SAYS[1][1])))
    return j.withColumns({"usageHint": F.when(wanted, F.when(found, FOUND).otherwise(MISSING)), "usageHintDetail": F.when(wanted, detail)}).drop("used")
