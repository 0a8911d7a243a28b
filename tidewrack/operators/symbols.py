"""Outlines of source texts: Python's syntax tree, or one pattern a line for other languages."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

# Fixed value: a line of another language that defines something.
DEFINITION = r"^\s*(?:export\s+)?(?:async\s+)?(?:function|def|class|fn|func)\s+([A-Za-z_][\w]*)"
SCHEMA = "relative string, kind string, name string, start_line int, end_line int, at int"


def _of_python(text: str) -> list[tuple]:
    """Classes, their own methods, and functions of a module; nothing of a text that isn't Python."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError):
        return []
    span = lambda x: (x.lineno, x.end_lineno or x.lineno)
    kind = lambda x, name: f"async_{name}" if isinstance(x, ast.AsyncFunctionDef) else name
    defs, out = (ast.FunctionDef, ast.AsyncFunctionDef), []
    for x in body:
        if isinstance(x, defs):
            out.append((kind(x, "function"), x.name, *span(x)))
        elif isinstance(x, ast.ClassDef):
            out.append(("class", x.name, *span(x)))
            out += [(kind(m, "method"), f"{x.name}.{m.name}", *span(m)) for m in x.body if isinstance(m, defs)]
    return out


def outline(relative: str, text: str) -> list[tuple]:
    """(kind, name, first line, last line) in order of the text; a definition of another language is one line."""
    if relative.lower().endswith(".py"):
        return _of_python(text)
    hits = ((k, t, m) for k, t in enumerate(text.splitlines(), 1) if (m := re.match(DEFINITION, t)))
    return [("class" if "class" in t.partition("(")[0] else "function", m[1], k, k) for k, t, m in hits]


def symbols(files: DataFrame, top: int = 48, least: int = 0) -> DataFrame:
    """relative, kind, name, start_line, end_line, n_symbols: the longest `top` of each file, rows of a file in order of lines.

    Files of fewer than `least` lines have none.
    """

    def batches(it):
        for pdf in it:
            rows = [(r, *s, k) for r, t in zip(pdf["relative"], pdf["content"], strict=True) for k, s in enumerate(outline(r, t or ""))]
            yield pd.DataFrame(rows, columns=["relative", "kind", "name", "start_line", "end_line", "at"])

    f = files.where(C.line_count(F.col("content")) >= least) if least else files
    own = Window.partitionBy("relative")
    rank = F.row_number().over(own.orderBy(F.desc(F.col("end_line") - F.col("start_line")), "start_line", "at"))
    d = f.select("relative", "content").mapInPandas(batches, SCHEMA).withColumns({"rank": rank, "n_symbols": F.count("*").over(own)})
    return d.where(F.col("rank") <= top).sortWithinPartitions("relative", "start_line", "at").drop("rank", "at")


def outline_text(files: DataFrame, top: int = 48, least: int = 80) -> DataFrame:
    """relative, text: an outline for each file of `least` lines or more, one line a symbol; what is left out is counted."""
    f = files.select("relative", C.line_count(F.col("content")).alias("lines")).where(F.col("lines") >= least)
    n = F.col("end_line") - F.col("start_line") + 1
    line = F.concat(F.lit("- "), "kind", F.lit(" `"), "name", F.lit("`: lines "), "start_line", F.lit("-"), "end_line", F.lit(" ("), n, F.lit(")"))
    s = symbols(files, top, least).groupBy(F.col("relative").alias("s_file")).agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", line.alias("t")))).alias("ls"), F.max("n_symbols").alias("n"))
    body = F.array_join(F.transform("ls", lambda x: x.getField("t")), "\n")
    more = F.when(F.col("n") > F.size("ls"), F.concat(F.lit("\n"), F.col("n") - F.size("ls"), F.lit(" more"))).otherwise("")
    head = F.concat(F.lit("`"), "relative", F.lit("`, "), "lines", F.lit(" lines"))
    return f.join(s, f.relative == F.col("s_file"), "left").select("relative", F.when(F.col("ls").isNull(), F.concat(head, F.lit(", no symbols"))).otherwise(F.concat(head, F.lit(":\n"), body, more)).alias("text"))
