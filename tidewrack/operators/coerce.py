"""Model output (JSON text of uncertain shape) to findings, on VARIANT."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _is_object(v: Column) -> Column:
    """True for an object; false for anything else and for null. (A schema would be worked out for all that is in it.)"""
    return F.try_variant_get(v, "$", "struct<_:variant>").isNotNull()


def parse(raw: DataFrame) -> DataFrame:
    """raw with `doc` (VARIANT or null): the text without fences, or else what stands from its first brace to its last."""
    bare = C.strip(F.col("raw"))
    t = F.when(bare.contains("```"), C.strip(F.regexp_replace(F.regexp_replace(bare, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))).otherwise(bare)
    # each step is a column of its own, so that a text is parsed once
    d = raw.withColumn("_whole", F.try_parse_json(t)).withColumn("strict", _is_object(F.col("_whole")))
    d = d.withColumn("_part", F.when(~F.col("strict"), F.regexp_extract("raw", r"(?s)\{.*\}", 0)))
    d = d.withColumn("doc", F.when(F.col("strict"), F.col("_whole")).otherwise(F.try_parse_json(F.when(F.col("_part") != "", F.col("_part")))))
    return d.select(*[c for c in raw.columns if c not in ("doc", "strict")], "doc", "strict")


def reports(parsed: DataFrame) -> DataFrame:
    """parsed with confidence (0 to 100; "72%" is 72), gaps (array) and issues (array of VARIANT), by any of their names."""
    d = F.col("doc")
    conf = F.coalesce(F.try_variant_get(d, "$.confidence", "double"), F.regexp_extract(F.try_variant_get(d, "$.confidence", "string"), r"(\d+)", 1).try_cast("double"))
    lists = [F.try_variant_get(d, f"$.{k}", "array<variant>") for k in ("issues", "findings", "results", "problems")]
    gap = F.try_variant_get(d, "$.gaps", "string")
    gaps = F.coalesce(F.try_variant_get(d, "$.gaps", "array<string>"), F.when(F.trim(gap) != "", F.array(gap)), F.array().cast("array<string>"))
    return parsed.select("*", C.clamp(F.coalesce(conf.cast("int"), F.lit(0))).alias("confidence"), gaps.alias("gaps"), F.coalesce(*lists, F.array().cast("array<variant>")).alias("issues"))


#: Names of a finding's fields, the first with text counts; the names of what wraps it; fields whose presence counts, or that are no texts.
NAMES = {
    "title": ("title", "name", "summary", "heading"), "text": ("explanation", "description", "details", "detail", "rationale", "message"),
    "severity": ("severity", "Severity", "level"), "priority": ("priority",), "any_priority": ("priority", "Priority", "pri"), "category": ("category", "type", "kind", "area"),
    "file": ("file", "path", "filePath", "file_path", "filename", "location"), "impact": ("impact", "risk", "consequence"), "codeExample": ("codeExample", "code_example", "example", "snippet"),
    "recommendedFix": ("recommendedFix", "recommended_fix", "recommendation", "fix", "remediation", "solution"), "fixTiming": ("fixTiming", "fix_timing", "when"), "cwe": ("cwe",), "owasp": ("owasp",),
}
WRAPPERS, LINES = ("issue", "finding", "item"), ("line", "lineNumber", "lineno")
_KEYS = sorted({k for ks in NAMES.values() for k in ks})
#: What is read of an object in one pass each: its texts (names that differ only in case apart), and the values that may be no texts.
_TEXTS = f"struct<{', '.join(f'{k}:string' for k in _KEYS if k[0].islower())}>"
_VALUES = f"struct<{', '.join([*(f'{k}:string' for k in _KEYS if k[0].isupper()), *(f'{k}:variant' for k in (*WRAPPERS, *LINES, *NAMES['impact'], *NAMES['codeExample']))])}>"


def _first(*values: Column) -> Column:
    """First value with text, trimmed; null if none."""
    return F.coalesce(*[F.when(C.strip(v) != "", C.strip(v)) for v in values])


def _wrapped(values: Column) -> Column:
    """The first object under a wrapper's name."""
    return F.coalesce(*[F.when(_is_object(values.getField(k)), values.getField(k)) for k in WRAPPERS])


def _named(found: Column) -> Column:
    """Of an array of findings those (ord, v) that are a string, or have a title or a text."""
    named = ", ".join(f"{k}:string" for k in (*NAMES["title"], *NAMES["text"]))
    both = f"struct<{named}, {', '.join(f'{k}:variant' for k in WRAPPERS)}>"
    has = lambda o: reduce(or_, [F.coalesce(C.strip(o.getField(k)) != "", F.lit(False)) for k in (*NAMES["title"], *NAMES["text"])])
    # one pass over a finding, and over what it wraps, each by a transform of its own
    outer = F.transform(found, lambda v, i: F.struct(i.alias("ord"), v.alias("v"), F.try_variant_get(v, "$", both).alias("o")))
    inner = F.transform(outer, lambda x: F.struct(x.getField("ord").alias("ord"), x.getField("v").alias("v"), x.getField("o").alias("o"), F.try_variant_get(_wrapped(x.getField("o")), "$", f"struct<{named}>").alias("i")))
    return F.filter(inner, lambda x: has(x.getField("o")) | has(x.getField("i")) | (x.getField("o").isNull() & (F.schema_of_variant(x.getField("v")) == "STRING")))


def issues(rep: DataFrame, *keys: str) -> DataFrame:
    """The findings of reports, coerced field by field; what has neither title nor text is dropped. keys: columns to carry."""
    read = lambda v: (F.try_variant_get(v, "$", _TEXTS), F.try_variant_get(v, "$", _VALUES))
    # what is dropped goes within its row: a filter further on would be moved below what it needs, and work all of that out again
    d = rep.select(*keys, F.explode(_named(F.col("issues"))).alias("x")).select(*keys, F.col("x.ord").alias("ord"), F.col("x.v").alias("v0"))
    texts, values = read(F.col("v0"))
    d = d.select("*", texts.alias("t0"), values.alias("a0"))
    d = d.select("*", F.when(F.col("t0").isNull() & (F.schema_of_variant("v0") == "STRING"), C.strip(F.try_variant_get("v0", "$", "string"))).alias("s"), _wrapped(F.col("a0")).alias("v1"))
    texts, values = read(F.col("v1"))
    d = d.select(*keys, "ord", "s", "t0", "a0", texts.alias("t1"), values.alias("a1"))
    # fields beside a wrapper win over those inside it
    at = lambda k, n: F.col(f"{'a' if k[0].isupper() else 't'}{n}").getField(k)
    two = lambda name: _first(*[at(k, n) for n in (0, 1) for k in NAMES[name]])
    no = lambda name: reduce(and_, [F.col(f"a{n}").getField(k).isNull() for n in (0, 1) for k in NAMES[name]])
    line = F.coalesce(*[F.col(f"a{n}").getField(k) for n in (0, 1) for k in LINES])
    d = d.select(*keys, "ord", "s", line.alias("l"), no("impact").alias("no_impact"), no("codeExample").alias("no_example"), *[two(k).alias(f"f_{k}") for k in NAMES])
    title, text = F.coalesce(F.substring("s", 1, 120), "f_title"), F.coalesce("s", "f_text")
    d = d.select("*", title.alias("t"), text.alias("x"), F.coalesce("f_severity", "f_priority").alias("sev"))
    d = d.select("*", C.coerce_severity(F.col("sev")).alias("severity"))
    high = F.col("severity").isin("CRITICAL", "HIGH")
    impact = F.coalesce("f_impact", F.when(high & F.col("no_impact"), "(no impact given: check by hand)"), F.lit(""))
    example = F.coalesce("f_codeExample", F.when(high & F.col("no_example"), "// no example given: check by hand"), F.lit(""))
    return d.select(
        *keys, "ord", "severity", C.coerce_priority(F.col("f_any_priority"), F.col("severity")).alias("priority"), F.coalesce("f_category", F.lit("General")).alias("category"),
        F.coalesce("f_file", F.lit("(unspecified)")).alias("file"), F.when(F.col("l").isNull(), 1).otherwise(C.coerce_line(F.col("l"))).alias("line"),
        F.coalesce("t", F.substring("x", 1, 120)).alias("title"), F.coalesce("x", "t").alias("explanation"), impact.alias("impact"),
        F.coalesce("f_recommendedFix", F.lit("Review and fix by hand.")).alias("recommendedFix"), example.alias("codeExample"),
        C.coerce_timing(F.col("f_fixTiming")).alias("fixTiming"), F.col("f_cwe").alias("cwe"), F.col("f_owasp").alias("owasp"),
    )


def n_issues(found: Column) -> Column:
    """How many findings issues() gives of an array of them."""
    return F.size(_named(found))


# Severities that need no coercion, and the note of an answer that could not be read whole.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
INVALID = "llm.schema_invalid (pass: "


def needs_coercion(parsed: DataFrame) -> DataFrame:
    """parsed (what parse() gives) with `coerced`: no strict object, a confidence in words, a finding that is no object, or another severity."""
    d = F.col("doc")
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    found = F.coalesce(F.try_variant_get(d, "$.issues", "array<variant>"), F.array().cast("array<variant>"))
    odd = F.exists(found, lambda v: ~kind(v).startswith("OBJECT") | ((kind(_get(v, "severity")) == "STRING") & ~F.upper(F.try_variant_get(v, "$.severity", "string")).isin(*SEVERITIES)))
    return parsed.withColumn("coerced", ~F.col("strict") | (kind(_get(d, "confidence")) == "STRING") | F.coalesce(odd, F.lit(False)))


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}\[\],]', re.DOTALL)


def _closed(text: str | None) -> str | None:
    """A JSON object that was cut off, closed after its last whole member or list element at depth two; null if none has begun."""
    if not text or (start := text.find("{")) < 0:
        return None
    open_: list[str] = []
    safe, need = None, ""
    for m in _TOKEN.finditer(text, start):
        t = m[0]
        if t[0] == '"':
            if len(t) < 2 or t[-1] != '"':
                break
            continue
        if t == ",":
            # what stands before a comma is whole
            if len(open_) <= 2:
                safe, need = m.start(), "".join(reversed(open_))
            continue
        if t in "{[":
            open_.append("}" if t == "{" else "]")
            whole = len(open_) == 1 or (len(open_) == 2 and t == "[")
        else:
            if not open_ or open_.pop() != t:
                break
            whole = len(open_) <= 2
        if whole:
            safe, need = m.end(), "".join(reversed(open_))
        if not open_:
            break
    return None if safe is None else text[start:safe] + need


def closed(text: Column) -> Column:
    """The text closed, a batch of answers at a time."""

    @F.pandas_udf("string")
    def close(texts: pd.Series) -> pd.Series:
        return texts.map(_closed, na_action="ignore")

    return close(text)


def salvage(answers: DataFrame) -> DataFrame:
    """answers (pass, raw, error) of a pass's last attempt, degraded: what reports() gives, of the whole text or of what was whole in it, with
    `salvaged` (the text had to be closed) and a gap that tells the error."""
    # only torn texts go to Python, and each is parsed once
    d = parse(answers).withColumn("_mended", F.try_parse_json(closed(F.when(F.col("doc").isNull(), F.col("raw")))))
    d = d.withColumn("salvaged", _is_object(F.col("_mended"))).withColumn("doc", F.coalesce("doc", F.when(F.col("salvaged"), F.col("_mended"))))
    d = reports(d.drop("_mended"))
    note = F.concat(F.lit(INVALID), F.col("pass").cast("string"), F.lit("): "), F.coalesce("error", F.lit("")))
    return d.withColumn("gaps", F.concat("gaps", F.array(note)))


def layers(attempts: DataFrame) -> DataFrame:
    """pass, attempt, layer of the best attempt of each pass: ok, coerced, micro_repair, degraded.

    attempts: pass, attempt (1, 2), valid (parsed and without violations), strict (needed no coercion).
    """
    layer = F.when(F.col("valid") & (F.col("attempt") == 1) & F.col("strict"), "ok").when(F.col("valid") & (F.col("attempt") == 1), "coerced").when(F.col("valid"), "micro_repair").otherwise("degraded")
    best = F.min_by(F.struct("attempt", layer.alias("layer")), F.struct((~F.col("valid")).cast("int"), "attempt"))
    return attempts.groupBy("pass").agg(best.alias("b")).select("pass", "b.*")
