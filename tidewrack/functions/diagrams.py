"""Mermaid diagrams out of model text: extraction, a pass over the lines that rewrites edges, validity, repair, plain fallback.

A line is a head, an edge, a bare node or nothing that is kept. Edges come out as `a---b` between bare ids, which previews show
alike; labels go. All of it is column expressions over the text's lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import split_lines, strip

MAX, SNIPPET = 8000, 400
# Heads of diagrams, edges that are rewritten, marks of an edge or message, and ends of a line that was cut.
HEADS = ("flowchart", "graph", "sequencediagram")
EDGES = ("-->", "---", "==>", "-.->", "→>", "→")
MARKS = ("-->", "--", "==>", "-.->", "->>", "-->>")
CUT = ("-->", "--", "==>", "-.->")
DOTTED = ("-->", "---", "==>", "-.->")
NORMALISED, REPAIRED, INVALID = "diagram.mermaid_normalized", "diagram.mermaid_repaired", "diagram.mermaid_invalid"

_any = lambda marks: "(?:" + "|".join(map(re.escape, marks)) + ")"
_ID = r"[A-Za-z_](?U:\w)*"


def extract(text: Column) -> Column:
    """The body of the first fence, else the text itself, without an opening fence that never closes."""
    t = strip(F.coalesce(text, F.lit("")))
    fenced = F.regexp_extract_all(t, F.lit(r"(?is)```(?:mermaid)?\s*\n(.*?)```"), F.lit(1))
    odd = strip(F.regexp_replace(strip(F.regexp_replace(t, r"^[^\r\n]*(\r\n|\r|\n|$)", "")), r"```$", ""))
    return F.when(F.size(fenced) > 0, strip(F.get(fenced, F.lit(0)))).when(t.startswith("```"), odd).otherwise(t)


def _head(line: Column) -> Column:
    return F.lower(F.regexp_extract(line, r"^\s*(\S*)", 1))


def bare_id(token: Column) -> Column:
    """A node's id: what stands before a label, or its letters, digits and underscores."""
    t = strip(token)
    labelled = F.regexp_extract(t, rf'^({_ID})\s*[\(\["]', 1)
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[^A-Za-z0-9_]", "_"), "_+", "_"), "^_+|_+$", "")
    safe = F.when((safe == "") | safe.rlike("^[0-9]"), F.concat(F.lit("n_"), safe)).otherwise(safe)
    return F.when(t == "", "n").when(labelled != "", labelled).when(t.rlike(rf"^{_ID}$"), t).otherwise(safe)


def normalise(body: Column) -> Column:
    """Heads as they are, edges between bare ids, bare nodes; other lines go."""
    edge = rf"^\s*(.+?)\s*{_any(EDGES)}\s*(.+?)\s*$"

    def line(x: Column) -> Column:
        s = strip(x)
        is_head = F.lit(False)
        for h in HEADS:
            is_head = is_head | F.lower(s).startswith(h)
        joined = F.concat(bare_id(F.regexp_extract(s, edge, 1)), F.lit("---"), bare_id(F.regexp_extract(s, edge, 2)))
        return F.when(s == "", F.lit(None).cast("string")).when(is_head, s).when(s.rlike(edge), joined).when(s.rlike(rf"^{_ID}$"), s)

    return F.array_join(F.filter(F.transform(split_lines(strip(F.coalesce(body, F.lit("")))), line), lambda x: x.isNotNull()), "\n")


def _bare_dotted(body: Column) -> Column:
    """Some edge has a node with a dot and no label."""
    edge = rf"^\s*(\S+)\s*{_any(DOTTED)}\s*(\S+)\s*$"

    def bad(t: Column) -> Column:
        return ~t.rlike(r"""^[\[\("']""") & ~t.rlike(rf'^{_ID}(\["|\(|\[)') & t.contains(".")

    return F.exists(split_lines(body), lambda x: x.rlike(edge) & (bad(F.regexp_extract(x, edge, 1)) | bad(F.regexp_extract(x, edge, 2))))


def is_valid(body: Column) -> Column:
    """A head, an edge or message, no cut line, no bare dotted node, and a bounded size."""
    t = strip(F.coalesce(body, F.lit("")))
    lines = split_lines(t)
    cut = F.exists(lines, lambda x: x.rlike(rf"{_any(CUT)}\s*$"))
    return (t != "") & (F.length(t) <= MAX) & _head(F.get(lines, F.lit(0))).isin(*HEADS) & ~cut & t.rlike(_any(MARKS)) & ~_bare_dotted(t)


def repair(text: Column) -> Column:
    """The text's diagram without cut lines, with a head if it has none, normalised."""
    lines = F.filter(split_lines(extract(text)), lambda x: ~x.rlike(rf"{_any(CUT)}\s*$"))
    t = strip(F.array_join(lines, "\n"))
    headed = F.lit(False)
    for h in HEADS:
        headed = headed | _head(t).startswith(h)
    return normalise(F.when((t == "") | headed, t).otherwise(F.concat(F.lit("flowchart LR\n"), t)))


def fallback(body: Column, reason: str) -> Column:
    """The diagram as text: why there is none, and what was there."""
    t = strip(F.coalesce(body, F.lit("")))
    snippet = F.when(F.length(t) > SNIPPET, F.concat(F.substring(t, 1, SNIPPET), F.lit("…"))).when(t == "", "(empty)").otherwise(t)
    head = f"Textual diagram (Mermaid unavailable):\n- Reason: {reason}\n- Flow: [problem] → [impact] → [fix options] → [next step]\n- Raw attempt:\n"
    return F.concat(F.lit(head), snippet)


def _result(text: Column, raw: Column, body: Column, mended: Column) -> Column:
    none = F.lit(None).cast("string")
    row = lambda kind, mermaid, textual, note: F.struct(F.lit(kind).alias("kind"), mermaid.alias("mermaid"), textual.alias("textual"), note.alias("note"))
    good = row("mermaid", body, none, F.when(body != raw, NORMALISED))
    fixed = row("mermaid", mended, none, F.lit(REPAIRED))
    told = row("textual", none, fallback(F.coalesce(F.nullif(body, F.lit("")), text), "invalid Mermaid after repair"), F.lit(INVALID))
    return F.when(is_valid(body), good).when(is_valid(mended), fixed).otherwise(told)


def result(text: Column) -> Column:
    """kind (mermaid or textual), mermaid, textual, note of a text's diagram: normalised, else repaired, else told in words."""
    raw = extract(text)
    return _result(text, raw, normalise(raw), repair(text))


def drawn(answers: DataFrame, text: str) -> DataFrame:
    """answers with `diagram`, the result() of a column; what it goes through is worked out once a row."""
    steps = {"raw": extract(F.col("t")), "body": normalise(F.col("raw")), "mended": repair(F.col("t"))}
    d = answers.select(F.struct(*[F.col(f"`{c}`") for c in answers.columns]).alias("row"), F.col(text).alias("t"))
    for name, step in steps.items():
        d = d.withColumn(name, step)
    return d.select("row", _result(F.col("t"), F.col("raw"), F.col("body"), F.col("mended")).alias("diagram")).select("row.*", "diagram")


def diagram(text: Column, otherwise: Column) -> Column:
    """A valid diagram from the text, repaired if need be, else something else."""
    return F.coalesce(result(text).getField("mermaid"), otherwise)
