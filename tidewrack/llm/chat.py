"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

Main path: DataFrame functions only.

The machine's states are the start and the role of the turn before; a role names the states that it may follow, and the
template the states in which a conversation may end. A wrong turn is reported (`valid`, `first_fault`), and formatted like any
other: nothing is lost. Inside texts and roles a control string gets a backslash after its first character, one with k
backslashes there gets one more; no raw control string is left in them, and taking one off each gives the text back.

Defined cases: turns come in order of turn (nulls first), equal turns by role, then text; a null role or text is an empty one;
rows without conv_id are one conversation; a role that the template lacks is written out between marks of its own, bears no
loss and is a wrong turn; repeated rows are turns each; an empty table gives an empty one; columns other than conv_id, turn,
role and text play no part. A conversation is one row of the output, as its text is one string.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, last, table

START = ""


@dataclass(frozen=True)
class Turn:
    """Marks around a role's text, the states that it may follow (START or a role), and whether its text bears loss."""

    open: str
    close: str
    after: tuple[str, ...]
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """begin: what a conversation starts with; other: marks around the name and the text of any other role; controls: strings
    that only marks may hold, of which none holds its first character again, or a backslash."""

    begin: str
    roles: dict[str, Turn]
    other: tuple[str, str, str]
    ends: tuple[str, ...]
    controls: tuple[str, ...]
    closers: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "closers", (*(t.close for t in self.roles.values()), self.other[2]))
        for c in self.controls:
            if len(c) < 2 or c[0] in c[1:] or "\\" in c:
                raise ValueError(f"{c!r} can't be escaped")
        firsts = {c[0] for c in self.controls}
        if any(f in c[1:] for f in firsts for c in self.controls):
            raise ValueError("a control string holds the first character of another one")
        held = lambda mark: sum(mark.count(c) for c in self.controls)
        marks = [self.begin, *self.closers, *self.other[:2], *(t.open for t in self.roles.values() if t.open)]
        if any(held(m) != 1 or sum(m.count(f) for f in firsts) != 1 for m in marks) or [t.open for t in self.roles.values()].count("") > 1:
            raise ValueError("a mark holds one control string, and one role at most has no opening mark")
        shut = [next(c for c in self.controls if c in m) for m in self.closers]
        opened = [next(c for c in self.controls if c in m) for m in marks if m not in self.closers]
        if set(shut) & set(opened) or len(set(opened)) < len(opened):
            raise ValueError("opening marks must differ, from each other and from closing ones")


#: Turns of a dialogue in the form of instruction-tuned models.
INSTRUCT = Template(
    begin="<s>",
    roles={
        "system": Turn("[SYS] ", " [/SYS]", (START,)),
        "user": Turn("[INST] ", " [/INST]", (START, "system", "assistant")),
        "assistant": Turn("", "</s>", ("user",), loss=True),
    },
    other=("[ROLE]", "[TEXT] ", " [/TURN]"),
    ends=("assistant",),
    controls=("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/TURN]"),
)


def _rests(template: Template) -> dict[str, str]:
    """For each first character of controls, a pattern of what may follow it."""
    out: dict[str, list[str]] = {}
    for c in template.controls:
        out.setdefault(re.escape(c[0]), []).append(re.escape(c[1:]))
    return {f: f"(?:{'|'.join(rests)})" for f, rests in out.items()}


def escape(text: Column, template: Template = INSTRUCT) -> Column:
    """One backslash more after the first character of each control string."""
    return reduce(lambda t, x: F.regexp_replace(t, rf"({x[0]})(\\*{x[1]})", r"$1\\$2"), _rests(template).items(), text)


def unescape(text: Column, template: Template = INSTRUCT) -> Column:
    return reduce(lambda t, x: F.regexp_replace(t, rf"({x[0]})\\(\\*{x[1]})", "$1$2"), _rests(template).items(), text)


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def segments(convs: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """A row for each turn: conv_id, nth (from 1), role, ok (the machine takes it), segments (array of text and loss)."""
    d = convs.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    d = d.select("conv_id", "role", "text", F.row_number().over(order).alias("nth"), F.lag("role").over(order).alias("before"))
    step = lambda a, r: (F.col("role") == r) & (F.col("before").isNull() if a == START else F.col("before").eqNullSafe(a))
    ok = _any(step(a, r) for r, t in template.roles.items() for a in t.after)
    part = lambda text, loss=False: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    lit, text = lambda x: part(F.lit(x)), escape(F.col("text"), template)
    a, b, c = template.other
    parts = F.array(lit(a), part(escape(F.col("role"), template)), lit(b), part(text), lit(c))
    for r, t in template.roles.items():
        parts = F.when(F.col("role") == r, F.array(lit(t.open), part(text, t.loss), lit(t.close))).otherwise(parts)
    begin = F.when(F.col("nth") == 1, F.array(lit(template.begin))).otherwise(F.array().cast("array<struct<text:string,loss:boolean>>"))
    return d.select("conv_id", "nth", "role", ok.alias("ok"), F.filter(F.concat(begin, parts), lambda x: x.getField("text") != "").alias("segments"))


def formatted(convs: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """A row for each conversation: conv_id, segments, valid, first_fault (number of the first wrong turn; null if none)."""
    d = segments(convs, template).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("nth", "segments"))).alias("turns"), F.max_by("role", "nth").alias("end"), F.min(F.when(~F.col("ok"), F.col("nth"))).alias("first_fault")
    )
    valid = F.col("first_fault").isNull() & F.col("end").isin(*template.ends)
    return d.select("conv_id", F.flatten(F.col("turns.segments")).alias("segments"), valid.alias("valid"), "first_fault")


def read_back(out: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, turns (array of role and text), loss_text, formatted: from the segments' texts by the template's marks, and
    from the segments under the loss mask."""
    whole = F.array_join(F.col("segments.text"), "")
    loss = unescape(F.array_join(F.transform(F.filter("segments", lambda x: x.getField("loss")), lambda x: x.getField("text")), ""), template)
    # a turn ends with its closing mark, which no text holds
    after = F.split(F.substr("formatted", F.lit(len(template.begin) + 1)), "(?<=" + "|".join(re.escape(c) for c in template.closers) + ")")
    a, b, c = template.other

    def turn(x: Column) -> Column:
        between = lambda lo, hi: F.substr(x, F.lit(lo + 1), F.length(x) - (lo + hi))
        pair = lambda role, text: F.struct(role.alias("role"), unescape(text, template).alias("text"))
        at = F.instr(x, b)
        out = F.when(x.startswith(a), pair(unescape(F.substr(x, F.lit(len(a) + 1), at - (len(a) + 1)), template), F.substr(x, at + len(b), F.length(x) - at - len(b) - len(c) + 1)))
        for r, t in sorted(template.roles.items(), key=lambda x: -len(x[1].open)):
            out = out.when(x.startswith(t.open), pair(F.lit(r), between(len(t.open), len(t.close))))
        return out

    d = out.select("conv_id", "valid", "first_fault", whole.alias("formatted"), loss.alias("loss_text"))
    return d.select("conv_id", "valid", "first_fault", "formatted", "loss_text", F.transform(F.filter(after, lambda x: x != ""), turn).alias("turns"))


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1, which holds the template's own control strings."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = cut(formatted(convs.unionByName(probe(spark))), "chats")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x.getField("role"), F.lit("\n"), x.getField("text"), F.lit("\n"))), "")
    d = read_back(out).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", F.col("first_fault").cast("long").alias("first_fault"),
    )
    return last(d, "chat_digests", out)


_CONTROL = r"(<\\*/?s>|\[\\*/?(INST|SYS)\]|\[\\*(ROLE|TEXT|/TURN)\])"
OP11_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
o AS (SELECT *, row_number() OVER w AS nth, lag(role) OVER w AS before,
        length(text) + len(regexp_extract_all(text, '{_CONTROL}')) AS chars, length(role) + len(regexp_extract_all(role, '{_CONTROL}')) AS role_chars
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN role = 'system' THEN before IS NULL WHEN role = 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                     WHEN role = 'assistant' THEN coalesce(before = 'user', false) ELSE false END AS ok,
        chars + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 21 + role_chars END AS n FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n))::BIGINT AS formatted_chars, coalesce(min(nth) FILTER (NOT ok), 0) = 0 AND arg_max(role, nth) = 'assistant' AS valid, min(nth) FILTER (NOT ok) AS first_fault
FROM f GROUP BY conv_id
"""
