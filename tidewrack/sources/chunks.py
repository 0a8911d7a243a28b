"""Captured lines of a streamed model answer, in two dialects.

A line is `data:` and a JSON object. `choices` has the text in choices[0].delta.content, `blocks` in delta.text of
content_block_delta events of text_delta. Other lines, other JSON and `[DONE]` give null, as does a text that is no string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def _string(doc: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(doc, path, "variant")) == "STRING", F.try_variant_get(doc, path, "string"))


def piece(line: Column, dialect: str) -> Column:
    """The text that a line adds, else null."""
    t = C.strip(line)
    doc = F.when(t.startswith("data:"), F.try_parse_json(C.strip(F.substring(t, F.lit(6), F.length(t)))))
    if dialect == "choices":
        return _string(doc, "$.choices[0].delta.content")
    if dialect != "blocks":
        raise ValueError(f"unknown dialect: {dialect}")
    is_text = (_string(doc, "$.type") == "content_block_delta") & (_string(doc, "$.delta.type") == "text_delta")
    return F.when(is_text, _string(doc, "$.delta.text"))


def fold(lines: DataFrame, dialect: str, deadline: float | None = None) -> DataFrame:
    """answer, text, status (ok, empty, late) of each answer. lines: answer, ord, line, seconds (since the answer was asked for).

    The deadline is of wall-clock time, not of silence: an answer with a later line is late, whatever came before.
    """
    got = lines.select("answer", "ord", piece(F.col("line"), dialect).alias("p"), (F.lit(deadline is not None) & (F.col("seconds") > F.lit(deadline or 0.0))).alias("late"))
    pieces = F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("ord", "p"))))
    one = got.groupBy("answer").agg(F.array_join(F.transform(pieces, lambda x: x.getField("p")), "").alias("text"), F.bool_or(F.coalesce("late", F.lit(False))).alias("late"))
    return one.select("answer", "text", F.when(F.col("late"), "late").when(F.col("text") == "", "empty").otherwise("ok").alias("status"))
