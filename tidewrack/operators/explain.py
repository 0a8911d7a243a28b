"""Predicates on explanations: steps that say nothing, and plans from a mould."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import columns as C
from .prompts import move_of

# Fixed values.
VAGUE = ("into separate module", "update import", "accordingly", "evaluate structure", "consider refactor", "as appropriate")
MOULD = r"(?i)\b(types?_module|ui_module|io_module|localization_module|utils?_module|helpers?_module|common_module)\b"
SHORT, LONG = 48, 180


def is_vague(step: Column, moves: Column) -> Column:
    """A next step without an arrow or a symbol, file or stem of the moves (array of text), that is short or in common phrases.

    A null or blank step is vague; null moves are none.
    """
    t = C.strip(F.coalesce(step, F.lit("")))

    def named(m):
        pair, raw = move_of(m), C.strip(m)
        name = C.file_name(F.replace(pair.getField("target"), F.lit("\\"), F.lit("/")))
        in_pair = C.mentions(t, pair.getField("symbol")) | C.mentions(t, name) | C.mentions(t, F.regexp_replace(name, r"\.py$", ""))
        return F.coalesce(F.when(pair.isNull(), C.mentions(t, raw)).otherwise(in_pair), F.lit(False))

    concrete = F.exists(F.coalesce(moves, F.array().cast("array<string>")), named)
    arrow = t.contains("→") | t.contains("->") | t.contains("=>")
    waffle = C.any_of(F.lower(t), VAGUE) | (F.lower(t).startswith("refactor") & (F.length(t) < LONG)) | (F.length(t) < SHORT)
    return F.when(t == "", True).when(arrow | concrete, False).otherwise(waffle)


def is_boilerplate(texts: Column, titles: Column, n_moves: Column) -> Column:
    """texts: all texts of a plan; titles: those of its solutions; n_moves: moves of all solutions."""
    joined = F.lower(F.array_join(titles, " "))
    empty = joined.contains("split by responsibility") & joined.contains("modularize") & (n_moves == 0)
    return F.coalesce(F.array_join(texts, " ").rlike(MOULD), F.lit(False)) | F.coalesce(empty, F.lit(False))
