"""Which script a text is written in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import INDIC, SCRIPTS


def _seen(text: Column, names) -> Column:
    block = lambda s: f"[\\x{{{SCRIPTS[s][0]:04X}}}-\\x{{{SCRIPTS[s][1]:04X}}}]"
    return F.array_compact(F.array(*[F.when(text.rlike(block(s)), s) for s in names], F.when(text.rlike("[A-Za-z]"), "LATIN")))


def _named(text: Column, names, none: str) -> Column:
    seen = _seen(text, names)
    return F.when(F.size(seen) == 0, none).when(F.size(seen) == 1, F.element_at(seen, 1)).otherwise("MIXED")


def script_fast(column: Column) -> Column:
    """Eleven scripts and Latin; EMPTY for nothing, OTHER for none of them."""
    text = F.trim(F.coalesce(column, F.lit("")))
    return F.when(text == "", "EMPTY").otherwise(_named(text, SCRIPTS, "OTHER"))


def script_counted(column: Column) -> Column:
    """Nine Indic scripts and Latin; EMPTY for an empty text."""
    text = F.coalesce(column, F.lit(""))
    return F.when(text == "", "EMPTY").otherwise(_named(text, INDIC, "OTHER"))


def script_profile(column: Column) -> Column:
    """As E1, but digits and other characters alone are EMPTY."""
    return _named(F.coalesce(column, F.lit("")), SCRIPTS, "EMPTY")
