"""Regular-expression matches with offsets, as an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import higher, running_totals

MATCH = "struct<start:int,end:int,value:string>"


def find_matches(text: Column, pattern: str, hint: Column | None = None) -> Column:
    """``array<struct<start,end,value>>``: leftmost non-overlapping matches, offsets in code points, half open.

    Neither the split nor the extraction gives positions; together they do: match i ends after gaps 0..i and matches
    0..i. ``pattern`` must not match the empty string. Null texts give null. ``hint`` is a cheap condition that every
    text with a match meets; other texts are not searched.
    """
    nothing = F.array().cast(f"array<{MATCH}>")
    searched = F.when(text.rlike(pattern), positioned(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), text, pattern)).otherwise(nothing)
    return F.when(text.isNull(), None).when(F.lit(True) if hint is None else hint, searched).otherwise(nothing)


def positioned(hits: Column, text: Column, pattern: str) -> Column:
    """The matches ``hits`` of ``pattern`` in ``text`` with their offsets."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    ends = running_totals(higher("zip_with", gaps, hits, "(g, h) -> char_length(g) + char_length(h)"))
    return higher("zip_with", ends, hits, f"(e, h) -> cast(named_struct('start', e - char_length(h), 'end', e, 'value', h) AS {MATCH})")
