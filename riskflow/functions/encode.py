"""Encoders from survey text to numbers. Each takes a column and returns a column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_binary(col: Column, positive: str) -> Column:
    """1 where the column equals ``positive``; 0 for anything else, null included."""
    return F.when(col == F.lit(positive), F.lit(1)).otherwise(F.lit(0))


def encode_ordinal(col: Column, levels: Sequence[str], default: int) -> Column:
    """Position of the value in ``levels``; ``default`` for anything else, null included."""
    out = F.when(col == F.lit(levels[0]), F.lit(0))
    for code, level in enumerate(levels[1:], start=1):
        out = out.when(col == F.lit(level), F.lit(code))
    return out.otherwise(F.lit(default))


def encode_map(col: Column, mapping: Mapping[str, float], default: float) -> Column:
    """Dictionary lookup; ``default`` for unknown values and null."""
    literals = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*literals), col), F.lit(default))


def encode_tokens(col: Column, tokens: Sequence[str], numeric: bool = False) -> Column:
    """1.0 where the lower-cased text is one of ``tokens``, else 0.0; numbers pass through."""
    if numeric:
        return F.coalesce(col.cast("double"), F.lit(0.0))
    return F.when(F.lower(col).isin(*tokens), F.lit(1.0)).otherwise(F.lit(0.0))


def encode_contains(
    col: Column, rules: Sequence[tuple[str, float]], default: float, numeric: bool = False
) -> Column:
    """Value of the first fragment found in the lower-cased text; numbers pass through."""
    if numeric:
        return F.coalesce(col.cast("double"), F.lit(default))
    text = F.lower(col)
    out = None
    for fragment, value in rules:
        test = text.contains(fragment)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(default))
