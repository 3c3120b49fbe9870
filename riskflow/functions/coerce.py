"""Conversions from raw answers to numbers and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def coerce_numeric(col: Column, strict: bool = False, default: float | None = None) -> Column:
    """Column as double.

    ``strict`` raises on text that is no number; otherwise such text becomes null,
    or ``default`` when one is given (null input takes the default too).
    """
    if strict:
        return col.cast("double")
    number = col.try_cast("double")
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def coerce_label(col: Column, default: int | None = None) -> Column:
    """Column as int, cut toward zero.

    Text that is no number, NaN and numbers beyond the int range become ``default``.
    """
    number = F.nanvl(col.try_cast("double"), F.lit(None).cast("double")).try_cast("int")
    return number if default is None else F.coalesce(number, F.lit(int(default)))


def parse_label(col: Column, truthy: Sequence[str]) -> Column:
    """1 for the given tokens (case-sensitive), 0 for anything else."""
    return F.when(col.cast("string").isin(*truthy), F.lit(1)).otherwise(F.lit(0))
