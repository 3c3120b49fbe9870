"""Scalar expressions; all are plain columns that stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskflow.contract import (
    RELIABILITY_LOWEST,
    RELIABILITY_TIERS,
    STATUS_HIGH,
    STATUS_SAFE,
)

HASH_BITS = 52
_HEX = HASH_BITS // 4


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Quotient as double; 0.0 where the denominator is zero."""
    return F.when(
        denominator != 0, numerator.cast("double") / denominator.cast("double")
    ).otherwise(F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Round and turn a negative zero into zero, so equal values print alike."""
    return F.round(_col(x), digits) + F.lit(0.0)


def decide(p: Column | str, threshold: float = 0.5) -> Column:
    """1 at or above the threshold, else 0."""
    return (_col(p) >= F.lit(threshold)).cast("int")


def risk_status(p: Column | str, threshold: float = 0.5) -> Column:
    return F.when(_col(p) >= F.lit(threshold), F.lit(STATUS_HIGH)).otherwise(F.lit(STATUS_SAFE))


def percent(p: Column | str) -> Column:
    """Whole percent of a probability, truncated."""
    return F.floor(_col(p) * 100).cast("int")


def risk_components(
    academic_pressure: Column | str = "academic_pressure",
    financial_stress: Column | str = "financial_stress",
    sleep: Column | str = "sleep_duration",
    study_satisfaction: Column | str = "study_satisfaction",
) -> Column:
    """Struct of the four displayed risk shares."""
    return F.struct(
        (_col(academic_pressure) / F.lit(5.0)).alias("ap"),
        (_col(financial_stress) / F.lit(5.0)).alias("fs"),
        ((F.lit(3.0) - _col(sleep)) / F.lit(3.0)).alias("sd"),
        ((F.lit(5.0) - _col(study_satisfaction)) / F.lit(4.0)).alias("ss"),
    )


def reliability_tier(score: Column | str) -> Column:
    out = None
    for bound, name in RELIABILITY_TIERS:
        test = _col(score) > F.lit(bound)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit(RELIABILITY_LOWEST))


def _digest(seed: int | str, *keys: Column | str) -> Column:
    parts = [F.lit(str(seed))] + [_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def _hex_to_long(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def seeded_hash(seed: int | str, *keys: Column | str) -> Column:
    """52-bit hash of the seed and the keys.

    It depends on values only, so it does not change with the number or order of
    partitions, and 52 bits convert to double without loss.
    """
    return _hex_to_long(F.substring(_digest(seed, *keys), 1, _HEX))


def seeded_uniform(seed: int | str, *keys: Column | str) -> Column:
    """Uniform number strictly between 0 and 1."""
    return (seeded_hash(seed, *keys).cast("double") + F.lit(0.5)) / F.lit(float(1 << HASH_BITS))


def seeded_normal(seed: int | str, *keys: Column | str) -> Column:
    """Standard normal number; the Box-Muller pair comes from the two halves of one digest."""
    digest = _digest(seed, *keys)
    scale = F.lit(float(1 << HASH_BITS))
    u1 = (_hex_to_long(F.substring(digest, 1, _HEX)).cast("double") + F.lit(0.5)) / scale
    u2 = (_hex_to_long(F.substring(digest, 1 + _HEX, _HEX)).cast("double") + F.lit(0.5)) / scale
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def poisson_one(u: Column) -> Column:
    """Poisson(1) draw from a uniform number, by inversion of the distribution function.

    The table ends where the tail is below double resolution of the uniform number.
    """
    out = F.when(u < F.lit(math.exp(-1.0)), F.lit(0))
    term = total = math.exp(-1.0)
    for value in range(1, 18):
        term /= value
        total += term
        out = out.when(u < F.lit(total), F.lit(value))
    return out.otherwise(F.lit(18))
