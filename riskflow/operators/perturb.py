"""Seeded noise, label flips and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.contract import FLIP_RATE, JITTER_COLUMNS, JITTER_FACTOR, SEED
from riskflow.functions.scalar import seeded_hash, seeded_normal
from riskflow.operators.impute import present
from riskflow.operators.ranking import at_or_before, group_sizes, hash_cutoffs


def gaussian_jitter(
    df: DataFrame,
    cols: Sequence[str] = tuple(JITTER_COLUMNS),
    factor: float = JITTER_FACTOR,
    seed: int = SEED,
    id: str = "id",
) -> DataFrame:
    """Add normal noise of ``factor`` sample deviations to each listed column that exists."""
    found = [c for c in cols if c in df.columns]
    if not found:
        return df
    spread = df.agg(*[F.stddev_samp(present(F.col(c))).alias(c) for c in found]).collect()[0]
    return df.withColumns(
        {
            c: F.col(c).cast("double")
            + F.lit((spread[c] or 0.0) * factor) * seeded_normal(f"{seed}:{c}", id)
            for c in found
        }
    )


def flip_labels(
    df: DataFrame,
    label: str,
    rate: float = FLIP_RATE,
    seed: int = SEED,
    id: str = "id",
    out: str = "flipped",
) -> DataFrame:
    """Flip exactly ``int(rate * n)`` 0/1 labels, those first in seeded hash order.

    Only the last flipped row is looked up; the flip itself is a projection.
    """
    hashed = seeded_hash(f"{seed}:flip", id)
    wanted = int(df.count() * rate)
    cutoff = hash_cutoffs(df, hashed, id, {None: [wanted]})[None][0]
    flip = at_or_before(hashed, id, cutoff)
    return df.withColumn(out, F.when(flip, F.lit(1) - F.col(label)).otherwise(F.col(label)))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weight n / (classes * n_class) on every row; the weights sum to n.

    Rows without a label belong to no class: they are not counted and their weight is null.
    """
    sizes = group_sizes(df, label)
    if sizes is not None:
        sizes.pop(None, None)
        total = sum(sizes.values())
        weight = F.lit(None).cast("double")
        for c, n in sizes.items():
            weight = F.when(F.col(label) == F.lit(c), F.lit(total / (len(sizes) * n))).otherwise(
                weight
            )
        return df.withColumn(out, weight)
    # Too many classes for literals: join the per-class counts instead.
    per_class = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    total = per_class.agg(F.sum("_n"), F.count("*")).collect()[0]
    weights = per_class.select(
        label, (F.lit(float(total[0])) / (F.lit(float(total[1])) * F.col("_n"))).alias(out)
    )
    return df.join(weights, label, "left").select(*df.columns, out)
