"""Column statistics and missing-value fills, fitted in one pass over all columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.operators.ranking import exact_quantiles



def present(col: Column) -> Column:
    """Column as double with NaN as missing."""
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


_AGGREGATES = {
    "mean": lambda c: F.avg(c),
    "std": lambda c: F.stddev_samp(c),
    "std_pop": lambda c: F.stddev_pop(c),
    "median": lambda c: F.percentile_approx(c, 0.5, 1000),
    "count": lambda c: F.count(c),
}


def feature_stats(
    df: DataFrame, cols: Sequence[str], stats: Sequence[str] = ("mean", "std", "median")
) -> DataFrame:
    """One row per column with the wanted statistics (``median`` is approximate)."""
    wide = df.agg(
        *[_AGGREGATES[s](present(F.col(c))).alias(f"{c}|{s}") for c in cols for s in stats]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), *[F.col(f"`{c}|{s}`").alias(s) for s in stats]
            )
            for c in cols
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def fit_fill(
    df: DataFrame,
    cols: Sequence[str],
    strategy: str = "mean",
    rel_err: float = 0.001,
    on_empty: str = "raise",
) -> dict[str, float]:
    """Fill value per column: ``mean``, or ``median`` within ``rel_err`` ranks (0 is exact).

    A column without any value raises, or is left out with ``on_empty="skip"``.
    """
    if strategy == "mean":
        row = df.agg(*[F.avg(present(F.col(c))).alias(c) for c in cols]).collect()[0]
        fill = {c: row[c] for c in cols}
    elif strategy == "median" and rel_err > 0:
        doubles = df.select(*[present(F.col(c)).alias(c) for c in cols])
        found = doubles.approxQuantile(list(cols), [0.5], rel_err)
        fill = {c: (q[0] if q else None) for c, q in zip(cols, found)}
    elif strategy == "median":
        exact = {r["feature"]: r["value"] for r in exact_quantiles(df, cols).collect()}
        fill = {c: exact.get(c) for c in cols}
    else:
        raise ValueError(f"unknown strategy {strategy}")
    empty = [c for c, v in fill.items() if v is None]
    if empty and on_empty == "raise":
        raise ValueError("no values to fill from in: " + ", ".join(empty))
    return {c: v for c, v in fill.items() if v is not None}


def apply_fill(df: DataFrame, fill: Mapping[str, float]) -> DataFrame:
    """Replace nulls (and NaN) by the fill values; columns become double first."""
    return df.withColumns(
        {
            c: F.coalesce(present(F.col(c)), F.lit(float(v)))
            for c, v in fill.items()
        }
    )
