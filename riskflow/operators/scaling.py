"""Feature vectors and standardisation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.operators.impute import present


@dataclass(frozen=True)
class Moments:
    """Mean and standard deviation per feature: two numbers each, held on the driver."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(zip(self.features, self.means, self.stds)),
            "feature string, mean double, std double",
        )


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features_raw") -> DataFrame:
    """Columns as one vector; a null raises."""
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def fit_standardize(df: DataFrame, cols: Sequence[str], ddof: int = 1) -> Moments:
    """Moments of all columns in one aggregate; ``ddof`` 1 is sample, 0 population."""
    spread = F.stddev_samp if ddof == 1 else F.stddev_pop
    row = df.agg(
        *[F.avg(present(F.col(c))).alias(f"m{i}") for i, c in enumerate(cols)],
        *[spread(present(F.col(c))).alias(f"s{i}") for i, c in enumerate(cols)],
    ).collect()[0]
    n = len(cols)
    return Moments(tuple(cols), tuple(row[:n]), tuple(row[n:]))


def z_score(col: Column, mean: float, std: float | None, zero_std: str = "zero") -> Column:
    """(x - mean) / std. A zero std gives 0, or x - mean with ``zero_std="one"``."""
    if std is None or std == 0:
        return F.lit(0.0) if zero_std == "zero" else col.cast("double") - F.lit(float(mean))
    return (col.cast("double") - F.lit(float(mean))) / F.lit(float(std))


def apply_standardize(
    df: DataFrame, moments: Moments, zero_std: str = "zero", suffix: str = ""
) -> DataFrame:
    """Replace the features by z-scores, or add them under a suffix."""
    return df.withColumns(
        {
            f"{c}{suffix}": z_score(F.col(c), m, s, zero_std)
            for c, m, s in zip(moments.features, moments.means, moments.stds)
        }
    )
