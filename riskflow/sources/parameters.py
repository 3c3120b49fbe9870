"""Model parameters as a one-row JSON record, and fitted pipelines on disk."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import ElementwiseProduct, StandardScalerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.contract import FALLBACK_PARAMETERS, FEATURES, STORED_PARAMETERS
from riskflow.operators.models import feature_importance, stage_of

# Field names of the record; the first four are the logistic form.
SCHEMA = (
    "model string, means array<double>, stds array<double>, coefficients array<double>, "
    "intercept double, features array<string>, knn_k int, metric string, kernel string, "
    "C double, n_support_vectors bigint"
)


@dataclass(frozen=True)
class Params:
    """Scaler and model parameters; arrays follow the order of ``features``."""

    means: list[float]
    stds: list[float]
    coefficients: list[float] | None = None
    intercept: float | None = None
    features: list[str] | None = None
    model: str | None = None
    knn_k: int | None = None
    metric: str | None = None
    kernel: str | None = None
    C: float | None = None
    n_support_vectors: int | None = None

    @property
    def names(self) -> list[str]:
        return self.features or FEATURES


def stored_params() -> Params:
    return Params(**STORED_PARAMETERS, features=FEATURES, model="LR")


def fallback_params() -> Params:
    return Params(**FALLBACK_PARAMETERS, features=FEATURES, model="LR")


def extract_params(model: PipelineModel, **extras) -> Params:
    """Parameters of a fitted pipeline, its stages found by type.

    ``extras`` fills the fields of the neighbour and kernel forms, which have no
    coefficients.
    """
    names = list(stage_of(model, VectorAssembler).getInputCols())
    scaler = stage_of(model, StandardScalerModel)
    if scaler is None:
        means, stds = [0.0] * len(names), [1.0] * len(names)
    else:
        means, stds = scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()
    product = stage_of(model, ElementwiseProduct)
    if product is not None:
        stds = [s / f for s, f in zip(stds, product.getScalingVec().toArray().tolist())]
    values: dict = {"means": means, "stds": stds, "features": names}
    lr = stage_of(model, LogisticRegressionModel)
    if "model" not in extras and lr is not None:
        values |= {
            "model": "LR",
            "coefficients": lr.coefficients.toArray().tolist(),
            "intercept": float(lr.intercept),
        }
    return Params(**{**values, **extras})


def params_to_df(spark: SparkSession, params: Params) -> DataFrame:
    return spark.createDataFrame([asdict(params)], SCHEMA)


def write_params(spark: SparkSession, params: Params, path: str) -> None:
    """Write the record as one JSON line; fields that are not set are left out."""
    params_to_df(spark, params).coalesce(1).write.mode("overwrite").json(path)


def read_params(spark: SparkSession, path: str, default: Params | None = None) -> Params:
    """Read a record; a missing or unusable one gives ``default``, or raises without it."""
    try:
        rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path).limit(1).collect()
    except AnalysisException as e:
        if default is None or "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return default
    if not rows or rows[0]["means"] is None or rows[0]["stds"] is None:
        if default is None:
            raise ValueError(f"no usable parameters in {path}")
        return default
    return Params(**rows[0].asDict())


def publish_params(spark: SparkSession, params: Params, path: str) -> int:
    """Write the record as the next version below ``path``; versions start at 1.

    A version is seen only once it is whole. One writer at a time: two that publish together
    raise or overwrite each other.
    """
    version = (latest_version(spark, path) or 0) + 1
    params_to_df(spark, params).coalesce(1).write.mode("errorifexists").json(f"{path}/version={version}")
    return version


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The highest version below ``path`` that holds a record, or None."""
    try:
        rows = spark.read.schema("version long, means array<double>").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return None
    return rows.where("means is not null").agg({"version": "max"}).collect()[0][0]


def current_params(spark: SparkSession, path: str) -> tuple[int, Params]:
    """The latest version and its record; raises when there is none."""
    version = latest_version(spark, path)
    if version is None:
        raise ValueError(f"no published parameters below {path}")
    return version, read_params(spark, f"{path}/version={version}")


def write_forest_summary(
    spark: SparkSession,
    model: PipelineModel,
    path: str,
    avg_accuracy: float,
    features: Sequence[str] | None = None,
    model_type: str = "Random Forest (Enhanced)",
) -> None:
    """One JSON record with the feature names, their importances and the mean accuracy."""
    forest_summary(spark, model, avg_accuracy, features, model_type).coalesce(1).write.mode(
        "overwrite"
    ).json(path)


def forest_summary(
    spark: SparkSession,
    model: PipelineModel,
    avg_accuracy: float,
    features: Sequence[str] | None = None,
    model_type: str = "Random Forest (Enhanced)",
) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("position", "feature", "importance")))
    return (
        feature_importance(model, spark, features)
        .agg(ordered.alias("r"))
        .select(
            F.lit(model_type).alias("model_type"),
            F.lit(float(avg_accuracy)).alias("avg_accuracy"),
            F.col("r.feature").alias("features"),
            F.col("r.importance").alias("importances"),
        )
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
