"""Classifiers: logistic regression and forest; random features; scores of any model."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel
from pyspark.ml.feature import (
    ElementwiseProduct,
    StandardScaler,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.contract import FOREST_SETTINGS
from riskflow.operators.forest import CellForestClassifier
from riskflow.operators.perturb import class_weights

def build_pipeline(
    features: Sequence[str], label: str, estimator: Estimator, standardize: bool = True
) -> Pipeline:
    """Assembler, scaler (mean 0, sample deviation 1) and the estimator."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="features_raw")]
    if standardize:
        stages.append(
            StandardScaler(
                inputCol="features_raw", outputCol="features", withMean=True, withStd=True
            )
        )
    estimator = estimator.copy()
    estimator.set(estimator.getParam("labelCol"), label)
    estimator.set(
        estimator.getParam("featuresCol"), "features" if standardize else "features_raw"
    )
    return Pipeline(stages=[*stages, estimator])


def train_final(pipeline: Pipeline, df: DataFrame) -> PipelineModel:
    """Fit on all rows."""
    return pipeline.fit(df)


def train_logreg(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    max_iter: int = 100,
    balanced: bool = False,
    C: float | None = None,
    standardize: bool = True,
) -> PipelineModel:
    """Logistic regression: plain, or class-balanced with an L2 penalty of strength 1/C.

    The balanced form scales by the population deviation. Its penalty leaves the
    intercept free.
    """
    if not balanced and C is None:
        lr = LogisticRegression(maxIter=max_iter)
        return build_pipeline(features, label, lr, standardize).fit(df)
    n = df.count()
    weighted = class_weights(df, label, "_weight") if balanced else df
    # Balanced weights sum to n, so the penalty per unit of weight is the same either way.
    lr = LogisticRegression(
        featuresCol="features",
        labelCol=label,
        maxIter=max_iter,
        regParam=1.0 / (C * n) if C else 0.0,
        elasticNetParam=0.0,
        standardization=False,
    )
    if balanced:
        lr = lr.setWeightCol("_weight")
    out = "features_scaled" if standardize else "features"
    stages = [VectorAssembler(inputCols=list(features), outputCol="features_raw")]
    if standardize:
        population = math.sqrt(n / (n - 1)) if n > 1 else 1.0
        stages += [
            StandardScaler(inputCol="features_raw", outputCol=out, withMean=True, withStd=True),
            ElementwiseProduct(
                scalingVec=Vectors.dense([population] * len(features)),
                inputCol=out,
                outputCol="features",
            ),
        ]
    else:
        lr = lr.setFeaturesCol("features_raw")
    return Pipeline(stages=[*stages, lr]).fit(weighted)


def train_forest(
    df: DataFrame, features: Sequence[str], label: str, standardize: bool = True, **params
) -> PipelineModel:
    """Random forest with the default settings of the data model unless overridden."""
    return build_pipeline(features, label, forest_estimator(**params), standardize).fit(df)


def forest_estimator(**params) -> CellForestClassifier:
    """Forest whose deep nodes are grown in cells of bounded rows."""
    return CellForestClassifier(**{**FOREST_SETTINGS, **params})


def stage_of(model: PipelineModel, kind: type):
    """The stage of the given type; its position does not matter."""
    found = [s for s in model.stages if isinstance(s, kind)]
    return found[0] if found else None


def feature_importance(
    model: PipelineModel, spark: SparkSession, features: Sequence[str] | None = None
) -> DataFrame:
    """Rows ``(feature, position, importance)`` of a forest, in feature order."""
    forest = stage_of(model, RandomForestClassificationModel)
    names = features or stage_of(model, VectorAssembler).getInputCols()
    values = forest.featureImportances.toArray().tolist()
    return spark.createDataFrame(
        [(n, i, v) for i, (n, v) in enumerate(zip(names, values))],
        "feature string, position int, importance double",
    )


class RandomFourierFeatures(
    Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable
):
    """Map a vector to ``nFeatures`` cosines whose inner products approximate an RBF kernel.

    The directions follow from the seed, so the stage stores only its parameters.
    """

    nFeatures = Param(Params._dummy(), "nFeatures", "number of cosines", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width parameter", TypeConverters.toFloat)
    inputSize = Param(Params._dummy(), "inputSize", "input length", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, inputCol=None, outputCol=None, nFeatures=256, gamma=0.125, inputSize=8, seed=42
    ):
        super().__init__()
        self._setDefault(nFeatures=256, gamma=0.125, inputSize=8, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rng = np.random.default_rng(self.getSeed())
        count, size = self.getOrDefault(self.nFeatures), self.getOrDefault(self.inputSize)
        spread = math.sqrt(2.0 * self.getOrDefault(self.gamma))
        directions = rng.normal(0.0, spread, (size, count))
        phases = rng.uniform(0.0, 2.0 * math.pi, count)
        scale = math.sqrt(2.0 / count)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            x = np.stack(rows.to_numpy())
            return pd.Series(list(scale * np.cos(x @ directions + phases)))

        mapped = project(vector_to_array(F.col(self.getInputCol())))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(mapped))


def score_model(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Model output plus ``score``, the probability of class 1."""
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])

