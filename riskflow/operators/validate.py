"""Cross-validation into one out-of-fold table, and the fold report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.contract import FOLDS
from riskflow.operators.evaluate import auc_exact, binary_metrics, weighted_metrics
from riskflow.operators.folds import fold_split
from riskflow.operators.models import score_model
from riskflow.operators.neighbors import knn_classify
from riskflow.operators.scaling import apply_standardize, fit_standardize
from riskflow.workspace import side_by_side, stage

METRICS = ["accuracy", "precision", "recall", "f1", "auc"]
Trainer = Callable[[DataFrame], PipelineModel]


def cross_validate(
    df: DataFrame,
    trainer: Trainer,
    features: Sequence[str],
    label: str,
    id: str = "id",
    fold: str = "fold",
    k: int = FOLDS,
    fit_scope: str = "train",
    parallelism: int = FOLDS,
) -> DataFrame:
    """Out-of-fold ``id, fold, label, prediction, score`` of every row.

    ``trainer`` gets the rows of the other folds. With ``fit_scope="all"`` the features
    are standardised on all rows beforehand, so the trainer should not scale again. The
    fits are independent and run side by side, ``parallelism`` at a time; each fold's scores
    are written at once, so no more models than that are held.
    """
    if fit_scope not in ("train", "all"):
        raise ValueError(f"unknown fit_scope {fit_scope}")
    slim = stage(df.select(id, fold, label, *features), "folds")
    if fit_scope == "all":
        slim = apply_standardize(slim, fit_standardize(slim, features))

    def one(i: int) -> DataFrame:
        train, test = fold_split(slim, i, fold)
        scored = score_model(trainer(train), test).select(
            id, fold, F.col(label).alias("label"), "prediction", "score"
        )
        return stage(scored, "out-of-fold")

    return reduce(DataFrame.unionByName, side_by_side(df.sparkSession, one, range(k), parallelism))


def cross_validate_knn(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    neighbors: int = 5,
    id: str = "id",
    fold: str = "fold",
    mode: str = "auto",
) -> DataFrame:
    """Out-of-fold nearest-neighbour predictions of all folds in one join.

    The features are standardised on all rows, so the distances are the same for every
    fold; a row's own fold is excluded from its neighbours. A row without any neighbour
    outside its fold stays, with a null score and prediction.
    """
    slim = stage(df.select(id, fold, label, *features), "folds")
    slim = apply_standardize(slim, fit_standardize(slim, features))
    voted = knn_classify(
        slim, slim, neighbors, features, label, id=id, exclude=fold, mode=mode
    )
    truth = slim.select(id, fold, F.col(label).alias("label"))
    return truth.join(voted, id, "left")


def fold_metrics(
    pred: DataFrame,
    averaging: str = "binary",
    fold: str = "fold",
    label: str = "label",
    prediction: str = "prediction",
    score: str = "score",
) -> DataFrame:
    """One row per fold: samples, accuracy, precision, recall, f1, auc.

    ``binary`` reports the positive class, ``weighted`` averages the classes by support,
    ``mixed`` takes precision and recall from the first and F1 from the second.
    """
    if averaging == "binary":
        counts = binary_metrics(pred, label, prediction, fold)
    elif averaging == "weighted":
        counts = weighted_metrics(pred, label, prediction, fold)
    elif averaging == "mixed":
        counts = binary_metrics(pred, label, prediction, fold).drop("f1").join(
            weighted_metrics(pred, label, prediction, fold).select(fold, "f1"), fold
        )
    else:
        raise ValueError(f"unknown averaging {averaging}")
    areas = auc_exact(pred, label, score, fold)
    return counts.join(areas, fold).select(fold, "samples", *METRICS)


def cv_report(
    pred: DataFrame,
    averaging: str = "binary",
    ddof: int = 1,
    fold: str = "fold",
    label: str = "label",
    prediction: str = "prediction",
    score: str = "score",
) -> DataFrame:
    """The fold metrics as rows ``Fold 1 ..``, then ``AVG`` and ``STD`` over the folds.

    ``ddof`` 1 gives the sample deviation, 0 the population one. The summary rows have no
    sample count.
    """
    per_fold = fold_metrics(pred, averaging, fold, label, prediction, score)
    named = F.concat(F.lit("Fold "), (F.col(fold) + 1).cast("string"))
    keyed = per_fold.select(
        F.explode(F.array(named, F.lit("AVG"), F.lit("STD"))).alias("fold"), "samples", *METRICS
    )
    spread = F.stddev_samp if ddof == 1 else F.stddev_pop
    summary = F.col("fold").isin("AVG", "STD")
    return keyed.groupBy("fold").agg(
        F.sum(F.when(~summary, F.col("samples"))).alias("samples"),
        *[
            F.when(F.col("fold") == "STD", spread(m)).otherwise(F.avg(m)).alias(m)
            for m in METRICS
        ],
    )
