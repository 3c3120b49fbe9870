"""The end-to-end flows: train and export, export a saved model, evaluate a formula,
and the five cross-validated experiments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow import contract as C
from riskflow.functions.coerce import parse_label
from riskflow.functions.scalar import decide
from riskflow.operators.bootstrap import bootstrap_metrics, bootstrap_report, reliability_score
from riskflow.operators.columns import (
    BILINGUAL_SPEC,
    LENIENT_SPEC,
    TRAINING_SPEC,
    EncoderSpec,
    drop_columns,
    encode_survey,
    numeric_features,
    prepare_survey,
    resolve_features,
    short_names,
)
from riskflow.operators.folded_logreg import cross_validate_logreg
from riskflow.operators.folds import fold_split, ordered_folds, random_folds, stratified_folds
from riskflow.operators.impute import apply_fill, fit_fill
from riskflow.operators.kernel_machine import KernelMachineModel, train_rbf_svm
from riskflow.operators.models import (
    build_pipeline,
    forest_estimator,
    stage_of,
    train_final,
    train_forest,
    train_logreg,
)
from riskflow.operators.perturb import flip_labels, gaussian_jitter
from riskflow.operators.scaling import Moments, apply_standardize, fit_standardize
from riskflow.operators.scoring import score_params
from riskflow.operators.validate import cross_validate, cross_validate_knn, cv_report
from riskflow.sources.parameters import (
    Params,
    extract_params,
    fallback_params,
    load_model,
    read_params,
    save_model,
    write_params,
)
from riskflow.sources.survey import read_survey, read_survey_lenient
from riskflow.workspace import stage


def clean(
    survey: DataFrame,
    strategy: str = "mean",
    rel_err: float = 0.001,
    spec: EncoderSpec = TRAINING_SPEC,
    label: str = C.LABEL,
    label_default: int | None = None,
) -> DataFrame:
    """Encoded survey with doubles for features, an int label and no missing numbers."""
    named = short_names(survey)
    prepared = prepare_survey(named, spec, label=label, label_default=label_default)
    features = resolve_features(prepared)
    return apply_fill(prepared, fit_fill(prepared, features, strategy, rel_err))


def train_and_export(
    spark: SparkSession, csv: str, params_path: str, model_path: str | None = None
) -> Params:
    """Read a survey, fit the logistic model on all rows, write its parameters."""
    df = clean(read_survey(spark, csv))
    model = train_logreg(df, resolve_features(df), C.LABEL)
    params = extract_params(model)
    write_params(spark, params, params_path)
    if model_path:
        save_model(model, model_path)
    return params


def export_saved_model(spark: SparkSession, model_path: str, params_path: str) -> Params:
    """Write the parameters of a saved pipeline."""
    params = extract_params(load_model(model_path))
    write_params(spark, params, params_path)
    return params


def lenient_scored(raw: DataFrame, params: Params) -> DataFrame:
    """Score rows of text as the evaluation does: tolerant parsing, defaults for bad numbers."""
    named = short_names(raw)
    encoded = numeric_features(
        encode_survey(named, LENIENT_SPEC), C.NUMERIC_FEATURES, defaults=C.NUMERIC_DEFAULTS
    )
    labelled = encoded.withColumn(C.LABEL, parse_label(F.col(C.LABEL), C.TRUTHY_LABELS))
    scored = score_params(labelled, params, zero_std="one")
    return scored.withColumn("prediction", decide("probability"))


def evaluate_formula(
    spark: SparkSession,
    csv: str,
    params_path: str,
    replicates: int = C.REPLICATES,
    seed: int = C.SEED,
) -> tuple[DataFrame, DataFrame]:
    """Bootstrap report and reliability score of stored parameters on a survey file."""
    params = read_params(spark, params_path, default=fallback_params())
    scored = lenient_scored(read_survey_lenient(spark, csv), params)
    reps = bootstrap_metrics(scored, C.LABEL, "prediction", replicates, seed)
    report = bootstrap_report(reps)
    return report, reliability_score(report)


@dataclass(frozen=True)
class Experiment:
    """What an experiment leaves: per-row out-of-fold predictions and the fold report."""

    features: list[str]
    data: DataFrame
    predictions: DataFrame
    report: DataFrame


def logreg_experiment(survey: DataFrame, id: str = "id", k: int = C.FOLDS) -> Experiment:
    """Logistic regression on random folds, all folds fitted together."""
    df = random_folds(clean(survey), k, id=id)
    features = resolve_features(df)
    pred = cross_validate_logreg(df, features, C.LABEL, id, k=k)
    return Experiment(features, df, pred, cv_report(pred, averaging="mixed", ddof=1))


def perturbed(survey: DataFrame, id: str = "id", drop: Sequence[str] = ()) -> DataFrame:
    """The noisy task: bilingual encoding, jittered features, a few flipped labels.

    Every column that is not dropped is a feature; text that is no number counts as
    missing.
    """
    named = short_names(survey)
    kept = drop_columns(named, [c for c in [*C.IGNORED_COLUMNS, *drop] if c != id])
    features = [c for c in kept.columns if c not in (id, C.LABEL)]
    prepared = prepare_survey(kept, BILINGUAL_SPEC, features, label_default=0)
    filled = apply_fill(prepared, fit_fill(prepared, features, "mean"))
    # Several passes follow, so the cleaned rows are written once.
    noisy = stage(gaussian_jitter(filled, id=id), "perturbed")
    return flip_labels(noisy, C.LABEL, id=id)


def balanced_logreg_experiment(survey: DataFrame, id: str = "id", k: int = C.FOLDS) -> Experiment:
    """Class-balanced, penalised logistic regression on the noisy task, stratified folds."""
    noisy = perturbed(survey, id)
    df = stratified_folds(noisy, "flipped", k, id=id)
    features = [c for c in noisy.columns if c not in (id, C.LABEL, "flipped")]
    pred = cross_validate_logreg(df, features, "flipped", id, k=k, balanced=True, C=1.0)
    return Experiment(features, df, pred, cv_report(pred, averaging="binary", ddof=1))


def forest_experiment(
    survey: DataFrame, id: str = "id", k: int = C.FOLDS, **settings
) -> Experiment:
    """Random forest on folds taken in order of age, medians for missing numbers."""
    df = ordered_folds(clean(survey, "median"), "age", id, k)
    features = resolve_features(df)
    trainer = partial(train_forest, features=features, label=C.LABEL, **settings)
    # One forest keeps all cores busy and is large, so the folds follow each other.
    pred = cross_validate(df, trainer, features, C.LABEL, id, k=k, parallelism=1)
    return Experiment(features, df, pred, cv_report(pred, averaging="weighted", ddof=0))


def knn_experiment(
    survey: DataFrame, id: str = "id", k: int = C.FOLDS, neighbors: int = 5, mode: str = "auto"
) -> Experiment:
    """Nearest neighbours on folds taken in order of age."""
    df = ordered_folds(clean(survey), "age", id, k)
    features = resolve_features(df)
    pred = cross_validate_knn(df, features, C.LABEL, neighbors, id, mode=mode)
    pred = stage(pred, "out-of-fold")
    return Experiment(features, df, pred, cv_report(pred, averaging="weighted", ddof=0))


def svm_experiment(survey: DataFrame, id: str = "id", k: int = C.FOLDS, **settings) -> Experiment:
    """Kernel machine on folds taken in order of age; scaled on all rows."""
    df = ordered_folds(clean(survey), "age", id, k)
    features = resolve_features(df)
    trainer = partial(
        train_rbf_svm, features=features, label=C.LABEL, standardize=False, id=id, **settings
    )
    pred = cross_validate(df, trainer, features, C.LABEL, id, k=k, fit_scope="all")
    return Experiment(features, df, pred, cv_report(pred, averaging="weighted", ddof=0))


def final_logreg(experiment: Experiment) -> PipelineModel:
    estimator = LogisticRegression(maxIter=100)
    return train_final(build_pipeline(experiment.features, C.LABEL, estimator), experiment.data)


def final_forest(experiment: Experiment, **settings) -> PipelineModel:
    forest = forest_estimator(**settings)
    return train_final(build_pipeline(experiment.features, C.LABEL, forest), experiment.data)


def _scaler(experiment: Experiment) -> Moments:
    return fit_standardize(experiment.data, experiment.features)


def knn_params(experiment: Experiment, neighbors: int = 5) -> Params:
    """The neighbour form of the parameter record."""
    m = _scaler(experiment)
    return Params(
        list(m.means), list(m.stds), features=list(m.features), model="KNN",
        knn_k=neighbors, metric="euclidean",
    )


def last_fold_support(experiment: Experiment, k: int = C.FOLDS, **settings) -> int:
    """Support vectors (non-zero multipliers) of the model that left out the last fold."""
    features = experiment.features
    scaled = apply_standardize(experiment.data, _scaler(experiment))
    train, _ = fold_split(scaled, k - 1)
    model = train_rbf_svm(
        train, features, C.LABEL, standardize=False, calibration_folds=0, **settings
    )
    return sum(stage_of(model, KernelMachineModel).support_counts())


def svm_params(experiment: Experiment, n_support: int, C_value: float = 1.0) -> Params:
    """The kernel-machine form of the parameter record."""
    m = _scaler(experiment)
    return Params(
        list(m.means), list(m.stds), features=list(m.features), model="SVM",
        kernel="rbf", C=C_value, n_support_vectors=n_support,
    )

