"""Trained models, their parameters on disk, and scoring from parameters."""

import json
from functools import partial

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskflow import contract as C
from riskflow.functions.scalar import seeded_normal
from riskflow.operators.evaluate import auc_exact
from riskflow.operators.folds import random_folds
from riskflow.operators.kernel_machine import KernelMachineModel, fit_platt, rbf, train_rbf_svm
from riskflow.operators.models import (
    build_pipeline,
    feature_importance,
    score_model,
    stage_of,
    train_final,
    train_forest,
    train_logreg,
)
from riskflow.operators.scoring import score_params, score_requests
from riskflow.operators.validate import cross_validate, cross_validate_knn
from riskflow.sources.parameters import (
    Params,
    extract_params,
    fallback_params,
    load_model,
    params_to_df,
    read_params,
    save_model,
    stored_params,
    write_forest_summary,
    write_params,
)


@pytest.fixture(scope="module")
def linear(spark):
    x = [seeded_normal(f"x{i}", "id") for i in range(3)]
    df = spark.range(400).withColumns({f"x{i}": v for i, v in enumerate(x)})
    margin = F.col("x0") * 1.5 - F.col("x1") + seeded_normal("e", "id") * 0.8 - 0.7
    return df.withColumn("y", (margin > 0).cast("int")).cache()


XS = ["x0", "x1", "x2"]


def _gradient(df, model, weight="w"):
    """Mean gradient of the log-loss in the standardised features and the intercept."""
    scored = score_model(model, df).toPandas()
    params = extract_params(model)
    z = (scored[XS].to_numpy() - params.means) / np.array(params.stds)
    gap = (scored["score"] - scored["y"]).to_numpy()
    w = scored[weight].to_numpy() if weight in scored else np.ones(len(gap))
    return (w * gap) @ z / len(gap), (w * gap).mean(), np.array(params.coefficients)


def test_plain_logistic_is_at_its_optimum(linear):
    slope, level, _ = _gradient(linear, train_logreg(linear, XS, "y"))
    assert np.abs(slope).max() < 1e-4 and abs(level) < 1e-4


def test_balanced_penalised_logistic_is_at_its_optimum(linear):
    model = train_logreg(linear, XS, "y", max_iter=1000, balanced=True, C=1.0)
    n1 = linear.filter("y = 1").count()
    weighted = linear.withColumn(
        "w", F.when(F.col("y") == 1, 400 / (2 * n1)).otherwise(400 / (2 * (400 - n1)))
    )
    slope, level, beta = _gradient(weighted, model)
    assert np.abs(slope + beta / 400).max() < 1e-4 and abs(level) < 1e-4


def test_balanced_form_scales_by_the_population_deviation(linear):
    params = extract_params(train_logreg(linear, XS, "y", balanced=True, C=1.0))
    want = linear.agg(*[F.stddev_pop(c) for c in XS]).collect()[0]
    assert params.stds == pytest.approx(list(want))


def test_parameters_reproduce_the_model(spark, linear, tmp_path):
    for kind in ({}, {"balanced": True, "C": 1.0}):
        model = train_logreg(linear, XS, "y", **kind)
        path = str(tmp_path / f"params{len(kind)}")
        write_params(spark, extract_params(model), path)
        both = score_params(score_model(model, linear), read_params(spark, path))
        gap = both.agg(F.max(F.abs(F.col("score") - F.col("probability")))).collect()[0][0]
        assert gap < 1e-9


def test_saved_model_scores_the_same(spark, linear, tmp_path):
    pipeline = build_pipeline(XS, "y", LogisticRegression())
    model = train_final(pipeline, linear)
    for _ in range(2):
        save_model(model, str(tmp_path / "model"))
    back = load_model(str(tmp_path / "model"))
    assert extract_params(back) == extract_params(model)


def test_parameter_file_forms(spark, tmp_path):
    legacy = tmp_path / "params.json"
    legacy.write_text(json.dumps(C.STORED_PARAMETERS))
    assert read_params(spark, str(legacy)).coefficients == C.STORED_PARAMETERS["coefficients"]
    legacy.write_text(json.dumps({"model": "KNN", "knn_k": 5, "metric": "euclidean",
                                  "features": ["a"], "means": [1.0], "stds": [2.0]}, indent=2))
    knn = read_params(spark, str(legacy))
    assert (knn.model, knn.knn_k, knn.features, knn.coefficients) == ("KNN", 5, ["a"], None)
    df = spark.createDataFrame([(1.0,)], "a double")
    with pytest.raises(ValueError, match="KNN"):
        score_params(df, knn)
    svm = Params([1.0], [2.0], features=["a"], model="SVM", kernel="rbf", C=1.0,
                 n_support_vectors=7)
    write_params(spark, svm, str(tmp_path / "svm"))
    assert read_params(spark, str(tmp_path / "svm")) == svm
    text = next((tmp_path / "svm").glob("*.json")).read_text()
    assert "coefficients" not in json.loads(text)


def test_parameter_fallback(spark, tmp_path):
    missing, broken = str(tmp_path / "none"), tmp_path / "broken.json"
    broken.write_text("{not json")
    assert read_params(spark, missing, fallback_params()) == fallback_params()
    assert read_params(spark, str(broken), fallback_params()) == fallback_params()
    with pytest.raises(Exception):
        read_params(spark, missing)
    with pytest.raises(ValueError):
        read_params(spark, str(broken))
    assert params_to_df(spark, stored_params()).count() == 1


def test_formula_by_hand(spark):
    row = (20.0, 3.0, 3.0, 3.0, 3.0, 1.0, 0.5, 0.5)
    df = spark.createDataFrame([row], ", ".join(f"{c} double" for c in C.FEATURES))
    p = score_params(df, fallback_params()).collect()[0].probability
    assert p == pytest.approx(1 / (1 + np.exp(1.5)))


def test_requests_with_errors(spark):
    rows = [("1", "21", "3.1", "3", "4", "2", "5-6 hours", "Male", "Yes"),
            ("2", "old", "3.1", "3", "4", None, "5-6 hours", "Male", "Yes"),
            ("3", "21", "3.1", "3", "4", "2", "unknown", None, None)]
    df = spark.createDataFrame(rows, ["id", "age", "cgpa", "ap", "ss", "fs", "sd", "gender", "fh"])
    got = {r.id: r for r in score_requests(df, stored_params()).collect()}
    assert got["1"].error is None and 0 < got["1"].probability < 1
    assert got["1"].risk.asDict() == pytest.approx({"ap": 0.6, "fs": 0.4, "sd": 2 / 3, "ss": 0.25})
    assert got["2"].probability is None and got["2"].status is None
    assert got["2"].error == "no number in age; no number in financial_stress"
    assert got["3"].error is None
    with pytest.raises(ValueError, match="age"):
        score_requests(df.drop("age"), stored_params())


def test_forest_and_its_summary(spark, linear, tmp_path):
    model = train_forest(linear, XS, "y", numTrees=10, maxDepth=4)
    rows = feature_importance(model, spark).orderBy("position").collect()
    assert [r.feature for r in rows] == XS
    assert sum(r.importance for r in rows) == pytest.approx(1)
    write_forest_summary(spark, model, str(tmp_path / "forest"), 0.8)
    record = json.loads(next((tmp_path / "forest").glob("*.json")).read_text())
    assert record["features"] == XS and record["avg_accuracy"] == 0.8
    assert record["importances"] == pytest.approx([r.importance for r in rows])


@pytest.fixture(scope="module")
def ring(spark):
    df = spark.range(500).select(
        "id", seeded_normal("a", "id").alias("a"), seeded_normal("b", "id").alias("b")
    )
    return df.withColumn("y", (F.col("a") ** 2 + F.col("b") ** 2 < 1.3).cast("int")).cache()


def test_kernel_machine_learns_what_a_line_cannot(spark, ring, tmp_path):
    model = train_rbf_svm(
        ring, ["a", "b"], "y", gamma=0.5, n_features=48, calibration_folds=2,
    )
    scored = score_model(model, ring)
    curved = auc_exact(scored, "y", "score").collect()[0].auc
    line = score_model(train_logreg(ring, ["a", "b"], "y"), ring)
    assert curved > 0.95 > auc_exact(line, "y", "score").collect()[0].auc
    row = scored.select("prediction", "score").first()
    assert row.prediction in (0.0, 1.0) and 0 < row.score < 1
    support = sum(stage_of(model, KernelMachineModel).support_counts())
    assert 0 < support < 500
    save_model(model, str(tmp_path / "svm"))
    back = score_model(load_model(str(tmp_path / "svm")), ring)
    gap = back.select("id", F.col("score").alias("s")).join(scored, "id")
    assert gap.agg(F.max(F.abs(F.col("s") - F.col("score")))).collect()[0][0] < 1e-12


def test_kernel_machine_is_as_good_as_an_exact_solve(spark, ring, monkeypatch):
    """Several blocks and calibration parts against coordinate descent on the whole kernel."""
    monkeypatch.setattr("riskflow.operators.kernel_machine.BLOCK_ROWS", 150)
    train, test = ring.filter("id < 400"), ring.filter("id >= 400")
    model = train_rbf_svm(
        train, ["a", "b"], "y", gamma=0.5, n_features=64, calibration_folds=3, standardize=False, tol=0.005,
    )
    ours = auc_exact(score_model(model, test), "y", "score").collect()[0].auc
    rows, held = train.toPandas(), test.toPandas()
    x, y = rows[["a", "b"]].to_numpy(), rows["y"].to_numpy() * 2.0 - 1.0
    kernel = rbf(x, x, 0.5) + 1.0
    alpha = np.zeros(len(y))
    for _ in range(200):
        for i in range(len(y)):
            slope = 1.0 - y[i] * (kernel[i] @ (alpha * y))
            alpha[i] = min(max(alpha[i] + slope / kernel[i, i], 0.0), 1.0)
    exact = (rbf(held[["a", "b"]].to_numpy(), x, 0.5) + 1.0) @ (alpha * y)
    scored = spark.createDataFrame(
        list(zip(held["y"].tolist(), exact.tolist())), "y int, score double"
    )
    assert ours > auc_exact(scored, "y", "score").collect()[0].auc - 0.01
    support = sum(stage_of(model, KernelMachineModel).support_counts())
    assert abs(support - int((alpha > 1e-9).sum())) < 40


def test_calibration_is_optimal_on_the_rows_themselves(spark, ring):
    rows = ring.select((1.3 - F.col("a") ** 2 + F.col("b")).alias("m"), "y")
    slope, intercept = fit_platt(rows, "m", "y", bins=100_000)
    p = rows.toPandas()
    m, y = p["m"].to_numpy(), p["y"].to_numpy()
    aim = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    off = 1 / (1 + np.exp(-(slope * m + intercept))) - aim
    assert abs(off.sum()) < 1e-6 and abs((off * m).sum()) < 1e-2
    assert fit_platt(rows.limit(0), "m", "y") == (0.0, 0.0)
    assert fit_platt(rows.filter("y = 1"), "m", "y")[1] > 0


def test_cross_validation_scores_every_row_out_of_fold(linear):
    df = random_folds(linear)
    trainer = partial(train_logreg, features=XS, label="y")
    pred = cross_validate(df, trainer, XS, "y")
    assert pred.count() == 400 and pred.select("id").distinct().count() == 400
    one = trainer(df.filter("fold <> 3"))
    want = score_model(one, df.filter("fold = 3")).select("id", F.col("score").alias("s"))
    gap = pred.filter("fold = 3").join(want, "id").agg(F.max(F.abs(F.col("score") - F.col("s"))))
    assert gap.collect()[0][0] < 1e-9
    assert stage_of(one, LogisticRegressionModel) is not None


def test_fit_scope_all_scales_beforehand(linear):
    df = random_folds(linear, k=2)
    seen = []

    def trainer(train):
        seen.append(train.agg(F.avg("x0")).collect()[0][0])
        return train_logreg(train, XS, "y", standardize=False)

    cross_validate(df, trainer, XS, "y", k=2, fit_scope="all")
    raw = [df.filter(F.col("fold") != i).agg(F.avg("x0")).collect()[0][0] for i in range(2)]
    mean, std = df.agg(F.avg("x0"), F.stddev("x0")).collect()[0]
    assert sorted(seen) == pytest.approx(sorted((r - mean) / std for r in raw))
    with pytest.raises(ValueError):
        cross_validate(df, trainer, XS, "y", k=2, fit_scope="some")


def test_knn_cross_validation_never_uses_its_own_fold(spark):
    rows = [(i, i % 2, float(i // 2), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, fold int, x double, y int")
    pred = cross_validate_knn(df, ["x"], "y", neighbors=1).collect()
    assert len(pred) == 40
    assert all(r.prediction == 1 - r.label for r in pred)


@pytest.mark.parametrize("settings", [{}, {"balanced": True, "C": 1.0}, {"balanced": True, "C": 0.05, "penalise_intercept": False}])
def test_folds_fitted_together_equal_separate_fits(spark, linear, settings, monkeypatch):
    from riskflow.operators import folded_logreg

    df = random_folds(linear, 4)
    models = folded_logreg.fit_logreg_folds(df, XS, "y", k=4, **settings)
    rows = df.toPandas()
    for i in range(4):
        train = rows[rows["fold"] != i]
        x, y = train[XS].to_numpy(), train["y"].to_numpy().astype(float)
        z = np.column_stack([(x - x.mean(axis=0)) / x.std(axis=0), np.ones(len(x))])
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if settings else np.ones(len(y))
        penalty = np.array([1.0 / settings["C"]] * 4) if settings else np.zeros(4)
        if not settings.get("penalise_intercept", True):
            penalty[-1] = 0
        theta = np.zeros(4)
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ theta))
            hessian = z.T @ (z * (w * p * (1 - p))[:, None]) + np.diag(penalty)
            theta -= np.linalg.solve(hessian, z.T @ (w * (p - y)) + penalty * theta)
        assert models.coefficients[i] == pytest.approx(theta[:3] / x.std(axis=0), abs=1e-6)
        assert models.intercepts[i] == pytest.approx(theta[3] - (theta[:3] / x.std(axis=0) * x.mean(axis=0)).sum(), abs=1e-6)
    # Passes over the rows do not depend on the number of folds.
    assert folded_logreg.fit_logreg_folds(random_folds(linear, 9), XS, "y", k=9, **settings).passes <= models.passes + 1
    pred = folded_logreg.cross_validate_logreg(df, XS, "y", k=4, **settings)
    assert pred.count() == 400 and pred.where("score is null or prediction not in (0, 1)").count() == 0
    gradients = folded_logreg.fold_gradients(df, models, "y", C=settings.get("C"), penalise_intercept=settings.get("penalise_intercept", True))
    assert gradients.count() == 16 and gradients.where("abs(gradient) > 1e-8").count() == 0


def test_fold_models_on_hard_rows(spark, linear):
    from riskflow.operators.folded_logreg import cross_validate_logreg, fit_logreg_folds

    flat = random_folds(linear.withColumn("flat", F.lit(3.0)), 3)
    models = fit_logreg_folds(flat, [*XS, "flat"], "y", k=3)
    assert models.coefficients[:, 3].tolist() == [0.0, 0.0, 0.0]
    apart = flat.withColumn("y", (F.col("x0") > 0).cast("int"))  # no finite optimum
    pred = cross_validate_logreg(apart, XS, "y", k=3)
    assert pred.where("prediction = label").count() > 390
    with pytest.raises(ValueError, match="null"):
        fit_logreg_folds(flat.withColumn("x0", F.when(F.col("id") > 3, F.col("x0"))), XS, "y", k=3)
    with pytest.raises(ValueError, match="labels"):
        fit_logreg_folds(flat.withColumn("y", F.lit(2)), XS, "y", k=3)


def test_fold_moments_are_merged(linear):
    from riskflow.operators.folded_logreg import all_but, fold_partials

    df = random_folds(linear, 4)
    parts = fold_partials(df, XS, ["fold"])
    for i in range(4):
        got = all_but(parts, i, 3)
        rows = df.where(F.col("fold") != i).toPandas()[XS]
        assert got.n == len(rows)
        assert got.mean == pytest.approx(rows.mean().to_numpy()) and got.deviation(1) == pytest.approx(rows.std().to_numpy())
