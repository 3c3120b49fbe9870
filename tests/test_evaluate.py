"""Metrics, curves, reports and the bootstrap."""

import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from riskflow.contract import RELIABILITY_LOWEST, RELIABILITY_TIERS, SEED
from riskflow.functions.scalar import (
    clamp,
    decide,
    percent,
    reliability_tier,
    risk_status,
    seeded_uniform,
    sigmoid,
)
from riskflow.operators.bootstrap import (
    _weighted_cells,
    bootstrap_metrics,
    bootstrap_report,
    bootstrap_weights,
    reliability_score,
)
from riskflow.operators.evaluate import (
    auc_binned,
    auc_exact,
    binary_metrics,
    confusion,
    roc_curve,
    weighted_metrics,
)
from riskflow.operators.validate import cv_report, fold_metrics


@pytest.fixture(scope="module")
def pred(spark):
    noise = seeded_uniform(5, "id")
    return (
        spark.range(600)
        .withColumn("label", (seeded_uniform(4, "id") > 0.6).cast("int"))
        .withColumn("score", F.round(F.col("label") * 0.3 + noise * 0.7, 2))
        .withColumn("prediction", decide("score").cast("double"))
        .withColumn("fold", (F.col("id") % 3).cast("int"))
        .cache()
    )


def test_scalar_edges(spark):
    row = spark.range(1).select(
        decide(F.lit(0.5)).alias("half"), percent(F.lit(0.999)).alias("pc"),
        sigmoid(F.lit(-800.0)).alias("low"), risk_status(F.lit(0.5)).alias("status"),
        clamp(F.lit(1.2)).alias("top"), clamp(F.lit(-0.1)).alias("bottom"),
    ).collect()[0]
    assert (row.half, row.pc, row.low, row.top, row.bottom) == (1, 99, 0.0, 1.0, 0.0)
    assert row.status == "NGUY CƠ CAO"


def test_tier_bounds_are_exclusive(spark):
    values = [0.9, 0.85, 0.8, 0.75, 0.7, 0.60, 0.1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s double")
    names = [n for _, n in RELIABILITY_TIERS]
    got = [r[0] for r in df.orderBy("i").select(reliability_tier("s")).collect()]
    assert got == [names[0], names[1], names[1], names[2], names[2],
                   RELIABILITY_LOWEST, RELIABILITY_LOWEST]


def test_no_predicted_positives(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    row = binary_metrics(df, "label", "prediction").collect()[0]
    assert (row.samples, row.accuracy, row.precision, row.recall, row.f1) == (2, 0.5, 0, 0, 0)


def test_no_rows(spark):
    df = spark.createDataFrame([], "label int, prediction int")
    assert binary_metrics(df, "label", "prediction").collect()[0].accuracy == 0.0


def test_confusion(spark):
    rows = [(1, 1)] * 3 + [(0, 0)] * 4 + [(0, 1)] * 2 + [(1, 0)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    assert tuple(confusion(df, "label", "prediction").collect()[0]) == (3, 4, 2, 1)


def test_weighted_metrics_match_the_builtin(pred):
    row = weighted_metrics(pred, "label", "prediction").collect()[0]
    for ours, theirs in (("accuracy", "accuracy"), ("precision", "weightedPrecision"),
                         ("recall", "weightedRecall"), ("f1", "f1")):
        value = MulticlassClassificationEvaluator(
            labelCol="label", predictionCol="prediction", metricName=theirs
        ).evaluate(pred)
        assert row[ours] == pytest.approx(value, abs=1e-12)


def test_weighted_metrics_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (2, 1)], "label int, prediction int")
    row = weighted_metrics(df, "label", "prediction").collect()[0]
    assert row.samples == 4
    assert row.precision == pytest.approx((0.5 + 0 + 2 * 1.0) / 4)
    assert row.recall == pytest.approx(0.5)


def test_auc_matches_the_builtin_and_mirrors(pred):
    exact = auc_exact(pred, "label", "score").collect()[0].auc
    value = BinaryClassificationEvaluator(
        labelCol="label", rawPredictionCol="score", numBins=0
    ).evaluate(pred)
    assert exact == pytest.approx(value, abs=1e-12)
    mirrored = pred.withColumn("score", -F.col("score"))
    assert auc_exact(mirrored, "label", "score").collect()[0].auc == pytest.approx(1 - exact)


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert auc_exact(df, "label", "score").collect()[0].auc == pytest.approx(3.5 / 4)
    assert auc_binned(df, "label", "score", bins=10).collect()[0].auc == pytest.approx(3.5 / 4)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")
    assert auc_exact(df, "label", "score").collect()[0].auc is None


def test_auc_by_fold_ignores_the_layout(pred):
    one, many = (
        {r.fold: r.auc for r in auc_exact(df, "label", "score", "fold").collect()}
        for df in (pred.coalesce(1), pred.repartition(16))
    )
    assert one == pytest.approx(many)


def test_binned_auc_is_near_the_exact_one(pred):
    exact = auc_exact(pred, "label", "score").collect()[0].auc
    assert auc_binned(pred, "label", "score").collect()[0].auc == pytest.approx(exact, abs=2e-3)


def test_roc_curve_is_monotone_and_ends_at_one(pred):
    points = roc_curve(pred, "label", "score", "fold").collect()
    for fold in range(3):
        mine = sorted((p for p in points if p.fold == fold), key=lambda p: -p.threshold)
        assert (mine[0].threshold, mine[0].fpr, mine[0].tpr) == (math.inf, 0.0, 0.0)
        assert (mine[-1].fpr, mine[-1].tpr) == (1.0, 1.0)
        assert all(a.fpr <= b.fpr and a.tpr <= b.tpr for a, b in zip(mine, mine[1:]))
        area = sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip(mine, mine[1:]))
        auc = auc_exact(pred.filter(F.col("fold") == fold), "label", "score").collect()[0].auc
        assert area == pytest.approx(auc)


@pytest.mark.parametrize("ddof", [0, 1])
@pytest.mark.parametrize("averaging", ["binary", "weighted", "mixed"])
def test_report_summarises_the_folds(pred, ddof, averaging):
    per_fold = fold_metrics(pred, averaging).toPandas()
    report = cv_report(pred, averaging, ddof).toPandas().set_index("fold")
    assert sorted(report.index) == ["AVG", "Fold 1", "Fold 2", "Fold 3", "STD"]
    for m in ("accuracy", "precision", "recall", "f1", "auc"):
        assert report.loc["AVG", m] == pytest.approx(per_fold[m].mean())
        assert report.loc["STD", m] == pytest.approx(per_fold[m].std(ddof=ddof))
    assert report.loc[["Fold 1", "Fold 2", "Fold 3"], "samples"].sum() == 600
    assert report.loc[["AVG", "STD"], "samples"].isna().all()


def test_mixed_report_takes_f1_from_the_weighted_form(pred):
    mixed, weighted, binary = (
        fold_metrics(pred, a).orderBy("fold").collect() for a in ("mixed", "weighted", "binary")
    )
    assert [r.f1 for r in mixed] == [r.f1 for r in weighted]
    assert [r.precision for r in mixed] == [r.precision for r in binary]


def test_bootstrap_weights_are_poisson(pred):
    drawn = bootstrap_weights(pred.select("id"), replicates=20)
    sizes = [r.n for r in drawn.groupBy("replicate").agg(F.sum("weight").alias("n")).collect()]
    assert len(sizes) == 20
    assert np.mean(sizes) == pytest.approx(600, rel=0.03)


def test_bootstrap_forms_agree_in_distribution(pred):
    reports = {}
    for mode in ("multinomial", "poisson"):
        reps = bootstrap_metrics(pred, "label", "prediction", replicates=200, mode=mode)
        assert reps.count() == 200
        reports[mode] = bootstrap_report(reps).toPandas().set_index("metric")
    gap = reports["multinomial"] - reports["poisson"]
    assert (gap["mean"].abs() < 0.01).all()
    assert (gap["std"].abs() < 0.006).all()


@pytest.mark.parametrize("replicates", [7, 130])
def test_weighted_counters_equal_weighted_rows(pred, replicates):
    """The counters of a task against one row per draw; a missing label is no outcome."""
    pred = pred.withColumn("label", F.when(F.col("id") % 11 != 0, F.col("label")))
    y, p = F.col("label") == 1, F.col("prediction") == 1
    total = lambda test: F.sum(F.when(test, F.col("weight")).otherwise(0))
    want = bootstrap_weights(pred, replicates).groupBy("replicate").agg(
        total(y & p), total(~y & ~p), total(~y & p), total(y & ~p)
    )
    got = _weighted_cells(pred, "label", "prediction", replicates, SEED, "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == replicates
    alone = _weighted_cells(pred.where("id = 5"), "label", "prediction", replicates, SEED, "id")
    assert 0 < alone.count() < replicates


def test_bootstrap_is_seeded_and_layout_free(pred):
    for mode in ("multinomial", "poisson"):
        runs = [
            sorted(map(tuple, bootstrap_metrics(
                pred.repartition(n), "label", "prediction", 5, seed, mode=mode).collect()))
            for n, seed in ((1, 7), (9, 7), (3, 8))
        ]
        assert runs[0] == runs[1] != runs[2]


def test_reliability_formula(spark):
    summary = spark.createDataFrame(
        [("accuracy", 0.9, 0.01), ("f1", 0.8, 0.5), ("precision", 0.1, 0.1), ("recall", 0.1, 0.1)],
        "metric string, mean double, std double",
    )
    row = reliability_score(summary).collect()[0]
    assert row.score == pytest.approx(0.9 * 0.6 + 0.8 * 0.4 - 0.02)
    assert row.tier == "CAO (GOOD)"
