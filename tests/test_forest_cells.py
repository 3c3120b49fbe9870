"""The forest grown by cells: the same trees for any cell size, and jobs that do not grow with its nodes."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from riskflow.functions.scalar import seeded_normal
from riskflow.operators import forest
from riskflow.operators.evaluate import auc_exact
from riskflow.operators.models import build_pipeline, score_model, train_forest

XS = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def noisy(spark):
    x = [seeded_normal(f"x{i}", "id").alias(f"x{i}") for i in range(3)]
    df = spark.range(1200).select("id", *x)
    margin = F.col("x0") ** 2 + F.col("x1") + seeded_normal("e", "id") - 0.7
    return df.withColumn("y", (margin > 0).cast("int")).cache()


def test_cells_do_not_change_the_trees(noisy, monkeypatch):
    grown = []
    for rows, nodes in ((5000, 4096), (100, 4096), (100, 3)):
        monkeypatch.setattr(forest, "CELL_ROWS", rows)
        monkeypatch.setattr(forest, "NODES", nodes)
        model = train_forest(noisy, XS, "y", numTrees=3, maxDepth=7)
        grown.append(model.stages[-1].toDebugString.split("\n", 1)[1])
    assert grown[0] == grown[1] == grown[2]


def test_jobs_do_not_grow_with_depth(spark, noisy):
    counts = []
    for depth in (3, 12):
        spark.sparkContext.setJobGroup(f"depth{depth}", "")
        model = train_forest(noisy, XS, "y", numTrees=4, maxDepth=depth)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"depth{depth}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert model.stages[-1].totalNumNodes > 200
    assert counts[1] <= counts[0] + 1


def test_as_good_as_the_forest_of_spark_ml(noisy):
    train, test = noisy.filter("id % 3 > 0"), noisy.filter("id % 3 = 0")
    settings = {"numTrees": 30, "maxDepth": 6, "minInstancesPerNode": 2, "subsamplingRate": 0.8, "seed": 1}
    ours = train_forest(train, XS, "y", **settings)
    theirs = build_pipeline(XS, "y", RandomForestClassifier(**settings)).fit(train)
    areas = [auc_exact(score_model(m, test), "y", "score").first().auc for m in (ours, theirs)]
    assert areas[0] > areas[1] - 0.03 and areas[0] > 0.75
    shares = [m.stages[-1].featureImportances.toArray() for m in (ours, theirs)]
    assert np.abs(shares[0] - shares[1]).max() < 0.08
    assert ours.stages[-1].getMaxDepth() == 6 and ours.stages[-1].getNumTrees == 30


def test_one_tree_is_the_greedy_tree(spark):
    rows = [(float(i), float(i % 3), int(i >= 6)) for i in range(10)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    model = train_forest(df, ["a", "b"], "y", standardize=False, numTrees=1, maxDepth=1, subsamplingRate=1.0)
    assert "feature 0 <= " in model.stages[-1].toDebugString
    hist = np.zeros((1, 1, 4, 2))
    hist[0, 0] = [[2, 0], [2, 1], [0, 3], [0, 1]]
    slot, cut, gain, total = forest.best_splits(hist, 2, 0.0)
    assert (slot[0], cut[0]) == (0, 1) and total[0].tolist() == [4, 5]
    n, left = 40 / 81, 2 * 0.8 * 0.2
    assert gain[0] == pytest.approx(n - 5 / 9 * left)
    assert forest.best_splits(hist, 6, 0.0)[2][0] == 0


def test_more_classes_and_bad_labels(spark, noisy):
    three = noisy.withColumn("y", F.when(F.col("x2") > 1, 2).otherwise(F.col("y")))
    model = train_forest(three, XS, "y", numTrees=5, maxDepth=5)
    assert model.stages[-1].numClasses == 3
    scored = model.transform(three)
    assert scored.filter("prediction = y").count() > 900
    with pytest.raises(ValueError, match="labels"):
        train_forest(noisy.withColumn("y", F.when(F.col("id") > 3, F.col("y"))), XS, "y", numTrees=2)
