"""The kernel machine's rounds and its duality gap, over few and many blocks."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskflow.functions.scalar import seeded_normal
from riskflow.operators import kernel_machine as km


def test_rounds_do_not_grow_with_the_blocks(spark, monkeypatch):
    point = [seeded_normal(c, "id").alias(c) for c in "ab"]
    noisy = F.col("a") ** 2 + F.col("b") ** 2 + 0.4 * seeded_normal("c", "id") < 1.3
    rows = spark.range(600).select("id", *point).withColumn("y", noisy.cast("int"))
    rows = rows.withColumn("v", array_to_vector(F.array("a", "b"))).cache()
    landmarks = np.random.default_rng(1).normal(size=(30, 2))
    solved = []
    for size in (600, 20):
        monkeypatch.setattr(km, "BLOCK_ROWS", size)
        solved.append(km.solve_dual(rows, "v", "y", landmarks, 0.5, parts=3, tol=0.005))
    one, many = solved
    assert one.state.count() == 1 and many.state.count() == 30
    assert many.rounds <= 40 and abs(many.rounds - one.rounds) <= 1
    assert (many.gaps <= 0.005).all() and np.allclose(one.weights, many.weights, atol=1e-5)
    # The gap of fit 0, by its definition.
    p = rows.toPandas()
    phi = km._features(p[["a", "b"]].to_numpy().ravel(), 2, landmarks, 0.5, km.whitening(landmarks, 0.5))
    y = p["y"].to_numpy() * 2.0 - 1.0
    w, z = many.weights[0], np.maximum(0.0, 1.0 - y * (phi @ many.weights[0]))
    alpha = np.minimum(z / many.widths[0], 1.0)
    primal, dual = 0.5 * w @ w + z.sum(), alpha.sum() - 0.5 * (((alpha * y) @ phi) ** 2).sum()
    assert many.gaps[0] == pytest.approx((primal - dual) / primal, abs=1e-6)
