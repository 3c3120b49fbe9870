"""Kernel machine: Nyström landmarks, Newton steps over blocks of rows, Platt's sigmoid."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.contract import SEED
from riskflow.functions.scalar import seeded_hash
from riskflow.workspace import stage

#: Rows of one block; a block is one row of the staged table and one unit of work.
BLOCK_ROWS = 4_096
#: Bins of the margins that the sigmoid is fitted on.
PLATT_BINS = 4_096


def rbf(x: np.ndarray, landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """Kernel values of all rows against all landmarks."""
    gap = (x * x).sum(axis=1)[:, None] + (landmarks * landmarks).sum(axis=1) - 2.0 * x @ landmarks.T
    return np.exp(-gamma * np.maximum(gap, 0.0))


def choose_landmarks(df: DataFrame, vector: str, count: int, seed: int = SEED) -> np.ndarray:
    """At most ``count`` distinct landmarks: centres of a few k-means rounds after a k-means|| start."""
    model = KMeans(
        featuresCol=vector, k=count, seed=seed, maxIter=3, initSteps=2, predictionCol="_centre"
    ).fit(df.select(vector))
    return np.unique(np.stack(model.clusterCenters()), axis=0)


def whitening(landmarks: np.ndarray, gamma: float, floor: float = 1e-10) -> np.ndarray:
    """Map from kernel values to features whose inner products are the Nyström kernel.

    Directions below ``floor`` times the largest eigenvalue are left out.
    """
    values, vectors = np.linalg.eigh(rbf(landmarks, landmarks, gamma))
    kept = values > floor * values[-1]
    return vectors[:, kept] / np.sqrt(values[kept])


class KernelMachineModel(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Margins from kernel values against the landmarks, and ``prediction`` from their sign.

    The output column holds ``[-margin, margin]`` as a vector.
    """

    landmarks = Param(Params._dummy(), "landmarks", "landmarks, row after row", TypeConverters.toListFloat)
    weights = Param(Params._dummy(), "weights", "one weight a landmark", TypeConverters.toListFloat)
    bias = Param(Params._dummy(), "bias", "constant of the margin", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "kernel width parameter", TypeConverters.toFloat)
    support = Param(
        Params._dummy(), "support", "support vectors of class 0 and class 1", TypeConverters.toListInt
    )

    @keyword_only
    def __init__(
        self, *, inputCol=None, outputCol="margin", landmarks=None, weights=None, bias=0.0,
        gamma=0.125, support=None,
    ):
        super().__init__()
        self._setDefault(outputCol="margin", bias=0.0, gamma=0.125)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = np.array(self.getOrDefault(self.weights))
        landmarks = np.array(self.getOrDefault(self.landmarks)).reshape(len(weights), -1)
        bias, gamma = self.getOrDefault(self.bias), self.getOrDefault(self.gamma)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def margins(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            m = rbf(np.stack(rows.to_numpy()), landmarks, gamma) @ weights + bias
            return pd.Series(list(np.stack([-m, m], axis=1)))

        out = self.getOutputCol()
        both = array_to_vector(margins(vector_to_array(F.col(self.getInputCol()))))
        return dataset.withColumn(out, both).withColumn(
            "prediction", (vector_to_array(out)[1] > 0).cast("double")
        )

    def support_counts(self) -> tuple[int, int]:
        """Rows with a non-zero multiplier, of class 0 and of class 1."""
        return tuple(self.getOrDefault(self.support))


class PlattSigmoid(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """``probability`` from a margin vector: a sigmoid of slope times margin plus intercept."""

    slope = Param(Params._dummy(), "slope", "factor of the margin", TypeConverters.toFloat)
    intercept = Param(Params._dummy(), "intercept", "constant", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol="margin", outputCol="probability", slope=1.0, intercept=0.0):
        super().__init__()
        self._setDefault(inputCol="margin", outputCol="probability", slope=1.0, intercept=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        z = vector_to_array(self.getInputCol())[1] * F.lit(self.getOrDefault(self.slope)) + F.lit(
            self.getOrDefault(self.intercept)
        )
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.array(F.lit(1.0) - p, p)))


def margin_bins(df: DataFrame, margin: str, label: str, bins: int = PLATT_BINS) -> DataFrame:
    """Rows ``(bin, margin, negatives, positives)``: equal widths over the margins' range.

    ``margin`` is the mean of the bin, so fits on bins lose only the spread within one.
    Rows without a margin or label take no part.
    """
    rows = df.select(F.col(margin).cast("double").alias("m"), F.col(label).cast("double").alias("y"))
    rows = rows.where("m is not null and not isnan(m) and y is not null")
    low, high = rows.agg(F.min("m"), F.max("m")).collect()[0]
    width = (high - low) / bins if low is not None and high > low else 1.0
    place = F.least(F.floor((F.col("m") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    return rows.groupBy(place.alias("bin")).agg(
        F.avg("m").alias("margin"),
        F.count_if(F.col("y") <= 0).alias("negatives"), F.count_if(F.col("y") > 0).alias("positives"),
    )


def fit_platt(df: DataFrame, margin: str, label: str, bins: int = PLATT_BINS) -> tuple[float, float]:
    """(slope, intercept) by Newton steps on the smoothed targets over binned margins.

    A positive row aims at (P + 1) / (P + 2), a negative one at 1 / (N + 2), for P positive
    and N negative rows. Only the bins come to the driver. Without any row the result is (0, 0).
    """
    held = margin_bins(df, margin, label, bins).orderBy("bin").toPandas()
    m = held["margin"].to_numpy(dtype=float)
    neg, pos = held["negatives"].to_numpy(dtype=float), held["positives"].to_numpy(dtype=float)
    if not len(m):
        return 0.0, 0.0
    n = neg + pos
    aim = pos * (pos.sum() + 1.0) / (pos.sum() + 2.0) + neg / (neg.sum() + 2.0)
    x = np.stack([m, np.ones_like(m)], axis=1)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((n * np.logaddexp(0.0, z) - aim * z).sum())

    w = np.array([0.0, math.log((pos.sum() + 1.0) / (neg.sum() + 1.0))])
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-(x @ w)))
        gradient = x.T @ (n * p - aim)
        hessian = (x * (n * p * (1.0 - p))[:, None]).T @ x + 1e-12 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        size, now = 1.0, loss(w)
        while size > 1e-10 and loss(w - size * step) > now:
            size /= 2.0
        w = w - size * step
        if np.abs(size * step).max() < 1e-12:
            break
    return float(w[0]), float(w[1])


@dataclass(frozen=True)
class DualSolution:
    """Weights of all fits (one row each, bias last), the staged blocks, and the gaps.

    A row's multiplier in a fit is ``C`` times its hinge loss over the fit's ``widths`` entry,
    at most ``C``; so it is not zero just where the margin is below 1.
    """

    weights: np.ndarray
    state: DataFrame
    gaps: np.ndarray
    rounds: int
    widths: np.ndarray


def _features(x: np.ndarray, size: int, landmarks: np.ndarray, gamma: float, white: np.ndarray) -> np.ndarray:
    phi = rbf(x.reshape(-1, size), landmarks, gamma) @ white
    return np.hstack([phi, np.ones((len(phi), 1))])


def _sum_states(df: DataFrame) -> dict[int, np.ndarray]:
    """Sum of the vectors of each fit; their length does not depend on the data."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("tag")
        total = sum(np.frombuffer(v) for v in ordered["sums"])
        return pd.DataFrame({"fit": pdf["fit"].iloc[:1], "sums": [total.tobytes()]})

    rows = df.groupBy("fit").applyInPandas(add, "fit int, sums binary").collect()
    return {r.fit: np.frombuffer(r.sums) for r in rows}


def solve_dual(
    df: DataFrame, vector: str, label: str, landmarks: np.ndarray, gamma: float, C: float = 1.0,
    parts: int = 0, id: str = "id", seed: int = SEED, max_rounds: int = 100, tol: float = 0.02,
) -> DualSolution:
    """Soft-margin machines on Nyström features, all in the same rounds.

    Fit 0 learns from every row; with ``parts`` above 1, fit ``i + 1`` leaves out seeded part
    ``i``. Rows are packed into blocks by a hash of their id. A round is one pass over the
    blocks: each fit's hinge loss, rounded off over a width, gives loss, gradient and Hessian
    for a Newton step, and the multipliers that belong to it, a feasible point of the dual.
    The duality gap of the plain hinge loss is the part that comes from the width plus the
    part that comes from unfinished steps; the width shrinks while the first is too large. A
    fit ends when its gap, relative to its primal value, is at most ``tol``. Rounds do not
    grow with the rows, and only sums of a fixed size travel. The bias is a constant feature
    and so takes part in the penalty.
    """
    white = whitening(landmarks, gamma)
    size, width = landmarks.shape[1], white.shape[1] + 1
    fits = parts + 1 if parts > 1 else 1
    blocks = max(1, -(-df.count() // BLOCK_ROWS))
    hashed = seeded_hash(f"{seed}:block", id)
    part = F.pmod(seeded_hash(f"{seed}:calibration", id), F.lit(max(parts, 1))).cast("int")
    rows = df.select(
        F.pmod(hashed, F.lit(blocks)).alias("block"),
        F.struct(
            hashed.alias("h"), part.alias("part"), F.col(label).cast("double").alias("y"),
            vector_to_array(vector).alias("x"),
        ).alias("r"),
    )
    packed = rows.groupBy("block").agg(F.sort_array(F.collect_list("r")).alias("r")).select(
        "block", F.transform("r", lambda r: r["y"] * 2.0 - 1.0).alias("y"),
        F.transform("r", lambda r: r["part"]).alias("part"),
        F.flatten(F.transform("r", lambda r: r["x"])).alias("x"),
    )
    # One file a task: a block is small but much work, so files are cut by work, not bytes.
    files = min(blocks, max(df.sparkSession.sparkContext.defaultParallelism, blocks // 16))
    state = stage(packed.repartition(files), "kernel-blocks")

    def work(weights: np.ndarray, widths: np.ndarray, going: list[int]):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, tag = None, None
            for frame in frames:
                for row in frame.itertuples(index=False):
                    if sums is None:
                        sums, tag = np.zeros((len(going), 4 + width + width * width)), row.block
                    y, held = np.asarray(row.y), np.asarray(row.part)
                    phi = _features(np.asarray(row.x), size, landmarks, gamma, white)
                    short = 1.0 - y[:, None] * (phi @ weights[going].T)
                    for at, j in enumerate(going):
                        z, h = np.maximum(0.0, short[:, at]), widths[j]
                        if j:
                            z[held == j - 1] = 0.0
                        alpha = C * np.minimum(z / h, 1.0)
                        bent = phi[(z > 0) & (z < h)]
                        sums[at, :4] += (
                            C * z.sum(), alpha.sum(), alpha @ z,
                            C * np.where(z < h, z * z / (2.0 * h), z - h / 2.0).sum(),
                        )
                        sums[at, 4:4 + width] += (alpha * y) @ phi
                        sums[at, 4 + width:] += (bent.T @ bent).ravel()
            if sums is not None:
                yield pd.DataFrame({"fit": going, "tag": tag, "sums": [s.tobytes() for s in sums]})

        return run

    weights, widths = np.zeros((fits, width)), np.full(fits, 2.0)
    steps, before = np.zeros((fits, width)), np.full(fits, np.inf)
    gaps, turn, going = np.full(fits, np.inf), 0, list(range(fits))
    while going and turn < max_rounds:
        tried = weights + steps
        sums = _sum_states(state.mapInPandas(work(tried, widths, going), "fit int, tag long, sums binary"))
        if not sums:
            break
        turn += 1
        for j in list(going):
            hinge, alpha, product, smooth = sums[j][:4]
            pull, w = sums[j][4:4 + width], tried[j]
            loss = 0.5 * w @ w + smooth
            if loss > before[j] + 1e-9 * abs(before[j]) and np.abs(steps[j]).max() > 1e-10:
                steps[j] /= 2.0  # the step was too long
                continue
            weights[j], before[j] = w, loss
            rest, primal = 0.5 * ((w - pull) ** 2).sum(), 0.5 * w @ w + hinge
            gaps[j] = (hinge - product + rest) / max(primal, 1e-300)
            if gaps[j] <= tol:
                going.remove(j)
                continue
            bent = sums[j][4 + width:].reshape(width, width)
            steps[j] = -np.linalg.solve(np.eye(width) + (C / widths[j]) * bent, w - pull)
            rounding = hinge - product
            if rounding > 0.5 * tol * primal and rest <= rounding:
                # What rounding costs falls with the square of the width, about.
                widths[j] *= np.clip(np.sqrt(0.25 * tol * primal / rounding), 0.1, 0.7)
                before[j] = np.inf
    return DualSolution(weights, state, gaps, turn, widths)


def _held_margins(
    solved: DualSolution, size: int, landmarks: np.ndarray, gamma: float, fits: int
) -> DataFrame:
    """(m, y, support) of every row: its margin by the fit that left it out, or by fit 0 if there
    is one only, its class, and whether its multiplier in fit 0 is not zero."""
    white, weights = whitening(landmarks, gamma), solved.weights

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                margins = _features(np.asarray(row.x), size, landmarks, gamma, white) @ weights.T
                by = np.asarray(row.part) + 1 if fits > 1 else np.zeros(len(margins), dtype=int)
                sign = np.asarray(row.y)
                yield pd.DataFrame({
                    "m": margins[np.arange(len(margins)), by], "y": (sign > 0).astype(float),
                    "support": sign * margins[:, 0] < 1.0,
                })

    return solved.state.select("y", "part", "x").mapInPandas(run, "m double, y double, support boolean")


def _support(held: DataFrame) -> list[int]:
    """Support vectors of fit 0, of class 0 and class 1."""
    of = lambda y: F.count_if(F.col("support") & (F.col("y") == y))
    return [int(v) for v in held.agg(of(0.0), of(1.0)).collect()[0]]


def train_rbf_svm(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    C: float = 1.0,
    gamma: float | None = None,
    n_features: int = 256,
    seed: int = SEED,
    standardize: bool = True,
    calibration_folds: int = 5,
    id: str = "id",
    max_iter: int = 100,
    tol: float = 0.02,
) -> PipelineModel:
    """Soft-margin classifier with a Nyström form of the RBF kernel and calibrated probabilities.

    ``n_features`` is the number of landmarks. ``prediction`` comes from the sign of the
    margin and ``probability`` from the calibration, so the two can disagree near the
    boundary. The calibration is fitted on margins of held-out rows (``calibration_folds``
    seeded parts, solved in the same rounds as the final model), or on the training margins
    with fewer than 2. ``gamma`` defaults to 1 / number of features, the scale rule for
    standardised input.
    """
    gamma = gamma or 1.0 / len(features)
    stages = [VectorAssembler(inputCols=list(features), outputCol="features_raw")]
    vector = "features" if standardize else "features_raw"
    ready = stages[0].transform(df)
    if standardize:
        scaler = StandardScaler(inputCol="features_raw", outputCol=vector, withMean=True, withStd=True)
        stages.append(scaler.fit(ready))
        ready = stages[-1].transform(ready)
    ready = stage(ready.select(id, label, vector), "kernel-rows")
    landmarks = choose_landmarks(ready, vector, n_features, seed)
    solved = solve_dual(
        ready, vector, label, landmarks, gamma, C, calibration_folds, id, seed, max_iter, tol
    )
    fits = len(solved.weights)
    beta = whitening(landmarks, gamma) @ solved.weights[0, :-1]
    held = stage(_held_margins(solved, landmarks.shape[1], landmarks, gamma, fits), "kernel-margins")
    machine = KernelMachineModel(
        inputCol=vector, outputCol="margin", landmarks=landmarks.ravel().tolist(),
        weights=beta.tolist(), bias=float(solved.weights[0, -1]), gamma=float(gamma),
        support=_support(held),
    )
    slope, intercept = fit_platt(held, "m", "y")
    sigmoid = PlattSigmoid(slope=slope, intercept=intercept)
    return PipelineModel([*stages, machine, sigmoid])
