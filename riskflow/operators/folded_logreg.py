"""Logistic regression for all folds at once.

Each fold's model is fitted on the rows of the other folds. One pass over the rows gives,
for every model at its own coefficients, the loss, the gradient and the Hessian; partial
sums are made in the tasks and added up by position, so what reaches the driver depends on
the numbers of folds and features only, and the number of passes not on the folds. Means,
deviations and class counts of "all folds but one" are merged from those of single folds,
which one scan gives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.contract import FOLDS
from riskflow.workspace import stage

#: A Hessian of this many features for each fold is held by every task.
MOST_FEATURES = 1_000
#: Mean gradient (by row) at which a model counts as fitted.
TOLERANCE = 1e-10


@dataclass(frozen=True)
class Partial:
    """Mergeable moments: rows, means and sums of squared distances from the mean."""

    n: float
    mean: np.ndarray
    m2: np.ndarray

    def __add__(self, other: Partial) -> Partial:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        return Partial(
            n, self.mean + gap * (other.n / n), self.m2 + other.m2 + gap * gap * (self.n * other.n / n)
        )

    def deviation(self, ddof: int) -> np.ndarray:
        return np.sqrt(self.m2 / max(self.n - ddof, 1))


def fold_partials(
    df: DataFrame, features: Sequence[str], by: Sequence[str]
) -> dict[tuple, Partial]:
    """Moments of the features in each group, from one scan; nulls and NaN are refused."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in features])
    cells = [F.count("*").alias("n"), F.count_if(bad).alias("bad")]
    for i, c in enumerate(features):
        x = F.col(c).cast("double")
        cells += [F.avg(x).alias(f"mean{i}"), F.var_pop(x).alias(f"var{i}")]
    rows = df.groupBy(*by).agg(*cells).collect()
    if any(r["bad"] for r in rows):
        raise ValueError("null or NaN in the features of a logistic regression")
    d = range(len(features))
    return {
        tuple(r[c] for c in by): Partial(
            float(r["n"]), np.array([r[f"mean{i}"] for i in d]), np.array([r[f"var{i}"] for i in d]) * r["n"]
        )
        for r in rows
    }


def all_but(parts: dict[tuple, Partial], fold: int, width: int) -> Partial:
    """Merged moments of every group outside a fold; the fold is the first key."""
    zero = Partial(0.0, np.zeros(width), np.zeros(width))
    return sum((p for key, p in sorted(parts.items()) if key[0] != fold), zero)


@dataclass(frozen=True)
class FoldModels:
    """A model for each fold: coefficients and intercept on the scale of the features."""

    features: tuple[str, ...]
    coefficients: np.ndarray
    intercepts: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    weights: np.ndarray  # of class 0 and class 1 among a model's rows
    passes: int

    def logit(self, fold: int) -> Column:
        total = F.lit(float(self.intercepts[fold]))
        for name, w in zip(self.features, self.coefficients[fold]):
            total = total + F.col(name) * F.lit(float(w))
        return total

    def probability(self, fold: str = "fold") -> Column:
        """Score of a row by the model that did not see its fold."""
        out = F.lit(None).cast("double")
        for i in range(len(self.intercepts)):
            out = F.when(F.col(fold) == i, F.lit(1.0) / (F.lit(1.0) + F.exp(-self.logit(i)))).otherwise(out)
        return out


def fit_logreg_folds(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    fold: str = "fold",
    k: int = FOLDS,
    balanced: bool = False,
    C: float | None = None,
    penalise_intercept: bool = True,
    max_passes: int = 100,
) -> FoldModels:
    """Fit ``k`` models by Newton steps that are halved while they do not lower the loss.

    ``C`` sets an L2 penalty of strength 1/C on the coefficients of the features scaled by
    their population deviation, and on the intercept as well unless told otherwise.
    ``balanced`` weighs rows so that a model's two classes count alike. Labels are 0 and 1;
    folds are 0 to ``k - 1``. A constant feature gets the coefficient 0.
    """
    d = len(features)
    if d > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    parts = fold_partials(df, features, [fold, label])
    if any(y not in (0, 1) for _, y in parts):
        raise ValueError("labels other than 0 and 1")
    merged = [all_but(parts, i, d) for i in range(k)]
    means = np.array([m.mean for m in merged])
    deviations = np.array([m.deviation(0) for m in merged])
    scale = np.where(deviations > 0, deviations, np.inf)
    counts = np.array([[sum(p.n for (f, y), p in parts.items() if f != i and y == c) for c in (0, 1)] for i in range(k)])
    rows = counts.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        weights = np.where(counts > 0, rows[:, None] / (2 * counts), 0.0) if balanced else np.ones((k, 2))
    penalty = np.full(d + 1, 1.0 / C if C else 0.0)
    if not penalise_intercept:
        penalty[-1] = 0.0
    slim = df.select(
        F.col(fold).cast("int").alias("fold"), F.col(label).cast("double").alias("y"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
    )
    size = 1 + (d + 1) + (d + 1) ** 2

    def at(theta: np.ndarray, going: list[int]) -> np.ndarray:
        """Loss, gradient and Hessian of each model in ``going``, from one pass."""

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(going), size))
            for batch in batches:
                if not len(batch):
                    continue
                x, y, own = np.stack(batch["x"].to_numpy()), batch["y"].to_numpy(), batch["fold"].to_numpy()
                for place, j in enumerate(going):
                    seen = own != j
                    z = np.column_stack([(x[seen] - means[j]) / scale[j], np.ones(seen.sum())])
                    t, w = y[seen], weights[j][y[seen].astype(int)]
                    m = z @ theta[j]
                    p = np.exp(-np.logaddexp(0.0, -m))
                    total[place, 0] += (w * (np.logaddexp(0.0, m) - t * m)).sum()
                    total[place, 1 : d + 2] += z.T @ (w * (p - t))
                    total[place, d + 2 :] += (z.T @ (z * (w * p * (1 - p))[:, None])).ravel()
            yield pd.DataFrame({"pos": np.arange(total.size), "v": total.ravel()})

        added = slim.mapInPandas(sums, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v"))
        got = added.toPandas()  # len(going) * size rows
        out = np.zeros(len(going) * size)
        out[got["pos"].to_numpy()] = got["v"].to_numpy()
        return out.reshape(len(going), size)

    theta = np.zeros((k, d + 1))
    best, least = theta.copy(), np.full(k, np.inf)
    move, step = np.zeros((k, d + 1)), np.ones(k)
    going, passes = [i for i in range(k) if rows[i]], 0
    while going and passes < max_passes:
        found, passes = at(theta, going), passes + 1
        still = []
        for j, sums in zip(going, found):
            loss = sums[0] + 0.5 * (penalty * theta[j] ** 2).sum()
            if loss > least[j] + 1e-12 * abs(least[j]) or math.isnan(loss):
                step[j] /= 2
                theta[j] = best[j] + step[j] * move[j]
                if step[j] > 1e-6:
                    still.append(j)
                continue
            best[j], least[j] = theta[j], loss
            gradient = sums[1 : d + 2] + penalty * theta[j]
            if np.abs(gradient).max() <= TOLERANCE * rows[j]:
                continue
            hessian = sums[d + 2 :].reshape(d + 1, d + 1) + np.diag(penalty)
            move[j], step[j] = -np.linalg.pinv(hessian, hermitian=True) @ gradient, 1.0
            theta[j] = best[j] + move[j]
            still.append(j)
        going = still
    coefficients = best[:, :d] / scale
    intercepts = best[:, d] - (coefficients * means).sum(axis=1)
    return FoldModels(tuple(features), coefficients, intercepts, means, deviations, weights, passes)


def cross_validate_logreg(
    df: DataFrame, features: Sequence[str], label: str, id: str = "id", fold: str = "fold", k: int = FOLDS,
    **settings,
) -> DataFrame:
    """Out-of-fold ``id, fold, label, prediction, score`` of every row."""
    slim = stage(df.select(id, fold, label, *features), "folds")
    score = fit_logreg_folds(slim, features, label, fold, k, **settings).probability(fold)
    scored = slim.select(id, fold, F.col(label).alias("label"), score.alias("score"))
    return stage(scored.withColumn("prediction", (F.col("score") > 0.5).cast("double")), "out-of-fold").select(
        id, fold, "label", "prediction", "score"
    )


def fold_gradients(
    df: DataFrame, models: FoldModels, label: str, fold: str = "fold", C: float | None = None,
    penalise_intercept: bool = True,
) -> DataFrame:
    """(fold, feature, rows, gradient): mean gradient of each model's loss, by columns alone.

    It is zero where a model is optimal. The intercept is the last feature.
    """
    names, k = [*models.features, "intercept"], len(models.intercepts)
    cells = []
    for i in range(k):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-models.logit(i)))
        w = F.when(F.col(label) == 1, F.lit(float(models.weights[i][1]))).otherwise(F.lit(float(models.weights[i][0])))
        seen = F.col(fold) != i
        cells.append(F.count_if(seen).alias(f"n{i}"))
        scaled = models.coefficients[i] * models.deviations[i]
        inner = models.intercepts[i] + (models.coefficients[i] * models.means[i]).sum()
        for j, theta in enumerate([*scaled, inner if penalise_intercept else 0.0]):
            z = F.lit(1.0)
            if j < len(scaled):
                spread = float(models.deviations[i][j])
                z = (F.col(names[j]) - F.lit(float(models.means[i][j]))) / F.lit(spread if spread > 0 else math.inf)
            total = F.sum(F.when(seen, w * (p - F.col(label)) * z)) + F.lit(theta / C if C else 0.0)
            cells.append((total / F.count_if(seen)).alias(f"g{i}_{j}"))
    rows = [
        F.struct(F.lit(i).alias("fold"), F.lit(name).alias("feature"), F.col(f"n{i}").alias("rows"),
                 F.col(f"g{i}_{j}").alias("gradient"))
        for i in range(k) for j, name in enumerate(names)
    ]
    return df.agg(*cells).select(F.inline(F.array(*rows)))
