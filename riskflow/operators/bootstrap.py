"""Bootstrap of count metrics, and the reliability score built on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.contract import REPLICATES, SEED
from riskflow.functions.scalar import clamp, poisson_one, reliability_tier, seeded_uniform
from riskflow.operators.evaluate import confusion, metrics_from_counts

_METRICS = ["accuracy", "f1", "precision", "recall"]
_CELLS = ["tp", "tn", "fp", "fn"]
# Counters a row feeds at once; wider rows make generated methods too large to be compiled.
_BLOCK = 5


def bootstrap_weights(
    df: DataFrame, replicates: int = REPLICATES, seed: int = SEED, id: str = "id"
) -> DataFrame:
    """Each row once per replicate it is drawn in, with its Poisson(1) number of draws."""
    drawn = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    weight = poisson_one(seeded_uniform(seed, "replicate", id))
    return drawn.withColumn("weight", weight).filter(F.col("weight") > 0)


def _weighted_cells(
    df: DataFrame, label: str, prediction: str, replicates: int, seed: int, id: str
) -> DataFrame:
    """Weighted outcome counts of each replicate, from counters kept beside each outcome.

    A row adds its draws to ``_BLOCK`` counters of its outcome at once, so a task sends on a
    row of counters per outcome and block of replicates, however many rows it read.
    """
    y, p = F.col(label) == 1, F.col(prediction) == 1
    outcome = F.when(y & p, "tp").when(~y & ~p, "tn").when(~y & p, "fp").when(y & ~p, "fn")
    rows = df.select(outcome.alias("_cell"), F.col(id).alias("_id"))
    block = F.lit(0)
    if replicates > _BLOCK:
        blocks = F.sequence(F.lit(0), F.lit((replicates - 1) // _BLOCK))
        rows = rows.withColumn("_block", F.explode(blocks))
        block = F.col("_block")
    names = {j: f"_u{j}" for j in range(1, min(replicates, _BLOCK) + 1)}
    replicate = {j: block * F.lit(_BLOCK) + F.lit(j) for j in names}
    uniform = rows.select(
        "_cell", block.alias("_block"),
        *[seeded_uniform(seed, replicate[j], "_id").alias(u) for j, u in names.items()],
    )
    counted = uniform.groupBy("_cell", "_block").agg(
        *[F.sum(poisson_one(F.col(u))).alias(u) for u in names.values()]
    )
    each = F.explode(F.array(*[
        F.struct((F.col("_block") * F.lit(_BLOCK) + F.lit(j)).alias("replicate"), F.col(u).alias("draws"))
        for j, u in names.items()
    ]))
    drawn = counted.select("_cell", each.alias("_e")).select("_cell", "_e.*")
    return drawn.where((F.col("replicate") <= replicates) & (F.col("draws") > 0)).groupBy("replicate").agg(
        *[F.sum(F.when(F.col("_cell") == c, F.col("draws")).otherwise(0)).alias(c) for c in _CELLS]
    )


def _multinomial(seed: int):
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = _CELLS
        for batch in batches:
            counts = batch[cells].to_numpy()
            rows = np.zeros_like(counts)
            for i, (replicate, c) in enumerate(zip(batch["replicate"], counts)):
                if c.sum() > 0:
                    rng = np.random.default_rng([seed, int(replicate)])
                    rows[i] = rng.multinomial(c.sum(), c / c.sum())
            yield pd.DataFrame(rows, columns=cells).assign(replicate=batch["replicate"].to_numpy())

    return draw


def bootstrap_metrics(
    df: DataFrame,
    label: str,
    prediction: str,
    replicates: int = REPLICATES,
    seed: int = SEED,
    id: str = "id",
    mode: str = "multinomial",
) -> DataFrame:
    """Accuracy, F1, precision and recall of each bootstrap replicate.

    ``multinomial`` counts the four outcomes once and draws the counts of a resample of
    exactly n rows, which has the same distribution as drawing the rows one by one: one
    pass whatever the number of replicates. ``poisson`` weights the rows themselves; rows whose
    outcome is unknown count for none, and a replicate that draws no row is left out.
    """
    if mode == "multinomial":
        counts = confusion(df, label, prediction).withColumn(
            "replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))
        )
        schema = "tp bigint, tn bigint, fp bigint, fn bigint, replicate int"
        cells = counts.mapInPandas(_multinomial(seed), schema)
    elif mode == "poisson":
        cells = _weighted_cells(df, label, prediction, replicates, seed, id)
    else:
        raise ValueError(f"unknown mode {mode}")
    metrics = metrics_from_counts(*[F.col(c) for c in _CELLS])
    return cells.select("replicate", *[metrics[m].alias(m) for m in _METRICS])


def bootstrap_report(reps: DataFrame) -> DataFrame:
    """Rows ``(metric, mean, std)``; the std is the sample one."""
    wide = reps.agg(
        *[F.avg(m).alias(f"{m}_mean") for m in _METRICS],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in _METRICS],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"{m}_mean").alias("mean"),
                F.col(f"{m}_std").alias("std"),
            )
            for m in _METRICS
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def reliability_score(summary: DataFrame) -> DataFrame:
    """One row ``(score, tier)`` from a ``bootstrap_report``."""

    def pick(metric: str, column: str):
        return F.max(F.when(F.col("metric") == metric, F.col(column)))

    raw = summary.agg(
        pick("accuracy", "mean").alias("_acc"),
        pick("f1", "mean").alias("_f1"),
        pick("accuracy", "std").alias("_std"),
    )
    score = F.col("_acc") * 0.6 + F.col("_f1") * 0.4 - F.col("_std") * 2.0
    return raw.select(clamp(score).alias("score")).withColumn("tier", reliability_tier("score"))
