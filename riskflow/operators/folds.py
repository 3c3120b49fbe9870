"""Fold assignment. Every operator needs a unique id and ignores the data layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.contract import FOLDS, SEED
from riskflow.functions.scalar import seeded_hash
from riskflow.operators.ranking import at_or_before, global_rank, group_sizes, hash_cutoffs


def random_folds(
    df: DataFrame, k: int = FOLDS, seed: int = SEED, id: str = "id", out: str = "fold"
) -> DataFrame:
    """Independent fold per row from a seeded hash; a projection without a shuffle."""
    return df.withColumn(out, F.pmod(seeded_hash(seed, id), F.lit(k)).cast("int"))


def ordered_folds(
    df: DataFrame,
    order_by: str,
    tie_breaker: str | Sequence[str] = "id",
    k: int = FOLDS,
    out: str = "fold",
) -> DataFrame:
    """Position in the order, modulo ``k``; positions start at 1."""
    ranked = global_rank(df, order_by, tie_breaker, out="_rank")
    return ranked.withColumn(out, (F.col("_rank") % F.lit(k)).cast("int")).drop("_rank")


def stratified_folds(
    df: DataFrame,
    label: str,
    k: int = FOLDS,
    seed: int = SEED,
    id: str = "id",
    out: str = "fold",
) -> DataFrame:
    """Shuffled folds in which each class is spread evenly (sizes differ by at most one).

    Each class is ordered by a seeded hash and cut into ``k`` runs. Only the cut points
    are looked up, so the rows themselves are not shuffled; a label of very many classes is
    ranked instead, with the same result. Rows without a label form a class of their own.
    """
    hashed = seeded_hash(seed, id)
    sizes = group_sizes(df, label)
    if sizes is None:
        ranked = global_rank(
            df.withColumn("_h", hashed), "_h", id, by=label, out="_rank", size="_size"
        )
        fold = sum(
            (F.col("_rank") > F.floor(F.col("_size") * F.lit(i) / F.lit(k))).cast("int")
            for i in range(1, k)
        )
        return ranked.withColumn(out, fold).drop("_h", "_rank", "_size")
    ranks = {c: [n * i // k for i in range(1, k)] for c, n in sizes.items()}
    cutoffs = hash_cutoffs(df, hashed, id, ranks, by=label)
    keyed = df.withColumn("_h", hashed)
    fold = F.lit(None).cast("int")
    for c, marks in cutoffs.items():
        beyond = sum((~at_or_before(F.col("_h"), id, m)).cast("int") for m in marks)
        fold = F.when(F.col(label).eqNullSafe(F.lit(c)), beyond).otherwise(fold)
    return keyed.withColumn(out, fold).drop("_h")


def fold_split(df: DataFrame, i: int, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Rows outside and inside fold ``i``."""
    return df.filter(F.col(fold) != F.lit(i)), df.filter(F.col(fold) == F.lit(i))
