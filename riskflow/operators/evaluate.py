"""Classification metrics. ``by`` gives one result per group, in a single pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions.scalar import safe_divide
from riskflow.operators.ranking import running_sum
from riskflow.workspace import stage


def _groups(by: str | Sequence[str] | None) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def _grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by) if by else df.groupBy()


def confusion(
    df: DataFrame, label: str, prediction: str, by: str | Sequence[str] | None = None
) -> DataFrame:
    """Counts tp, tn, fp, fn."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    ny, np_ = F.col(label) == 0, F.col(prediction) == 0
    return _grouped(df, _groups(by)).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(ny & np_).alias("tn"),
        F.count_if(ny & p).alias("fp"),
        F.count_if(y & np_).alias("fn"),
    )


def metrics_from_counts(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Accuracy and positive-class precision, recall, F1; 0 where a denominator is 0."""
    precision, recall = safe_divide(tp, tp + fp), safe_divide(tp, tp + fn)
    return {
        "accuracy": safe_divide(tp + tn, tp + tn + fp + fn),
        "precision": precision,
        "recall": recall,
        "f1": safe_divide(F.lit(2.0) * precision * recall, precision + recall),
    }


def binary_metrics(
    df: DataFrame, label: str, prediction: str, by: str | Sequence[str] | None = None
) -> DataFrame:
    """Samples, accuracy and positive-class precision, recall and F1."""
    counts = confusion(df, label, prediction, by)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.select(
        *_groups(by),
        (tp + tn + fp + fn).alias("samples"),
        *[m.alias(n) for n, m in metrics_from_counts(tp, tn, fp, fn).items()],
    )


def weighted_metrics(
    df: DataFrame, label: str, prediction: str, by: str | Sequence[str] | None = None
) -> DataFrame:
    """Samples, accuracy and per-class precision, recall, F1 weighted by class support."""
    by = _groups(by)
    cells = df.groupBy(
        *by, F.col(label).cast("double").alias("_y"), F.col(prediction).cast("double").alias("_p")
    ).agg(F.count("*").alias("_n"))
    hit = F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.explode(
        F.array(
            F.struct(F.col("_y").alias("c"), F.col("_n").alias("s"), zero.alias("p"),
                     hit.cast("bigint").alias("t")),
            F.struct(F.col("_p").alias("c"), zero.alias("s"), F.col("_n").alias("p"),
                     zero.alias("t")),
        )
    ).alias("x")
    classes = (
        cells.select(*by, sides)
        .groupBy(*by, F.col("x.c").alias("_c"))
        .agg(F.sum("x.s").alias("_s"), F.sum("x.p").alias("_p"), F.sum("x.t").alias("_t"))
        .withColumn("_prec", safe_divide(F.col("_t"), F.col("_p")))
        .withColumn("_rec", safe_divide(F.col("_t"), F.col("_s")))
        .withColumn(
            "_f1",
            safe_divide(F.lit(2.0) * F.col("_prec") * F.col("_rec"), F.col("_prec") + F.col("_rec")),
        )
    )
    total = F.sum("_s")

    def weighted(c: str) -> Column:
        return safe_divide(F.sum(F.col("_s") * F.col(c)), total)

    return _grouped(classes, by).agg(
        total.alias("samples"),
        safe_divide(F.sum("_t"), total).alias("accuracy"),
        weighted("_prec").alias("precision"),
        weighted("_rec").alias("recall"),
        weighted("_f1").alias("f1"),
    )


def _score_steps(
    df: DataFrame, label: str, score: str, by: list[str], descending: bool
) -> DataFrame:
    """Running positives and negatives over the distinct scores of each group.

    Equal scores collapse into one row before anything is ordered. Rows without a score
    are left out, whichever way the scores are ordered.
    """
    df = df.filter(F.col(score).isNotNull())
    steps = df.groupBy(*by, F.col(score).cast("double").alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    ).filter(F.col("_pos") + F.col("_neg") > 0)
    # Written once: bounds, sizes and running sums all read the collapsed rows.
    return running_sum(
        stage(steps, "score-steps"), "_score", None, {"_tp": F.col("_pos"), "_fp": F.col("_neg")},
        by=by or None, descending=descending, totals={"_P": "_tp", "_N": "_fp"},
    )


def auc_exact(
    df: DataFrame, label: str, score: str, by: str | Sequence[str] | None = None
) -> DataFrame:
    """Exact area under the ROC curve; tied scores count half. Null with a single class."""
    by = _groups(by)
    steps = _score_steps(df, label, score, by, descending=False)
    below = F.col("_fp").cast("double") - F.col("_neg") / F.lit(2.0)
    return _grouped(steps, by).agg(
        F.try_divide(
            F.sum(F.col("_pos") * below),
            F.max("_P").cast("double") * F.max("_N").cast("double"),
        ).alias("auc")
    )


def auc_binned(
    df: DataFrame, label: str, score: str, by: str | Sequence[str] | None = None, bins: int = 1000
) -> DataFrame:
    """Area under the ROC curve with probabilities counted in equal-width bins.

    One aggregate to at most ``bins`` rows per group; scores within a bin count as tied.
    """
    by = _groups(by)
    edge = F.least(F.floor(F.col(score) * F.lit(bins)), F.lit(bins - 1))
    binned = df.groupBy(*by, edge.alias("_bin")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    scope = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = scope.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = F.sum("_neg").over(upto).cast("double") - F.col("_neg") / F.lit(2.0)
    return _grouped(binned.withColumn("_below", below), by).agg(
        F.try_divide(
            F.sum(F.col("_pos") * F.col("_below")),
            F.sum("_pos").cast("double") * F.sum("_neg").cast("double"),
        ).alias("auc")
    )


def roc_curve(
    df: DataFrame, label: str, score: str, by: str | Sequence[str] | None = None
) -> DataFrame:
    """Points ``(threshold, fpr, tpr)`` for every distinct score, plus the origin.

    The origin has threshold infinity: no row scores that high.
    """
    by = _groups(by)
    steps = _score_steps(df, label, score, by, descending=True)
    point = F.struct(
        F.col("_score").alias("threshold"),
        F.try_divide(F.col("_fp").cast("double"), F.col("_N").cast("double")).alias("fpr"),
        F.try_divide(F.col("_tp").cast("double"), F.col("_P").cast("double")).alias("tpr"),
    )
    origin = F.struct(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    # The first point of a group is the one whose running counts are its own counts.
    first = (F.col("_tp") == F.col("_pos")) & (F.col("_fp") == F.col("_neg"))
    points = F.when(first, F.array(origin, point)).otherwise(F.array(point))
    return steps.select(*by, F.explode(points).alias("r")).select(*by, "r.*")
