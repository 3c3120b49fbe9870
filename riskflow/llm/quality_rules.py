"""Text quality by a sparse ensemble of rules.

Statistics of a text are Spark columns. A small random forest is grown on the labelled
rows; every path from a root to a node is a conjunctive rule over the statistics. A lasso
logistic fit gives most rules weight zero, and the rules that are left are compiled into
one Spark column, so scoring is a projection without a model object.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import WORD, col, held_out
from riskflow.workspace import stage

TREES, DEPTH, PENALTY, SEED = 16, 4, 2e-4, 42
Rule = tuple[tuple[int, str, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda s: s != "")
    n_words, n_chars = count(WORD), F.length(t).cast("double")
    per = lambda a, b: a / F.greatest(b, F.lit(1.0))
    upper = count(r"\p{Lu}")
    return {
        "log_words": F.log1p(n_words),
        "word_length": per(n_chars, n_words),
        "distinct_words": per(F.size(F.array_distinct(words)).cast("double"), n_words),
        "distinct_lines": per(F.size(F.array_distinct(lines)).cast("double"), F.size(lines).cast("double")),
        "lines_per_word": per(F.size(lines).cast("double"), n_words),
        "upper": per(upper, n_chars),
        "digits": per(count("[0-9]"), n_chars),
        "stops": per(count("[.,;:]"), n_words),
        "signs": per(count(r"[^\p{L}\p{N}\s.,;:'\-]"), n_words),
        "long_words": F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0)).cast("double"),
    }


def paths(debug: str) -> list[Rule]:
    """All root-to-node paths in the printed form of a forest."""
    rules: set[Rule] = set()
    stack: list[tuple[int, tuple[int, str, float]]] = []
    for line in debug.splitlines():
        depth = len(line) - len(line.lstrip())
        if "Tree" in line:
            stack = []
        m = re.search(r"\(feature (\d+) (<=|>) ([-+\d.eE]+)\)", line)
        if not m:
            continue
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, (int(m[1]), m[2], float(m[3]))))
        rules.add(tidy(tuple(c for _, c in stack)))
    return sorted(rules)


def tidy(rule: Rule) -> Rule:
    """Keep the tightest bound of each statistic and side."""
    tight: dict[tuple[int, str], float] = {}
    for i, op, at in rule:
        old = tight.get((i, op))
        tight[i, op] = at if old is None else (min(old, at) if op == "<=" else max(old, at))
    return tuple(sorted((i, op, at) for (i, op), at in tight.items()))


def compile_rule(rule: Rule, names: list[str]) -> Column:
    parts = [F.col(names[i]) <= at if op == "<=" else F.col(names[i]) > at for i, op, at in rule]
    return reduce(lambda a, b: a & b, parts)


def learn(stats: DataFrame, names: list[str]) -> tuple[list[tuple[Rule, float]], float]:
    """(weighted rules, intercept) from rows with statistics and ``y``."""
    counts = {r.y: r.n for r in stats.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        p = min(max(n1 / (n1 + n0), 1e-4), 1 - 1e-4) if n1 + n0 else 0.5
        return [], math.log(p / (1 - p))
    rows = VectorAssembler(inputCols=names, outputCol="x").transform(stats).select("x", "y", *names)
    forest = RandomForestClassifier(
        labelCol="y", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64,
        featureSubsetStrategy="onethird", minInstancesPerNode=5,
    ).fit(rows)
    rules = paths(forest.toDebugString)
    if not rules:
        return [], math.log(n1 / n0)
    fires = F.array(*[compile_rule(r, names).cast("double") for r in rules])
    fit = LogisticRegression(
        labelCol="y", featuresCol="r", elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False
    ).fit(stage(rows.select(array_to_vector(fires).alias("r"), "y"), "quality-rules"))
    kept = [(r, float(w)) for r, w in zip(rules, fit.coefficients.toArray()) if abs(w) > 1e-6]
    return kept, float(fit.intercept)


def score_column(rules: list[tuple[Rule, float]], intercept: float, names: list[str]) -> Column:
    odds = F.lit(intercept)
    for rule, w in rules:
        odds = odds + F.when(compile_rule(rule, names), F.lit(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def score_quality(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", threshold: float = 0.7,
) -> DataFrame:
    """One row per input row: id, held_out, score and predicted.

    Statistics of null and empty texts are those of a text without words; a null id is not
    held out and has no label; a label is the rounded mean of an id's labels; without
    labels of both classes every score is the labels' mean, one half without labels; an
    empty table gives an empty result; other columns are not read.
    """
    made = statistics(F.col("t"))
    names = list(made)
    stats = stage(
        df.select(col(id_col).alias("i"), col(text_col).alias("t"))
        .select("i", *[c.alias(n) for n, c in made.items()]),
        "quality",
    )
    truth = labels.where(col(label_col).isNotNull()).groupBy(col(id_col).alias("i")).agg(
        (F.avg(col(label_col)) >= 0.5).cast("int").alias("y")
    )
    train = stage(stats.where(~held_out(F.col("i"))).join(truth, "i").select(*names, "y"), "quality-train")
    rules, intercept = learn(train, names)
    score = score_column(rules, intercept, names)
    return stats.select(F.col("i").alias(id_col), held_out(F.col("i")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
