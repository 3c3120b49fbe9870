"""What the driver plans for the tree of op13."""

import numpy as np
from pyspark.sql import functions as F

from riskflow.llm import hard_negatives


def test_searches_of_all_levels_are_scans(spark):
    """Leaves that a search reaches are read from staged tables; levels add no joins to the plan."""
    x = np.random.default_rng(3).integers(-40, 40, size=(300, 4))
    rows = spark.createDataFrame(
        [(i, i, i % 3, v.tolist()) for i, v in enumerate(x)], "key long, id long, label int, vec array<long>"
    )
    tree = hard_negatives.Tree.grow(rows, hard_negatives._Space(4, int((x * x).sum(axis=1).max()), 40), fan=3, leaf_rows=10)
    assert len(tree.levels) >= 3
    open_end = F.array(F.lit(None).cast("long"))
    reached = tree.reached(rows.limit(9).select("key", "vec").withColumns({"low": open_end, "high": open_end}))
    plan = reached._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    # Open windows leave nothing out: every search comes to every leaf.
    assert reached.count() == 9 * tree.leaves.select("node").distinct().count()
