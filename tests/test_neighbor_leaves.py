"""The search of one large block by leaves, and what the blocked form is chosen for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.operators import neighbors


@pytest.mark.parametrize("groups", [False, True])
@pytest.mark.parametrize("dim", [2, 8, 40])
def test_leaves_find_what_the_whole_block_holds(dim, groups):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(5_000, dim))
    x[:, 0] = np.round(x[:, 0])
    x[:900] = x[0]  # copies, so ties
    q, ids = x[rng.permutation(5_000)[:300]], rng.permutation(5_000)
    sides = (rng.integers(0, 3, 300), rng.integers(0, 3, 5_000)) if groups else (None, None)
    want = neighbors._search(q, sides[0], x, ids, sides[1], 5)
    got = neighbors._search_leaves(q, sides[0], x, ids, sides[1], 5)
    assert all(np.array_equal(a, b) for a, b in zip(want, got))
    bound = np.full(300, np.inf)
    bound[want[0][4::5]] = want[2][4::5]
    got = neighbors._search_leaves(q, sides[0], x, ids, sides[1], 5, bound)
    assert all(np.array_equal(a, b) for a, b in zip(want, got))


def test_a_query_is_measured_with_few_rows(monkeypatch):
    """Near rows of plane points are in a few leaves, so far fewer pairs are measured than there are."""
    x = np.random.default_rng(1).uniform(size=(40_000, 2))
    pairs, search = [], neighbors._search

    def spy(q, q_group, b, *rest):
        pairs.append(len(q) * len(b))
        return search(q, q_group, b, *rest)

    monkeypatch.setattr(neighbors, "_search", spy)
    neighbors._search_leaves(x[:2_000], None, x, np.arange(40_000), None, 5)
    assert sum(pairs) < 0.1 * 2_000 * 40_000


def test_all_pairs_form_is_not_chosen_for_large_tables(spark, monkeypatch):
    def never(*args):
        raise AssertionError("all pairs")

    monkeypatch.setattr(neighbors, "AUTO_NUMBERS", 100)
    monkeypatch.setattr(neighbors, "_broadcast_join", never)
    df = spark.range(300).select("id", F.col("id").cast("double").alias("x"))
    assert neighbors.knn_join(df, df, 2, ["x"], exclude="id").count() == 600
