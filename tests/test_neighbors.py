"""Nearest neighbours against brute force, in both physical forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.operators.neighbors import approx_knn_join, knn_classify, knn_join

FORMS = [
    {"mode": "broadcast"},
    {"mode": "blocked", "block_rows": 40, "query_rows": 30},
    {"mode": "blocked", "block_rows": 7, "query_rows": 5},
    {"mode": "blocked"},
]


def _brute(ids, x, group, k):
    out = []
    for i in range(len(ids)):
        d = np.floor(((x - x[i]) ** 2).sum(axis=1) * 1e9 + 0.5)
        allowed = np.nonzero(group != group[i])[0]
        best = sorted(allowed, key=lambda j: (d[j], ids[j]))[:k]
        out += [(ids[i], ids[j], r + 1) for r, j in enumerate(best)]
    return sorted(out)


def _frame(spark, ids, x, group):
    cols = [f"f{i}" for i in range(x.shape[1])]
    rows = [(int(i), int(g), *map(float, v)) for i, g, v in zip(ids, group, x)]
    schema = "id bigint, g int, " + ", ".join(f"{c} double" for c in cols)
    return spark.createDataFrame(rows, schema).repartition(5), cols


def _check(spark, x, group, k, form, exclude="g"):
    ids = np.random.default_rng(1).permutation(len(x))
    df, cols = _frame(spark, ids, x, group)
    got = knn_join(df, df, k, cols, "id", exclude=exclude, **form).collect()
    keys = ids if exclude == "id" else group
    assert sorted((r.query_id, r.base_id, r["rank"]) for r in got) == _brute(ids, x, keys, k)


@pytest.mark.parametrize("form", FORMS)
def test_scattered_points(spark, form):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(160, 3)), 3)
    _check(spark, x, rng.integers(0, 5, 160), 5, form)


@pytest.mark.parametrize("form", FORMS)
def test_clusters_and_copies(spark, form):
    """A third of the rows are one vector; the rest sit in tight clusters with ties."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, size=(180, 2)).astype(float) + rng.integers(0, 4, size=(180, 1)) * 50.0
    x[:60] = 1.0
    _check(spark, x, rng.integers(0, 5, 180), 5, form)
    _check(spark, x, rng.integers(0, 5, 180), 3, form, exclude="id")


@pytest.mark.parametrize("form", FORMS)
def test_fewer_candidates_than_k(spark, form):
    x = np.arange(8, dtype=float)[:, None]
    _check(spark, x, np.array([0, 0, 0, 0, 0, 0, 1, 1]), 5, form)


def test_blocked_prunes_but_stays_exact(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(scale=100, size=(12, 4))
    x = np.round(np.repeat(centers, 30, axis=0) + rng.normal(size=(360, 4)), 3)
    _check(spark, x, np.arange(360) % 5, 4, {"mode": "blocked", "block_rows": 25})


def test_array_features_and_carry(spark):
    df = spark.createDataFrame(
        [(1, [0.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (3, [5.0, 0.0], "c")],
        "id int, v array<float>, name string",
    )
    rows = knn_join(df, df, 1, "v", "id", exclude="id", carry=["name"]).orderBy("query_id").collect()
    assert [(r.query_id, r.base_id, r.name, r.distance) for r in rows] == [
        (1, 2, "b", 1.0), (2, 1, "a", 1.0), (3, 2, "b", 4.0)
    ]


def test_without_exclusion_a_row_finds_itself(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0)], "id int, x double")
    rows = knn_join(df, df, 1, ["x"], "id").collect()
    assert {(r.query_id, r.base_id) for r in rows} == {(1, 1), (2, 2)}


def test_vote_and_smallest_class_on_a_tie(spark):
    base = spark.createDataFrame(
        [(1, 0.0, 2), (2, 0.1, 1), (3, 0.2, 1), (4, 0.3, 2), (5, 9.0, 3)], "id int, x double, y int"
    )
    query = spark.createDataFrame([(10, 0.0)], "id int, x double")
    four = knn_classify(query, base, 4, ["x"], "y").collect()[0]
    three = knn_classify(query, base, 3, ["x"], "y").collect()[0]
    assert (four.prediction, three.prediction) == (1.0, 1.0)
    assert three.score == pytest.approx(2 / 3)


def test_missing_feature_is_an_error(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0)], "id int, x double")
    with pytest.raises(Exception, match="NaN"):
        knn_join(df, df, 1, ["x"], "id", mode="broadcast").collect()


def test_text_ids(spark):
    df = spark.range(60).select(
        F.concat(F.lit("r"), F.col("id")).alias("id"), (F.col("id") * 1.0).alias("x")
    )
    forms = [
        {(r.query_id, r.base_id, r["rank"]) for r in
         knn_join(df, df, 2, ["x"], "id", exclude="id", mode=m, block_rows=10).collect()}
        for m in ("broadcast", "blocked")
    ]
    assert forms[0] == forms[1] and len(forms[0]) == 120


def test_rounds_bound_what_is_staged(spark, monkeypatch):
    """On vectors without structure every block is visited, but only a few cells in a round."""
    from riskflow.operators import neighbors

    rng = np.random.default_rng(8)
    x = np.round(rng.uniform(size=(600, 64)), 3)
    staged = []

    def spy(df, name):
        out = neighbors_stage(df, name)
        if name in ("knn-home", "knn-visits"):
            staged.append(out.groupBy("_id").count().agg(F.max("count")).first()[0] or 0)
        return out

    neighbors_stage = neighbors.stage
    monkeypatch.setattr(neighbors, "stage", spy)
    monkeypatch.setattr(neighbors, "ROUND_CELLS", 4)
    _check(spark, x, np.arange(600), 3, {"mode": "blocked", "block_rows": 30}, exclude="id")
    # 20 cells of one to three blocks each; a round goes through at most four cells.
    assert staged[0] == 1 and max(staged) <= 12 and len(staged) >= 6


def test_close_queries_stop_after_home(spark, monkeypatch):
    """With far clusters no cell but a query's own is in reach in any round."""
    from riskflow.operators import neighbors

    rng = np.random.default_rng(5)
    x = np.round(np.repeat(np.eye(5) * 1000, 40, axis=0) + rng.normal(size=(200, 5)), 3)
    pairs = []

    def spy(visits, *args):
        out = neighbors_visit(visits, *args)
        pairs.append(visits.count())
        return out

    neighbors_visit = neighbors._visit
    monkeypatch.setattr(neighbors, "_visit", spy)
    _check(spark, x, np.arange(200) % 7, 3, {"mode": "blocked", "block_rows": 10})
    # All 20 and more blocks of each query would be 4,000 visits.
    assert pairs[0] == 200 and sum(pairs) < 2_500


def test_large_base_is_not_broadcast(spark, monkeypatch):
    from riskflow.operators import neighbors

    monkeypatch.setattr(neighbors, "BROADCAST_NUMBERS", 10)
    df, cols = _frame(spark, np.arange(30), np.ones((30, 2)), np.zeros(30))
    with pytest.raises(ValueError, match="not sent"):
        knn_join(df, df, 2, cols, exclude="id", mode="broadcast")


def test_approximate_join_finds_nine_of_ten(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir.replace('sf0.001', 'sf0.01')}/embeddings.parquet")
    args = (rows, rows, 5, "embedding", "vec_id", "vec_id")
    exact = {(r.query_id, r.base_id): r.distance for r in knn_join(*args).collect()}
    got = approx_knn_join(*args, block_rows=100, query_rows=200).collect()
    found = {(r.query_id, r.base_id): r.distance for r in got}
    assert len(found) == len(got) and all(found[p] == exact[p] for p in found.keys() & exact.keys())
    assert len(found.keys() & exact.keys()) >= 0.9 * len(exact)
    assert max(r["rank"] for r in got) <= 5


def test_approximate_join_measures_rows_of_shared_buckets_only(spark, monkeypatch):
    """Clusters far apart share no bucket, so no pair across them is formed."""
    from riskflow.operators import neighbors

    rng = np.random.default_rng(6)
    x = np.round(np.repeat(rng.normal(scale=200, size=(20, 6)), 30, axis=0) + rng.normal(size=(600, 6)), 3)
    seen = []
    visit = neighbors._visit

    def spy(visits, blocks, *args):
        seen.append(visits.select("_id", "_block").join(blocks.select(F.col("_id").alias("b"), "_block"), "_block")
                    .select("_id", "b").distinct().collect())
        return visit(visits, blocks, *args)

    monkeypatch.setattr(neighbors, "_visit", spy)
    df, cols = _frame(spark, np.arange(600), x, np.arange(600) // 30)
    got = approx_knn_join(df, df, 4, cols, exclude="id").collect()
    assert {r.query_id // 30 == r.base_id // 30 for r in got} == {True}
    brute = _brute(np.arange(600), x, np.arange(600), 4)
    assert len({(r.query_id, r.base_id) for r in got} & {b[:2] for b in brute}) >= 0.9 * len(brute)
    assert len(seen[0]) < 0.15 * 600 * 600


def test_approximate_join_edges(spark):
    df, cols = _frame(spark, np.arange(40), np.ones((40, 3)), np.arange(40) % 4)
    got = approx_knn_join(df, df, 3, cols, exclude="g").collect()  # copies of one vector
    assert sorted((r.query_id, r.base_id, r["rank"]) for r in got) == _brute(np.arange(40), np.ones((40, 3)), np.arange(40) % 4, 3)
    assert approx_knn_join(df, df.limit(0), 3, cols).count() == 0
    assert approx_knn_join(df.limit(0), df, 3, cols).count() == 0


def test_buckets_of_a_batch_are_not_held_together(spark, monkeypatch):
    """What a task holds of a batch's buckets does not grow with the rows of the batch."""
    import tracemalloc

    import pandas as pd

    from riskflow.operators import neighbors

    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 8)))], "id long, v array<double>")
    steps, plain = [], type(df).mapInPandas

    def spy(self, fn, schema, *args, **named):
        steps.append((fn, schema))
        return plain(self, fn, schema, *args, **named)

    monkeypatch.setattr(type(df), "mapInPandas", spy)
    neighbors.approx_knn_join(df, df, 3, "v", exclude="id")
    steps = [fn for fn, schema in steps if "_bucket" in schema.fieldNames()]
    x, peaks = rng.normal(size=(20_000, 8)), []
    batch = pd.DataFrame({"_id": np.arange(len(x)), "_group": np.arange(len(x)), "_vec": list(x)})
    for fn in steps:
        tracemalloc.start()
        rows = sum(len(out) for out in fn(iter([batch])))
        peaks.append(tracemalloc.get_traced_memory()[1] >> 20)
        tracemalloc.stop()
        assert rows in (20_000 * 8, 20_000 * 8 * 12)
    assert len(steps) == 2 and max(peaks) < 12, peaks


def test_ties_are_measured_a_few_at_a_time():
    """Equal distances to all rows make every pair a candidate; their vectors are not held together."""
    import tracemalloc

    from riskflow.operators import neighbors

    x = np.eye(512)  # any two rows are equally far
    ids = np.arange(512)
    tracemalloc.start()
    rows, cols, dist = neighbors._search(x[:256], ids[:256], x, ids, ids, 5)
    peak = tracemalloc.get_traced_memory()[1] >> 20
    tracemalloc.stop()
    want = [[j for j in range(6) if j != i][:5] for i in range(256)]
    assert cols.reshape(256, 5).tolist() == want and (dist == 2e9).all()
    assert peak < 100, peak
