"""The approximate join where queries and rows are packed and stream past each other."""

import pickle

import numpy as np
import pytest

from riskflow.operators import neighbors
from riskflow.operators.neighbors import approx_knn_join


def _table(spark, x, groups, kind="double", ids=None):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), int(g), int(i) % 3, v.tolist()) for i, g, v in zip(ids, groups, x)]
    return spark.createDataFrame(rows, f"id long, g int, label int, v array<{kind}>")


def test_rows_are_not_copied_by_bucket(spark, monkeypatch):
    """On vectors without structure a query looks into buckets with most of the rows; it does not travel to them."""
    x = np.round(np.random.default_rng(3).normal(size=(2_600, 64)), 3)
    df = _table(spark, x, np.arange(len(x)), "float")
    copies = []

    def spy(visits, blocks, *args):
        copies.append(visits.count() + blocks.count())
        return visit(visits, blocks, *args)

    visit = neighbors._visit
    monkeypatch.setattr(neighbors, "_visit", spy)
    got = approx_knn_join(df, df, 3, "v", exclude="id").collect()
    assert sum(copies) <= 2 * len(x), copies
    x = x.astype(np.float32).astype(float)
    gaps = (x * x).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * x @ x.T
    np.fill_diagonal(gaps, np.inf)
    near = {(i, int(j)) for i, row in enumerate(np.argsort(gaps, axis=1)[:, :3]) for j in row}
    assert len(near & {(r.query_id, r.base_id) for r in got}) >= 0.9 * len(near)
    for r in got[::50]:
        assert r.distance == pytest.approx(gaps[r.query_id, r.base_id] ** 0.5, abs=1e-7)


@pytest.mark.parametrize("exclude, kind", [("id", "float"), ("g", "double"), (None, "double")])
def test_packs_give_the_pairs_of_buckets(spark, monkeypatch, exclude, kind):
    rng = np.random.default_rng(4)
    x = np.round(np.repeat(rng.normal(scale=3, size=(12, 5)), 40, axis=0) + rng.normal(size=(480, 5)), 2)
    x[300:310] = x[300]  # copies of one vector
    df = _table(spark, x, np.arange(480) % 4, kind)
    args = dict(k=4, features="v", exclude=exclude, carry=["label"], block_rows=50, query_rows=70)
    want = approx_knn_join(df.filter("id % 2 = 0"), df, **args).collect()
    monkeypatch.setattr(neighbors, "MEET_NUMBERS", 0)
    monkeypatch.setattr(neighbors, "_visit", None)
    got = approx_knn_join(df.filter("id % 2 = 0"), df, **args).collect()
    assert len(got) > 900 and sorted(got) == sorted(want)


def test_packs_with_repeated_rows_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "MEET_NUMBERS", 0)
    x = np.arange(30.0)[:, None] * [1.0, 0.5]
    df = _table(spark, x, np.zeros(30))
    once = approx_knn_join(df, df, 3, "v", exclude="id", cover=1.0).collect()
    nameless = df.limit(2).selectExpr("cast(null as long) id", "g", "label", "v")
    twice = approx_knn_join(df.union(df).union(nameless), df.union(df), 3, "v", exclude="id", cover=1.0).collect()
    assert len(once) > 60 and sorted(once) == sorted(twice)
    assert approx_knn_join(df, df.limit(0), 3, "v").count() == 0
    assert approx_knn_join(df.limit(0), df, 3, "v").count() == 0
    assert approx_knn_join(df, df.limit(1), 3, "v").count() <= 30


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e18])
def test_packed_search_equals_brute_force(scale):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8)) * scale
    x[::50] *= 30  # some far from all others
    hashes = neighbors._Hashes(8, 4, 3, 6, 1)
    hashes.fit(x, 5, 0.7)
    ids, group = rng.permutation(700), np.arange(700) % 9
    asks = neighbors._Asking(pickle.dumps((x[:300], {"_id": ids[:300], "_group": group[:300]}, None)), hashes, 5)
    best = neighbors._Best(asks.id, 5)
    for at in range(0, 700, 250):
        part = slice(at, at + 250)
        others = {"_id": ids[part], "_group": group[part]}
        buckets = neighbors._places(hashes.own(x[part]))
        best.add(*neighbors._search_shared(asks, x[part], ids[part], group[part], buckets, best.limit), others)
    own, looks, want = hashes.own(x), hashes.probed(x[:300]), []
    for i in range(300):
        shared = np.isin(own, looks[i]).any(axis=1) & (group != group[i])
        dist = np.floor(((x - x[i]) ** 2).sum(axis=1) * 1e9 + 0.5)
        # The order of the sum may change the last digits of a large distance.
        want += [(ids[i], ids[j]) for j in sorted(np.flatnonzero(shared), key=lambda j: (dist[j], ids[j]))[:5]]
    got = best.frame()
    assert sorted(zip(got["query_id"], got["base_id"])) == sorted(want) and len(want) > 1_000
    far = neighbors._places(hashes.own(x + 1e6 * scale))
    assert not len(neighbors._search_shared(asks, x + 1e6 * scale, ids, group, far, best.limit)[0])


def test_a_pack_holds_a_repeated_row_once(spark):
    x = np.repeat(np.arange(20.0)[:, None] * [1.0, 2.0], 3, axis=0)
    df = _table(spark, x, np.zeros(60), ids=np.repeat(np.arange(20), 3)).selectExpr("id _id", "g _group", "v _vec")
    hashes = neighbors._Hashes(2, 3, 2, 4, 1)
    packs = spark.read.parquet(neighbors._packed(df, hashes, 100, 1, "packs", own=True)).collect()
    rows, others, (codes, at) = pickle.loads(packs[0]["_rows"])
    assert len(packs) == 1 and sorted(others["_id"]) == list(range(20)) and len(rows) == 20
    assert (codes[at] == hashes.own(rows)).all()
    packs = spark.read.parquet(neighbors._packed(df, hashes, 7, 3, "packs", own=False)).collect()
    sizes = [len(pickle.loads(p["_rows"])[0]) for p in packs]
    assert sum(sizes) == 60 and max(sizes) <= 7 and len({p["_pack"] for p in packs}) == len(packs)
