"""Fills, scaling, ranks, folds, noise, flips and weights."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskflow.functions.scalar import poisson_one, seeded_normal, seeded_uniform
from riskflow.operators.fold_stats import fill_by_fold, fold_states, held_out_stats, standardize_by_fold
from riskflow.operators.folds import fold_split, ordered_folds, random_folds, stratified_folds
from riskflow.operators.impute import apply_fill, feature_stats, fit_fill
from riskflow.operators.perturb import class_weights, flip_labels, gaussian_jitter
from riskflow.operators.ranking import (
    _numbered,
    _range_count,
    exact_quantiles,
    global_rank,
    hash_cutoffs,
    running_sum,
)
from riskflow.operators.scaling import Moments, apply_standardize, assemble, fit_standardize


def test_mean_fill_does_not_truncate_integers(spark):
    df = spark.createDataFrame([(2,), (3,), (3,), (None,)], "a int")
    fill = fit_fill(df, ["a"])
    assert fill == {"a": pytest.approx(8 / 3)}
    assert sorted(r.a for r in apply_fill(df, fill).collect()) == [2, pytest.approx(8 / 3), 3, 3]


def test_column_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    for strategy, err in (("mean", 0.1), ("median", 0.001), ("median", 0)):
        with pytest.raises(ValueError, match="b"):
            fit_fill(df, ["a", "b"], strategy, err)
        assert list(fit_fill(df, ["a", "b"], strategy, err, on_empty="skip")) == ["a"]


def test_median_approximate_and_exact(spark):
    df = spark.range(1, 1002).select(F.col("id").cast("double").alias("a"))
    assert fit_fill(df, ["a"], "median", 0)["a"] == 501.0
    assert abs(fit_fill(df, ["a"], "median", 0.001)["a"] - 501.0) <= 2


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=40),
       st.sampled_from([0.1, 0.5, 0.9]))
def test_exact_quantile_of_any_list(spark, values, q):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "a double")
    present = sorted(v for v in values if v is not None)
    got = [r.value for r in exact_quantiles(df, ["a"], q).collect()]
    want = [float(present[max(1, math.ceil(len(present) * q)) - 1])] if present else []
    assert got == want


def test_feature_stats(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "a double")
    row = feature_stats(df, ["a"], ("mean", "std", "std_pop", "median", "count")).collect()[0]
    assert (row["feature"], row["mean"], row["std_pop"], row["count"]) == ("a", 2.0, 1.0, 2)
    assert row["std"] == pytest.approx(math.sqrt(2))


def test_zero_deviation_rules(spark):
    df = spark.createDataFrame([(5.0,)], "a double")
    moments = Moments(("a",), (3.0,), (0.0,))
    assert apply_standardize(df, moments, "zero").collect()[0].a == 0.0
    assert apply_standardize(df, moments, "one").collect()[0].a == 2.0


def test_standardize_ddof(spark):
    df = spark.createDataFrame([(0.0,), (2.0,)], "a double")
    assert fit_standardize(df, ["a"], 0).stds == (1.0,)
    assert fit_standardize(df, ["a"], 1).stds == (pytest.approx(math.sqrt(2)),)
    rows = fit_standardize(df, ["a"]).to_df(spark).collect()
    assert (rows[0].feature, rows[0]["mean"]) == ("a", 1.0)


def test_assemble_refuses_null(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    with pytest.raises(Exception, match="null"):
        assemble(df, ["a", "b"]).collect()


def _heavy(spark, n=4000):
    """A third of the rows share one key; ids come in scrambled order."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise((F.col("id") * 37 % 101).cast("double"))
    return spark.range(n).select(
        ((F.col("id") * 7919) % n).alias("id"), key.alias("k"), (F.col("id") % 4).alias("g")
    )


@pytest.mark.parametrize("partitions", [1, 16])
def test_global_rank_with_a_heavy_key(spark, partitions):
    df = _heavy(spark).repartition(partitions)
    ranked = global_rank(df, "k", "id", buckets=16, size="n").collect()
    want = {r.id: i + 1 for i, r in enumerate(sorted(ranked, key=lambda r: (r.k, r.id)))}
    assert all(want[r.id] == r["rank"] and r.n == 4000 for r in ranked)


def test_heavy_key_is_cut_by_the_tie_breaker(spark):
    rows = _numbered(_heavy(spark), "k", "id", [], False, 16)
    assert rows.where("k = 7.0").select("_place").distinct().count() >= 4


_KEYS = {
    "text": "format_string('http://site.example/%04d', id * 37 % 211)",
    "uuid": "md5(string(id))",
    "bigint": "9007199254740992 - 50 + id % 101",
    "decimal": "cast(id % 97 as decimal(30,12)) + 0.000000000001 * (id % 7)",
    "timestamp": "timestamp_micros(1700000000000000 + id % 13)",
    "date": "date_add(date '2020-01-01', int(id % 50))",
    "boolean": "id % 3 = 0",
}


@pytest.mark.parametrize("kind", _KEYS)
def test_rank_of_any_sortable_key_ignores_buckets_and_layout(spark, kind):
    key = F.when(F.col("id") % 29 != 0, F.expr(_KEYS[kind]))
    tie = F.concat(F.lit("id-"), F.col("id").cast("string"))
    df = spark.range(400).select(tie.alias("id"), key.alias("k"))
    rows = sorted(((r.k is not None, r.k), r.id) for r in df.collect() if r.k is not None)
    rows = [i for i in sorted(r.id for r in df.collect() if r.k is None)] + [i for _, i in rows]
    want = {i: n + 1 for n, i in enumerate(rows)}
    for buckets, partitions in ((2, 1), (8, 16), (32, 1), (None, 16)):
        ranked = global_rank(df.repartition(partitions), "k", "id", buckets=buckets)
        assert {r.id: r["rank"] for r in ranked.collect()} == want


def test_descending_text_rank(spark):
    df = spark.range(300).select("id", F.md5((F.col("id") % 70).cast("string")).alias("k"))
    rows = sorted(df.collect(), key=lambda r: r.id)
    rows.sort(key=lambda r: r.k, reverse=True)
    ranked = global_rank(df, "k", "id", descending=True, buckets=16).collect()
    assert {r.id: r["rank"] for r in ranked} == {r.id: n + 1 for n, r in enumerate(rows)}


def test_ranges_stay_even_when_few_keys_are_collapsed(spark):
    ties = spark.range(2000).select(F.lit(0.0).alias("k"))
    some = spark.range(20).select((F.col("id") / 20.0 + 0.01).alias("k"))
    rows = ties.union(some).groupBy("k").agg(F.count("*").alias("n"))
    sizes = [r["count"] for r in _numbered(rows, "k", None, [], False, 7).groupBy("_place").count().collect()]
    assert len(sizes) == 7 and max(sizes) <= 4


def test_ranges_grow_with_the_rows(spark):
    assert [_range_count(spark.range(n)) for n in (0, 15_000, 500_000, 20_000_000)] == [1, 1, 8, 20]


def test_values_of_a_group_cut_by_ranges(spark):
    """A group with a third of the rows spans ranges; others share one."""
    df = _heavy(spark, 3000).withColumn("g", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    rows = global_rank(df, "k", "id", by="g", size="n", buckets=12, descending=True).collect()
    hot = sorted((r for r in rows if r.g == 0), key=lambda r: (-r.k, r.id))
    assert [r["rank"] for r in hot] == list(range(1, len(hot) + 1)) and {r.n for r in hot} == {len(hot)}
    assert all(r["rank"] == r.n == 1 for r in rows if r.g != 0) and len(rows) == 3000


def test_running_sum_by_group_and_null_group(spark):
    df = _heavy(spark, 500).withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    out = running_sum(df, "k", "id", {"c": F.col("id")}, by="g", descending=True,
                      totals={"t": "c"}, buckets=8).collect()
    assert len(out) == 500
    for g in (None, 1, 2, 3):
        rows = sorted((r for r in out if r.g == g), key=lambda r: (-r.k, r.id))
        total = 0
        for r in rows:
            total += r.id
            assert r.c == total
        assert {r.t for r in rows} == {total}


def test_rank_orders_null_first_and_nan_last(spark):
    df = spark.createDataFrame(
        [(1, None), (2, float("nan")), (3, 0.0), (4, float("inf")), (5, -1.0)], "id int, k double"
    )
    ranked = {r.id: r["rank"] for r in global_rank(df, "k", "id").collect()}
    assert ranked[1] == 1 and ranked[5] == 2 and ranked[3] == 3 and {ranked[2], ranked[4]} == {4, 5}


def test_rank_of_nothing(spark):
    df = spark.createDataFrame([], "id int, k double")
    assert global_rank(df, "k", "id").count() == 0


def test_plan_sends_no_rows_to_one_partition(spark, small_dir):
    line = spark.read.parquet(f"{small_dir}/lineitem.parquet")
    ranked = global_rank(line, "l_quantity", "l_orderkey")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    # Only the sizes of the ranges, whose number is bounded, come together in one partition.
    gathers = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert len(gathers) == 1 and "HashAggregate(keys=[_place" in lines[gathers[0] + 1]
    # One shuffle, of the partial sizes; the rows meet their offsets where they were read.
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("n", [10, 700, 3000])
def test_hash_cutoffs_find_every_rank(spark, n):
    df = spark.range(n).select("id", ((F.col("id") * 2654435761) % (1 << 52)).alias("h"))
    rows = sorted((r.h, r.id) for r in df.collect())
    ranks = [0, 1, 2, n // 2, n - 1, n]
    got = hash_cutoffs(df, F.col("h"), "id", {None: ranks})[None]
    assert got == [None if r == 0 else rows[r - 1] for r in ranks]


def test_hash_cutoffs_with_equal_hashes(spark):
    df = spark.range(40).select("id", F.lit(5).cast("bigint").alias("h"))
    assert hash_cutoffs(df, F.col("h"), "id", {None: [13]})[None] == [(5, 12)]


def test_hash_cutoffs_refuse_a_repeated_tie_breaker(spark):
    df = spark.range(40).select((F.col("id") % 20).alias("id"), (F.col("id") % 20).alias("h"))
    with pytest.raises(ValueError, match="unique"):
        hash_cutoffs(df, F.col("h"), "id", {None: [13]})


def _sizes(df, *by):
    return [r["count"] for r in df.groupBy(*by).count().collect()]


def test_folds_cover_every_row_once(spark):
    df = _heavy(spark, 1003)
    for folded in (random_folds(df), ordered_folds(df, "k"), stratified_folds(df, "g")):
        assert folded.count() == 1003
        assert {r.fold for r in folded.select("fold").distinct().collect()} == set(range(5))
    sizes = _sizes(ordered_folds(df, "k"), "fold")
    assert max(sizes) - min(sizes) <= 1


def test_first_ordered_row_is_in_fold_one(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id int, k double")
    folds = [r.fold for r in ordered_folds(df, "k").orderBy("id").collect()]
    assert folds == [1, 2, 3, 4, 0, 1, 2, 3, 4, 0]


def test_stratified_folds_are_even_per_class(spark):
    folded = stratified_folds(_heavy(spark, 1003), "g")
    for g in range(4):
        sizes = _sizes(folded.filter(F.col("g") == g), "fold")
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_stratified_folds_with_many_classes_agree(spark, monkeypatch):
    from riskflow.operators import ranking

    # Text ids, and a label that is null in places: both ways treat them alike.
    df = _heavy(spark, 300).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), F.when(F.col("g") > 0, F.col("g")).alias("g")
    )
    few = {r.id: r.fold for r in stratified_folds(df, "g").collect()}
    monkeypatch.setattr(ranking, "_MAX_GROUPS", 2)
    many = {r.id: r.fold for r in stratified_folds(df, "g").collect()}
    assert few == many


@pytest.mark.parametrize(
    "assign",
    [
        lambda df: random_folds(df),
        lambda df: ordered_folds(df, "k"),
        lambda df: stratified_folds(df, "g"),
        lambda df: flip_labels(df.withColumn("y", F.lit(1)), "y", rate=0.1),
        lambda df: gaussian_jitter(df, ["k"]).withColumn("k", F.round("k", 9)),
    ],
)
def test_seeded_operators_ignore_the_layout(spark, assign):
    df = _heavy(spark, 600)
    one = {tuple(r) for r in assign(df.coalesce(1)).collect()}
    many = {tuple(r) for r in assign(df.repartition(16, F.rand(3))).collect()}
    assert one == many


def test_fold_split(spark):
    df = random_folds(_heavy(spark, 200))
    train, test = fold_split(df, 2)
    assert train.count() + test.count() == 200
    assert {r.fold for r in test.collect()} == {2}


@pytest.mark.parametrize("n,want", [(199, 2), (200, 3), (10, 0), (2000, 30)])
def test_flip_exactly(spark, n, want):
    df = spark.range(n).withColumn("y", (F.col("id") % 2).cast("int"))
    out = flip_labels(df, "y")
    assert out.filter("y <> flipped").count() == want
    assert out.filter("flipped not in (0, 1)").count() == 0


def test_class_weights_sum_to_n(spark):
    df = spark.range(100).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    out = class_weights(df, "y")
    assert out.agg(F.sum("weight")).collect()[0][0] == pytest.approx(100.0)
    assert {(r.y, round(r.weight, 6)) for r in out.collect()} == {(1, 5.0), (0, 0.555556)}


@pytest.mark.parametrize("most", [1, 256])
def test_class_weights_agree_and_skip_null_labels(spark, monkeypatch, most):
    from riskflow.operators import ranking

    monkeypatch.setattr(ranking, "_MAX_GROUPS", most)
    y = F.when(F.col("id") < 100, (F.col("id") % 10 == 0).cast("int"))
    rows = class_weights(spark.range(105).withColumn("y", y), "y").collect()
    got = {(r.y, r.weight and round(r.weight, 6)) for r in rows}
    assert len(rows) == 105 and got == {(1, 5.0), (0, 0.555556), (None, None)}


def test_noise_distribution(spark):
    df = spark.range(20000)
    row = df.select(
        seeded_normal(1, "id").alias("z"), seeded_uniform(2, "id").alias("u"),
        poisson_one(seeded_uniform(3, "id")).alias("w"),
    ).agg(F.avg("z"), F.stddev("z"), F.avg("u"), F.avg("w"), F.variance("w")).collect()[0]
    assert row[0] == pytest.approx(0, abs=0.03)
    assert row[1] == pytest.approx(1, abs=0.03)
    assert row[2] == pytest.approx(0.5, abs=0.01)
    assert row[3] == pytest.approx(1, abs=0.03)
    assert row[4] == pytest.approx(1, abs=0.05)


def test_jitter_spread(spark):
    df = spark.range(20000).withColumn("k", (F.col("id") % 100).cast("double"))
    noisy = gaussian_jitter(df, ["k", "absent"], factor=0.35)
    spread = df.agg(F.stddev("k")).collect()[0][0]
    joined = noisy.withColumnRenamed("k", "n").join(df, "id")
    got = joined.agg(F.stddev(F.col("n") - F.col("k"))).collect()[0][0]
    assert got == pytest.approx(0.35 * spread, rel=0.03)


def test_class_weight_columns_stand_alike_at_any_class_count(spark, monkeypatch):
    from riskflow.operators import ranking
    from riskflow.operators.perturb import class_weights

    df = spark.createDataFrame([(i, i % 6, "z") for i in range(30)], "id long, y int, z string")
    few = class_weights(df, "y")
    monkeypatch.setattr(ranking, "_MAX_GROUPS", 3)
    many = class_weights(df, "y")
    assert few.columns == many.columns == ["id", "y", "z", "weight"]
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_statistics_of_the_other_folds_equal_a_scan_of_them(spark):
    """Merged states against each fold's own scan; far-off means, gaps, a null fold."""
    df = spark.range(900).select(
        "id", F.when(F.col("id") % 4 < 3, (F.col("id") % 4).cast("int")).alias("fold"),
        F.when(F.col("id") % 5 > 0, F.lit(1e9) + seeded_uniform("s", "id")).alias("a"),
        F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).otherwise(float("nan")).alias("b"),
    )
    got = {(r.fold, r.feature): r for r in held_out_stats(fold_states(df, ["a", "none", "b"])).collect()}
    assert len(got) == 12
    rows = df.toPandas()
    rows["fold"] = rows["fold"].astype(object).where(rows["fold"].notna(), None)
    for (fold, name), r in got.items():
        outside = rows["fold"].notna() if fold is None else rows["fold"] != fold
        x = rows[outside][name].dropna()
        assert r.n == len(x)
        if name == "none":
            assert r.mean is None and r["quantile"] is None
            continue
        assert r.mean == pytest.approx(x.mean()) and r.std == pytest.approx(x.std(), rel=1e-4)
        rank = (x <= r["quantile"]).mean()
        assert abs(rank - 0.5) < 0.01
    filled = fill_by_fold(df, ["a", "b", "none"], "median")
    row = filled.filter("id = 0").first()
    assert row.a == got[0, "a"]["quantile"] and row.b == got[0, "b"]["quantile"] and row.none is None
    assert filled.count() == 900
    z = standardize_by_fold(df, ["b"]).filter("id = 1").first().b
    assert z == pytest.approx((1 - got[1, "b"].mean) / got[1, "b"].std)
    assert fold_states(df.limit(0), ["a"]).count() == 0
    with pytest.raises(ValueError):
        fold_states(spark.range(1001).select(F.col("id").alias("fold"), F.col("id").alias("a")), ["a"])
