"""Mix sources to target weights by pivotal dependent rounding.

Every row of a source wants the same number of copies, the source's target divided by its
size. The whole part is taken as it is; the fractional parts are rounded dependently. Rows
are paired, and a random transfer of *mass* (probability times size) between the two makes
at least one of them integral, without changing their joint mass or any row's expectation.
A leaf of about ``FAN_IN`` rows keeps one undecided row; these residuals are paired again
in groups of ``FAN_IN`` up a tree, one shuffle of ever fewer rows a level. Only the last
residual of a source is rounded by a coin, so a source misses its target by less than one
row's size.

Everything is DataFrame functions. Rows enter the tree as distinct rows with a count, so a
row repeated very often is one entry. A source with a third of all rows is spread over its
own leaves, whose number follows its row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import col, hidden, let, row_hash, uniform, word_count
from riskflow.workspace import stage

FAN_IN = 64
#: Probabilities this near to 0 or 1 are rounded.
EPS = 1e-9


def _ranked(sources: DataFrame) -> DataFrame:
    """Number the sources by code point, null last, without a global window over them."""
    parts = max(1, -(-sources.count() // 50_000))
    order = F.col("source").asc_nulls_last()
    cut = stage(
        sources.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()),
        "mix-sources",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy("part").agg(F.count("*").alias("n_part"))
        .select("part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("offset"))
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return cut.join(offsets, "part").select(
        *sources.columns, (place + F.col("offset")).cast("long").alias("rank")
    )


def source_targets(
    sources: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0
) -> DataFrame:
    """Add ``rank`` and ``target`` to a frame of ``source`` and ``source_size``.

    Weights go round in code-point order of the source. The targets share the sum of all
    sizes; a target stops at ``cap`` times its source's size and the excess is shared
    again by weight. Only three sums a round reach the driver.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = stage(
        _ranked(sources).withColumn(
            "weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))
        ),
        "mix-ranked",
    )
    size, weight = F.col("source_size"), F.col("weight")
    all_ = ranked.agg(F.sum(size).alias("s"), F.sum(weight).alias("w")).first()
    total, mass, share, n_full = float(all_.s or 0), float(all_.s or 0), all_.w or 1.0, 0
    while True:
        full = cap * size < weight * F.lit(mass) / F.lit(share)
        row = ranked.where(full).agg(
            F.sum(size).alias("s"), F.sum(weight).alias("w"), F.count("*").alias("n")
        ).first()
        left = all_.w - (row.w or 0.0) if all_.w else 0.0
        if row.n == n_full or left <= 0:
            break
        n_full, mass, share = row.n, total - cap * (row.s or 0), left
    target = F.when(full, cap * size).otherwise(weight * F.lit(mass) / F.lit(share))
    return ranked.withColumn("target", target.cast("double"))


def _pivot(items: Column, seed: int, level: int) -> Column:
    """Pair the sorted items of one group one after another.

    Items are structs of ``a`` (size), ``h``, ``x`` (probability), the largest first, so that
    large rows are settled by smaller ones and a small one stays over. The result holds
    ``done`` (items with the bit they got) and ``carry`` (the one item still undecided).
    """

    def meet(acc: Column, item: Column) -> Column:
        one, two = acc["carry"], item
        up = F.least(one["a"] * (1 - one["x"]), two["a"] * two["x"])
        down = F.least(one["a"] * one["x"], two["a"] * (1 - two["x"]))
        u = uniform(F.lit(seed), F.lit(level), one["h"], two["h"])

        def moved(m: Column) -> Column:
            gains = u * (m["up"] + m["down"]) <= m["down"]
            step = F.when(gains, m["up"]).otherwise(-m["down"])
            return let(step, lambda d: settle(
                one.withField("x", one["x"] + d / one["a"]),
                two.withField("x", two["x"] - d / two["a"]),
            ))

        def settle(first: Column, second: Column) -> Column:
            return let(F.struct(first.alias("p"), second.alias("q")), lambda s: let(
                (s["p"]["x"] <= EPS) | (s["p"]["x"] >= 1 - EPS),
                lambda first_done: F.struct(
                    F.when(first_done, s["q"]).otherwise(s["p"]).alias("carry"),
                    F.concat(
                        acc["done"],
                        F.array(F.when(first_done, s["p"]).otherwise(s["q"])),
                    ).alias("done"),
                ),
            ))

        return let(F.struct(up.alias("up"), down.alias("down")), moved)

    start = F.struct(
        F.element_at(items, 1).alias("carry"), F.slice(items, 1, 0).alias("done")
    )
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, meet)


def _level(items: DataFrame, seed: int, level: int) -> DataFrame:
    grouped = items.groupBy("rank", "node").agg(
        F.sort_array(F.collect_list("item"), asc=False).alias("items")
    )
    out = grouped.select("rank", "node", _pivot(F.col("items"), seed, level).alias("p"))
    return stage(out.select("rank", "node", "p.done", "p.carry"), f"mix-level{level}")


def round_units(units: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Add ``source_size``, ``target``, ``base`` and ``extra`` to counted distinct rows.

    ``units`` has ``source``, ``size``, ``m`` (how often the row occurs) and ``h`` (a hash
    of the row). Each of the m rows gets ``base`` copies and ``extra`` of them one more.
    """
    names = units.columns
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("ratio") + EPS)
    share = F.greatest(F.col("ratio") - F.col("base"), F.lit(0.0)) * F.col("m")
    planned = (
        units.join(targets.withColumnRenamed("source", "s"), units["source"].eqNullSafe(F.col("s")))
        .withColumn("ratio", ratio).withColumn("base", whole.cast("long"))
        .withColumn("share", share).withColumn("sure", F.floor(F.col("share") + EPS))
        .withColumn("x", F.col("share") - F.col("sure"))
        .select(*names, "source_size", "target", "base", "sure", "x", "rank", "n_units")
    )
    planned = stage(planned, "mix-planned")
    open_ = (F.col("x") > EPS) & (F.col("size") > 0)
    kept = [*names, "source_size", "target", "base", "sure", "rank"]
    leaves = F.ceil(F.col("n_units") / FAN_IN)
    leaf = F.pmod(F.xxhash64(F.lit(seed), F.col("h")), leaves)
    item = F.struct(
        F.col("size").cast("double").alias("a"), F.col("h"), "x",
        F.struct(*kept).alias("unit"),
    )
    first = _level(planned.where(open_).select("rank", leaf.alias("node"), item.alias("item")), seed, 0)

    decided = []
    residual = F.struct(
        F.col("carry.a").alias("a"), F.col("key").alias("h"), F.col("carry.x").alias("x")
    )
    nodes = first.select("rank", "node", F.col("node").alias("key"), "carry")
    n_nodes = -(-(targets.agg(F.max("n_units")).first()[0] or 1) // FAN_IN)
    level = 0
    while n_nodes > 1:
        level += 1
        up = _level(
            nodes.select("rank", F.floor(F.col("node") / FAN_IN).alias("node"), residual.alias("item")),
            seed, level,
        )
        decided.append(up.select("rank", F.explode("done").alias("d")).select(
            "rank", F.col("d.h").alias("node"), (F.col("d.x") > 0.5).cast("long").alias("bit")
        ))
        nodes = up.select("rank", "node", F.col("carry.h").alias("key"), "carry")
        n_nodes = -(-n_nodes // FAN_IN)
    coin = uniform(F.lit(seed), F.lit(-1), F.col("rank"), F.col("key")) < F.col("carry.x")
    last = nodes.select("rank", F.col("key").alias("node"), coin.cast("long").alias("bit"))
    for part in decided:
        last = last.unionByName(part)

    settled = F.transform("done", lambda d: F.struct(
        d["unit"].alias("unit"), (d["x"] > 0.5).cast("long").alias("bit")
    ))
    tail = F.array(F.struct(F.col("carry.unit").alias("unit"), F.col("bit").alias("bit")))
    out = [*names, "source_size", "target", "base"]
    rounded = (
        first.join(last, ["rank", "node"]).select(F.explode(F.concat(settled, tail)).alias("r"))
        .select("r.unit.*", (F.col("r.unit.sure") + F.col("r.bit")).alias("extra"))
        .select(*out, "extra")
    )
    return rounded.unionByName(planned.where(~open_).select(*out, F.col("sure").alias("extra")))


def plan_mix(
    rows: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: int = 42
) -> DataFrame:
    """Copies for each distinct row of ``rows`` (``source``, ``size`` and any other columns)."""
    names = rows.columns
    units = stage(
        rows.groupBy(*names).agg(F.count("*").alias("m"))
        .withColumn("h", row_hash(names, seed)),
        "mix-units",
    )
    sources = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n_units")
    )
    return round_units(units, source_targets(stage(sources, "mix-sizes"), weights, cap), seed).drop("h")


def mix_sizes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: int = 42,
) -> DataFrame:
    """One row per input row: id, size, source_size, target and taken (copies times size).

    A null text has size 0 and takes nothing; a null source is a source of its own; a
    source of size 0 has target 0; repeated rows share out their copies; an empty table
    gives an empty result. Other columns of ``df`` are not read.
    """
    rows = df.select(
        col(id_col).alias("id"), col(source_col).alias("source"), word_count(col(text_col)).alias("size")
    )
    plan = plan_mix(rows, weights, cap, seed)
    nth = F.explode(F.sequence(F.lit(1), F.col("m"))).alias("nth")
    copies = F.col("base") + (F.col("nth") <= F.col("extra")).cast("long")
    return plan.select("*", nth).select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("size") * copies).alias("taken"),
    )


def mix(
    df: DataFrame, text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: int = 42,
) -> DataFrame:
    """The mixture itself: every row of ``df``, all its columns, as often as it is taken.

    Decisions are made on hashes of whole rows and joined back to the rows, so texts move
    once. Rows that occur more than once are fetched once and repeated. Edge cases are
    those of ``mix_sizes``; columns of any name pass through untouched.
    """
    names = df.columns
    k1, k2, n = hidden(df, "k1", "k2", "copies")
    keyed = df.withColumns({k1: row_hash(names, 1), k2: row_hash(names, 2)})
    rows = keyed.select(
        F.col(k1), F.col(k2), col(source_col).alias("source"), word_count(col(text_col)).alias("size")
    )
    plan = stage(
        plan_mix(rows, weights, cap, seed).select(
            k1, k2, "m", (F.col("m") * F.col("base") + F.col("extra")).alias(n)
        ).where(F.col(n) > 0),
        "mix-plan",
    )
    out = keyed.join(plan.where("m = 1").drop("m").hint("shuffle_hash"), [k1, k2])
    many = plan.where("m > 1").drop("m")
    if not many.isEmpty():
        once = keyed.join(many.select(k1, k2), [k1, k2], "left_semi").dropDuplicates([k1, k2])
        out = out.unionByName(once.join(many, [k1, k2]))
    return out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[col(c) for c in names])
