"""Global order without a single partition.

``Window.orderBy`` with no partition key sends every row to one task. Here the rows are
exchanged by ranges of (key, tie-breakers), sorted inside each range, numbered in that
order and written. The written number says which range a row stands in and where, so a
rank is the number less that of the range's first row, plus the rows of the ranges before:
no bound is ever searched row by row, and the table fixes the ranges whoever reads it again.

``hash_cutoffs`` answers the cheaper question "which row has rank r" for rows in hash
order: a few histograms, and no shuffle of the rows at all.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions.scalar import HASH_BITS
from riskflow.workspace import collect_bounded, stage

_MAX_RANGES = 65536
_RANGE_ROWS = 1_000_000
_SMALL_RANGE_ROWS = 10_000
_NUMBER_BITS = 33
_RADIX_BITS = 12
_FETCH_ROWS = 512
_SKETCH_ACCURACY = 10000
_MAX_GROUPS = 256


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _first(c: Column, descending: bool) -> Column:
    return c.desc_nulls_first() if descending else c.asc_nulls_first()


def _range_count(df: DataFrame) -> int:
    """One range for a million rows; small inputs use the session's partitions."""
    rows = df.count()
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(min(partitions, rows // _SMALL_RANGE_ROWS), rows // _RANGE_ROWS, 1), _MAX_RANGES)


def _numbered(
    df: DataFrame,
    order_by: Column | str,
    tie_breaker: str | Sequence[str] | None,
    groups: Sequence[str],
    descending: bool,
    ranges: int | None,
) -> DataFrame:
    """Staged rows with ``_at``, which grows with the order, and their ``_place``.

    ``_at`` is a range's number times 2^33 plus the position inside the range; ``_place``
    holds the groups and the range. A struct is never null itself, so rows of a null group
    keep their place.
    """
    ties = [tie_breaker] if isinstance(tie_breaker, str) else list(tie_breaker or [])
    order = [_first(F.col(g), False) for g in groups]
    order += [_first(_as_column(order_by), descending), *[_first(F.col(t), False) for t in ties]]
    ranged = df.repartitionByRange(ranges or _range_count(df), *order).sortWithinPartitions(*order)
    staged = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered-ranges")
    which = F.shiftright("_at", _NUMBER_BITS).alias("_range")
    return staged.withColumn("_place", F.struct(*groups, which))


def _with_offsets(rows: DataFrame, sizes: DataFrame, groups: Sequence[str], sums: Sequence[str],
                  totals: Mapping[str, str]) -> DataFrame:
    """``rows`` with ``_o<sum>``, each sum over the group's ranges before, and group totals.

    Without groups there is one row of sizes for a range, so they are broadcast; with
    groups their number is unknown and left to the planner. Every row has its place.
    """
    group = F.struct(*[F.col("_place")[g] for g in groups]) if groups else F.lit(0)
    scope = Window.partitionBy(group)
    before = scope.orderBy("_place._range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[c for c in sizes.columns if c not in sums],
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_o{v}") for v in sums],
        *[F.sum(v).over(scope).alias(out) for out, v in totals.items()],
    )
    return rows.join(offsets if groups else F.broadcast(offsets), "_place", "left")


def running_sum(
    df: DataFrame,
    order_by: Column | str,
    tie_breaker: str | Sequence[str] | None,
    values: Mapping[str, Column],
    by: str | Sequence[str] | None = None,
    descending: bool = False,
    totals: Mapping[str, str] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Inclusive running sums in (order_by, tie_breaker) order, separately per ``by``.

    Columns of any sortable type compare in their own order, nulls first. ``values`` maps an
    output column to the summed expression; ``totals`` maps further output columns to entries
    of ``values`` and adds their sum over the whole group. Null is a group like any other.
    ``buckets`` sets the number of ranges. A key with very many rows is cut by its
    tie-breakers. At most a million keys meet on the driver, as a sample for the ranges.
    """
    groups = [by] if isinstance(by, str) else list(by or [])
    inputs = {f"_v{i}": expr for i, expr in enumerate(values.values())}
    names = dict(zip(values, inputs))
    rows = _numbered(df.withColumns(inputs), order_by, tie_breaker, groups, descending, buckets)
    sizes = rows.groupBy("_place").agg(*[F.sum(v).alias(v) for v in inputs])
    inside = (
        Window.partitionBy("_place").orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = rows.select(
        *df.columns, "_place", *[F.sum(v).over(inside).alias(f"_c{v}") for v in inputs]
    )
    found = {out: names[v] for out, v in (totals or {}).items()}
    joined = _with_offsets(summed, sizes, groups, list(inputs), found)
    return joined.select(
        *df.columns,
        *[(F.col(f"_c{v}") + F.col(f"_o{v}")).alias(out) for out, v in names.items()],
        *found,
    )


def global_rank(
    df: DataFrame,
    order_by: Column | str,
    tie_breaker: str | Sequence[str],
    by: str | Sequence[str] | None = None,
    descending: bool = False,
    out: str = "rank",
    size: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """1-based position of each row in (order_by, tie_breaker) order, per ``by``.

    ``size`` names a column for the number of rows in the group. The numbers written with
    the rows give their positions, so the rows are shuffled once, by range, and not again.
    """
    groups = [by] if isinstance(by, str) else list(by or [])
    rows = _numbered(df, order_by, tie_breaker, groups, descending, buckets)
    sizes = rows.groupBy("_place").agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    placed = _with_offsets(rows, sizes, groups, ["_n"], {size: "_n"} if size else {})
    rank = F.col("_at") - F.col("_start") + F.col("_o_n") + F.lit(1).cast("bigint")
    return placed.select(*df.columns, rank.alias(out), *([size] if size else []))


def exact_quantiles(df: DataFrame, cols: Sequence[str], q: float = 0.5) -> DataFrame:
    """Discrete quantile of each column as rows ``(feature, value)``; null and NaN are ignored.

    A sketch with a guaranteed rank error brackets the quantile of every column; the rows
    below the bracket are only counted, and just the few inside it are put in order.
    """
    nothing = F.lit(None).cast("double")
    number = {c: F.nanvl(F.col(c).cast("double"), nothing) for c in cols}
    slack = 2.0 / _SKETCH_ACCURACY
    around = [max(0.0, q - slack), min(1.0, q + slack)]
    row = df.agg(
        *[F.percentile_approx(x, around, _SKETCH_ACCURACY) for x in number.values()],
        *[F.count(x) for x in number.values()],
    ).collect()[0]
    bracket = {c: row[i] for i, c in enumerate(cols) if row[i]}
    target = {c: max(1, math.ceil(row[len(cols) + i] * q)) for i, c in enumerate(cols)}
    if not bracket:
        return df.sparkSession.createDataFrame([], "feature string, value double")
    below = df.agg(
        *[F.count_if(number[c] < F.lit(low)).alias(c) for c, (low, _) in bracket.items()]
    ).collect()[0]
    inside = F.array_compact(
        F.array(
            *[
                F.when(
                    number[c].between(low, high),
                    F.struct(F.lit(c).alias("feature"), number[c].alias("value")),
                )
                for c, (low, high) in bracket.items()
            ]
        )
    )
    long = df.select(F.explode(inside).alias("p")).select("p.*")
    counted = stage(long.groupBy("feature", "value").agg(F.count("*").alias("n")), "quantile-values")
    summed = running_sum(
        counted, "value", None, {"cum": F.col("n")}, by="feature"
    )
    reached = F.lit(False)
    for c in bracket:
        enough = F.col("cum") >= F.lit(target[c] - below[c])
        reached = reached | ((F.col("feature") == F.lit(c)) & enough)
    return summed.filter(reached).groupBy("feature").agg(F.min("value").alias("value"))


def group_sizes(df: DataFrame, by: str | None) -> dict | None:
    """Rows per group, or None when there are too many groups to hold on the driver."""
    if by is None:
        return {None: df.count()}
    rows = collect_bounded(df.groupBy(by).agg(F.count("*").alias("n")), _MAX_GROUPS)
    return None if rows is None else {r[by]: r["n"] for r in rows}


def hash_cutoffs(
    df: DataFrame,
    hash_col: Column,
    tie_breaker: str,
    ranks: Mapping[object, Sequence[int]],
    by: str | None = None,
) -> dict[object, list[tuple[int, object] | None]]:
    """The (hash, tie-breaker) pair found at each 1-based rank of each group.

    Radix selection: every pass counts rows by the next bits of the hash, only among
    rows whose leading bits are still in question, until few enough remain to fetch.
    Rank 0 gives None (nothing precedes it). Null is a group like any other.
    """
    base = df.select(
        (F.col(by) if by else F.lit(0)).alias("_g"),
        hash_col.alias("_h"),
        F.col(tie_breaker).alias("_t"),
    )
    group_of = {(0 if by is None else g): g for g in ranks}
    # (group, wanted rank) -> (prefix, rank left inside the prefix, rows in it)
    open_: dict = {}
    for g, wanted in ranks.items():
        for r in wanted:
            if r > 0:
                open_[(0 if by is None else g, r)] = (0, r, math.inf)
    shift = HASH_BITS
    while shift > 0 and any(n > _FETCH_ROWS for _, _, n in open_.values()):
        here, wider = _in_prefix(open_, shift), shift
        shift = max(0, shift - _RADIX_BITS)
        counts = (
            base.filter(here)
            .groupBy("_g", F.shiftright("_h", shift).alias("p"))
            .count()
            .collect()
        )
        per_group: dict = {}
        for row in sorted(counts, key=lambda r: r["p"]):
            per_group.setdefault(row["_g"], []).append((row["p"], row["count"]))
        for key, (prefix, left, _) in open_.items():
            for p, n in per_group.get(key[0], []):
                if p >> (wider - shift) != prefix:
                    continue
                if left <= n:
                    open_[key] = (p, left, n)
                    break
                left -= n
            else:
                raise ValueError(f"rank {key[1]} is beyond the rows of group {key[0]}")
    found: dict = {}
    if open_:
        if any(n > _FETCH_ROWS for _, _, n in open_.values()):
            raise ValueError("the tie-breaker must be unique")
        rows = base.filter(_in_prefix(open_, shift)).collect()
        members: dict = {}
        for row in sorted(rows, key=lambda r: (r["_h"], r["_t"])):
            members.setdefault((row["_g"], row["_h"] >> shift), []).append((row["_h"], row["_t"]))
        for key, (prefix, left, _) in open_.items():
            group = members[(key[0], prefix)]
            if group.count(group[left - 1]) > 1:
                raise ValueError("the tie-breaker must be unique")
            found[key] = group[left - 1]
    return {
        group_of[g]: [found.get((g, r)) for r in ranks[group_of[g]]] for g in group_of
    }


def _in_prefix(open_: Mapping, shift: int) -> Column:
    """Rows of the groups and hash prefixes still in question."""
    if shift >= HASH_BITS:
        return reduce(or_, [F.col("_g").eqNullSafe(F.lit(g)) for g in {g for g, _ in open_}])
    prefixes: dict = {}
    for (g, _), (prefix, _, _) in open_.items():
        prefixes.setdefault(g, set()).add(prefix)
    out = F.lit(False)
    for g, ps in prefixes.items():
        out = out | (F.col("_g").eqNullSafe(F.lit(g)) & F.shiftright("_h", shift).isin(*ps))
    return out


def at_or_before(hash_col: Column, tie_breaker: str, cutoff: tuple[int, object] | None) -> Column:
    """True for rows that do not come after the cutoff in (hash, tie-breaker) order."""
    if cutoff is None:
        return F.lit(False)
    h, t = cutoff
    return (hash_col < F.lit(h)) | (
        (hash_col == F.lit(h)) & (F.col(tie_breaker) <= F.lit(t))
    )
