"""Exact k-nearest-neighbour join and classifier.

The answer is defined by values alone: squared Euclidean distance kept to nine decimals,
ties broken by the smaller base id. Two physical forms give that same answer.

``broadcast``: the base side, measured and found small, is sent to every task and the
query side is streamed past it; only the query rows are spread over the cores.

``blocked``: for a base side of any size. Base vectors are assigned to the cell of their
nearest pivot and cut, by distance to the pivot, into blocks of bounded bytes. Every query
first searches the one block nearest to it, which bounds its k-th distance. Then it goes
through the cells in rounds, best first, a few at a time; before each round the bound is
tightened by what was found, and the triangle inequality tells which cells, and which
blocks of a cell, can still hold a neighbour. Only the pivots are held by every task; the
list of blocks is a table that queries meet by cell, so it may grow with the data. A task
holds one block and one bounded chunk of the queries that visit it, so a popular block is
spread over many tasks, and each task returns at most k rows per query.

``approx_knn_join`` measures only rows that share a bucket of random projections. Few rows meet
by bucket, which copies them; more are packed once and streamed past each other.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.functions.scalar import seeded_hash
from riskflow.operators.ranking import global_rank
from riskflow.workspace import fresh_path, stage

# Largest base side, in numbers, that is sent to every task when asked for (64 MB of doubles), and
# the largest for which that form, whose work is queries times rows, is chosen unasked.
BROADCAST_NUMBERS, AUTO_NUMBERS = 8_000_000, 1_000_000
# Bytes of vectors in a block: from the first to the second as the base grows, in about BLOCKS
# blocks. What travels is queries times the blocks they visit, so it grows with the queries.
BLOCK_BYTES, MAX_BLOCK_BYTES, BLOCKS = 1 << 20, 32 << 20, 32
# Pivots, which every task holds.
MAX_PIVOTS = 256
# Rows of a leaf, and queries taken together, in the search of one large block.
LEAF_ROWS, TILE_PRUNED = 512, 8192
# Cells that a query goes through in one round, at most; rounds begin with one and double.
ROUND_CELLS = 64
_TILE_QUERIES = 256
_TILE_BASE = 4096
# Numbers of either side of the pairs measured together, and rows whose buckets a task of the
# approximate join holds at a time.
_TILE_NUMBERS = 1 << 20
_TILE_SPREAD = 512
# Numbers that may travel, in copies of queries and rows, where these meet by bucket.
MEET_NUMBERS = 1 << 24
# Bytes of vectors in a pack, in the packs that one task writes, and in those of one side that a
# task holds; packs that travel to Python together.
_PACK_BYTES, _PACKED_BYTES, _HELD_BYTES, _ARROW_PACKS = 2 << 20, 4 << 20, 16 << 20, 4
_SCALE = 1e9
# Bounds are loosened by more than floating-point rounding can tighten them.
_ROUNDING = 1e-12
_SLACK = 1e-9
# Rows that the bucket width of the approximate join is fitted on, and queries among them.
FIT_ROWS, FIT_QUERIES = 2_048, 256
_MIX = np.uint64(0x9E3779B97F4A7C15)
# Share of the true neighbours in that sample that the fitted buckets must return.
COVER = 0.97


def _vector_of(df: DataFrame, features: str | Sequence[str]):
    if isinstance(features, str):
        kind = df.schema[features].dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType):
            # Half the bytes on each exchange; tasks compute in doubles.
            return F.transform(F.col(features), lambda x: x + F.lit(0.0).cast("float"))
        return F.transform(F.col(features), lambda x: x.cast("double") + F.lit(0.0))
    return F.array(*[F.col(f).cast("double") + F.lit(0.0) for f in features])


def _matrix(column: pd.Series) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    out = np.stack(column.to_numpy()).astype(np.float64, copy=False)
    if np.isnan(out).any():
        raise ValueError("null or NaN in the features of a nearest-neighbour join")
    return out


def _exact(q: np.ndarray, rows: np.ndarray, b: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Squared distance of each pair of rows, summed feature by feature, in units of 1e-9.

    Where many rows are equally far, pairs are many; the vectors of a few are held at a time.
    """
    total = np.zeros(len(rows))
    step = max(1, _TILE_NUMBERS // max(1, q.shape[1]))
    for at in range(0, len(rows), step):
        part = slice(at, at + step)
        left, right, some = q[rows[part]], b[cols[part]], total[part]
        for d in range(q.shape[1]):
            gap = left[:, d] - right[:, d]
            some += gap * gap
    return np.floor(total * _SCALE + 0.5)


def _rank_in_row(rows: np.ndarray) -> np.ndarray:
    """Position of each entry among the entries of its row; rows are sorted."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")


def _search(
    q: np.ndarray,
    q_group: np.ndarray | None,
    b: np.ndarray,
    b_id: np.ndarray,
    b_group: np.ndarray | None,
    k: int,
    reach: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, base index, distance) of the k best base rows of every query, in order.

    A matrix product gives every distance up to rounding; it only selects the pairs that
    can still be among the k best, and those are then measured exactly. ``reach`` is a
    known bound on the k-th distance.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    center = b.mean(axis=0)
    near_q, near_b = q - center, b - center
    b_norm = (near_b * near_b).sum(axis=1)
    q_norm = (near_q * near_q).sum(axis=1)
    # More than the rounding error of the product form.
    error = 1e-15 * (q.shape[1] + 8) * (q_norm + b_norm.max())
    for q0 in range(0, len(q), _TILE_QUERIES):
        q1 = min(q0 + _TILE_QUERIES, len(q))
        limit = np.full(q1 - q0, np.inf) if reach is None else reach[q0:q1].copy()
        rows = cols = np.zeros(0, dtype=np.int64)
        dist = np.zeros(0)
        for b0 in range(0, len(b), _TILE_BASE):
            b1 = min(b0 + _TILE_BASE, len(b))
            rough = near_q[q0:q1] @ near_b[b0:b1].T
            rough *= -2.0
            rough += b_norm[None, b0:b1]
            bar = (limit + 1.0) / _SCALE - q_norm[q0:q1] + error[q0:q1]
            free = np.nonzero(np.isinf(limit))[0]
            if len(free) and b1 - b0 > k:
                open_rows = rough[free]
                if q_group is not None:
                    same = q_group[q0:q1][free][:, None] == b_group[None, b0:b1]
                    open_rows = np.where(same, np.inf, open_rows)
                kth = np.partition(open_rows, k - 1, axis=1)[:, k - 1]
                bar[free] = kth + 2 * error[q0:q1][free] + 1.0 / _SCALE
            r, c = np.nonzero(rough <= bar[:, None])
            if q_group is not None:
                allowed = q_group[q0 + r] != b_group[b0 + c]
                r, c = r[allowed], c[allowed]
            rows = np.concatenate([rows, r])
            cols = np.concatenate([cols, c + b0])
            dist = np.concatenate([dist, _exact(q, q0 + r, b, b0 + c)])
            best = np.lexsort((b_id[cols], dist, rows))
            rows, cols, dist = rows[best], cols[best], dist[best]
            place = _rank_in_row(rows)
            last = place == k - 1
            limit[rows[last]] = np.minimum(limit[rows[last]], dist[last])
            rows, cols, dist = rows[place < k], cols[place < k], dist[place < k]
        found.append((rows + q0, cols, dist))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def _leaves(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """Rows cut at the median of their widest feature until at most ``rows`` are left together."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= rows:
            out.append(at)
            continue
        part = x[at]
        d = int((part.max(axis=0) - part.min(axis=0)).argmax())
        order = np.argpartition(part[:, d], len(at) // 2)
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def _search_leaves(
    q: np.ndarray,
    q_group: np.ndarray | None,
    b: np.ndarray,
    b_id: np.ndarray,
    b_group: np.ndarray | None,
    k: int,
    reach: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``_search``, for a large block: a query is measured only with leaves in its reach.

    A leaf's box bounds the distance to its rows. A query goes through the leaf with the next
    box, then three more, then all others that what it found leaves in reach. Where that is
    much of the block, the block is searched as one.
    """
    if len(b) <= 4 * LEAF_ROWS or not len(q):
        return _search(q, q_group, b, b_id, b_group, k, reach)
    found = []
    leaves = _leaves(b, LEAF_ROWS)
    low, high = (np.stack([f(b[x], axis=0) for x in leaves]) for f in (np.min, np.max))
    for at in range(0, len(q), TILE_PRUNED):
        part = slice(at, at + TILE_PRUNED)
        some = q[part], None if q_group is None else q_group[part]
        limit = np.full(len(some[0]), np.inf) if reach is None else reach[part].copy()
        rows, cols, dist = _pruned(*some, b, b_id, b_group, k, limit, leaves, low, high)
        found.append((rows + at, cols, dist))
    return tuple(np.concatenate(x) for x in zip(*found))


def _pruned(
    q: np.ndarray, q_group: np.ndarray | None, b: np.ndarray, b_id: np.ndarray, b_group: np.ndarray | None, k: int,
    limit: np.ndarray, leaves: list[np.ndarray], low: np.ndarray, high: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gap = np.zeros((len(q), len(leaves)))
    for d in range(q.shape[1]):
        x = q[:, d, None]
        off = np.maximum(0.0, np.maximum(low[None, :, d] - x, x - high[None, :, d]))
        gap += off * off
    next_four = np.zeros(gap.shape, dtype=bool)
    np.put_along_axis(next_four, np.argpartition(gap, 3, axis=1)[:, :4], True, axis=1)
    next_one = np.zeros(gap.shape, dtype=bool)
    np.put_along_axis(next_one, gap.argmin(axis=1)[:, None], True, axis=1)
    todo = np.ones(gap.shape, dtype=bool)
    rows = cols = np.zeros(0, dtype=np.int64)
    dist = np.zeros(0)
    for pick in (next_one, next_four, None):
        open_pairs = todo & (gap <= _radius(limit)[:, None] ** 2)
        if pick is not next_one and open_pairs.mean() > (0.4 if pick is None else 0.9):
            return _search(q, q_group, b, b_id, b_group, k, limit)
        pairs = open_pairs if pick is None else open_pairs & pick
        todo &= ~pairs
        found = [(rows, cols, dist)]
        for leaf in np.nonzero(pairs.any(axis=0))[0]:
            at, of = np.nonzero(pairs[:, leaf])[0], leaves[leaf]
            r, c, d = _search(
                q[at], None if q_group is None else q_group[at], b[of], b_id[of],
                None if b_group is None else b_group[of], k, limit[at],
            )
            found.append((at[r], of[c], d))
        rows, cols, dist = (np.concatenate(x) for x in zip(*found))
        best = np.lexsort((b_id[cols], dist, rows))
        rows, cols, dist = rows[best], cols[best], dist[best]
        place = _rank_in_row(rows)
        last = place == k - 1
        limit[rows[last]] = np.minimum(limit[rows[last]], dist[last])
        rows, cols, dist = rows[place < k], cols[place < k], dist[place < k]
    return rows, cols, dist


def _output_schema(id_type: T.DataType, base_id_type: T.DataType, payload: list) -> T.StructType:
    return T.StructType(
        [T.StructField("query_id", id_type), T.StructField("base_id", base_id_type),
         T.StructField("_d", T.DoubleType()), *payload]
    )


def _distinct_base(base: DataFrame, k: int, exclude: str | None, id: str) -> DataFrame:
    """Drop copies of a vector that cannot be among the k nearest of any query.

    Of equal vectors in one exclusion group only the k smallest ids can win. With at most
    k copies left per group, a query skips at most k of them, so the 2k smallest ids of a
    vector are enough (k + 1 when a query skips just its own id). Spark applies these
    limits before the shuffle, so a vector that makes up much of the table stays cheap.
    """
    if exclude is None:
        limits = [(["_vec"], k)]
    elif exclude == id:
        limits = [(["_vec"], k + 1)]
    else:
        limits = [(["_vec", "_group"], k), (["_vec"], 2 * k)]
    for keys, limit in limits:
        order = Window.partitionBy(*keys).orderBy("_id")
        base = (
            base.withColumn("_copy", F.row_number().over(order))
            .filter(F.col("_copy") <= limit)
            .drop("_copy")
        )
    return base


def knn_join(
    query: DataFrame,
    base: DataFrame,
    k: int,
    features: str | Sequence[str],
    id: str = "id",
    exclude: str | None = None,
    carry: Sequence[str] = (),
    mode: str = "auto",
    block_rows: int | None = None,
    query_rows: int = 32_768,
) -> DataFrame:
    """The k nearest base rows of every query row: ``query_id, base_id, rank, distance``.

    ``features`` is a list of numeric columns or one array column. Pairs with equal
    ``exclude`` values are skipped (a fold column, or the id itself). ``carry`` copies
    base columns to the output. ``mode`` is ``broadcast``, ``blocked`` or ``auto``, which
    counts the base side and broadcasts it only below ``AUTO_NUMBERS``; ``broadcast`` asks for
    that form and raises above twice ``BROADCAST_NUMBERS``. ``block_rows`` overrides the size
    of a block, which is ``BLOCK_BYTES`` to ``MAX_BLOCK_BYTES`` of vectors.
    """
    group = F.col(exclude) if exclude else F.lit(None).cast("int")
    q = query.select(
        F.col(id).alias("_id"), group.alias("_group"), _vector_of(query, features).alias("_vec")
    )
    b = base.select(
        F.col(id).alias("_id"), group.alias("_group"), _vector_of(base, features).alias("_vec"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
    )
    payload = [T.StructField(f"_carry_{c}", base.schema[c].dataType) for c in carry]
    schema = _output_schema(query.schema[id].dataType, base.schema[id].dataType, payload)
    if mode in ("auto", "broadcast"):
        size = b.agg(F.count("*").alias("n"), F.max(F.size("_vec")).alias("d")).collect()[0]
        numbers = size["n"] * (size["d"] or 1)
        if mode == "broadcast" and numbers > 2 * BROADCAST_NUMBERS:
            raise ValueError(f"a base side of {numbers} numbers is not sent to every task")
        if mode == "auto":
            mode = "broadcast" if numbers <= AUTO_NUMBERS else "blocked"
    if mode == "broadcast":
        pairs = _broadcast_join(q, b, k, exclude is not None, schema)
    elif mode == "blocked":
        b = _distinct_base(b, k, exclude, id)
        pairs = _blocked_join(q, b, k, exclude is not None, schema, block_rows, query_rows)
    else:
        raise ValueError(f"unknown mode {mode}")
    return pairs.select(
        "query_id",
        "base_id",
        F.col("_rank").cast("int").alias("rank"),
        F.sqrt(F.col("_d") / F.lit(_SCALE)).alias("distance"),
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
    )


def _pairs_frame(
    schema: T.StructType, q_id, b: pd.DataFrame, rows, cols, dist, rank: bool
) -> pd.DataFrame:
    out = {"query_id": q_id[rows], "base_id": b["_id"].to_numpy()[cols], "_d": dist}
    for field in schema.fields:
        if field.name.startswith("_carry_"):
            out[field.name] = b[field.name].to_numpy()[cols]
    if rank:
        out["_rank"] = _rank_in_row(rows) + 1
    return pd.DataFrame(out)


def _broadcast_join(
    q: DataFrame, b: DataFrame, k: int, grouped: bool, schema: T.StructType
) -> DataFrame:
    spark = q.sparkSession
    held = spark.sparkContext.broadcast(b.toPandas())
    out_schema = T.StructType([*schema.fields, T.StructField("_rank", T.LongType())])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = held.value
        vectors, ids = _matrix(rows["_vec"]), rows["_id"].to_numpy()
        groups = rows["_group"].to_numpy() if grouped else None
        for batch in batches:
            if not len(batch) or not len(rows):
                continue
            found = _search_leaves(
                _matrix(batch["_vec"]), batch["_group"].to_numpy() if grouped else None,
                vectors, ids, groups, k,
            )
            yield _pairs_frame(schema, batch["_id"].to_numpy(), rows, *found, rank=True)

    # The search costs far more than moving a query row, so the rows are spread evenly.
    width = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    return q.repartition(width, "_id").mapInPandas(search, out_schema)


def _pick_pivots(b: DataFrame, wanted: int) -> np.ndarray:
    """A seeded sample of base vectors; at most MAX_PIVOTS rows reach the driver."""
    rows = (
        b.select("_vec", seeded_hash("pivot", "_id").alias("_h"), "_id")
        .orderBy("_h", "_id")
        .limit(wanted)
        .collect()
    )
    return np.unique(np.array([r["_vec"] for r in rows], dtype=np.float64), axis=0)


def _to_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(vectors), len(pivots)))
    for d in range(vectors.shape[1]):
        gap = vectors[:, d, None] - pivots[None, :, d]
        out += gap * gap
    return np.sqrt(out)


def _add_columns(df: DataFrame, extra: str, fn) -> DataFrame:
    """``mapInPandas`` that keeps the columns of ``df`` and adds the ones ``fn`` assigns."""
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(extra).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield fn(batch)

    return df.mapInPandas(run, schema)


def _blocked_join(
    q: DataFrame,
    b: DataFrame,
    k: int,
    grouped: bool,
    schema: T.StructType,
    block_rows: int | None,
    query_rows: int,
) -> DataFrame:
    spark = q.sparkSession
    b = stage(b, "knn-base")
    shape = b.agg(F.count("*").alias("n"), F.max(F.size("_vec")).alias("d")).collect()[0]
    n = shape["n"]
    if n == 0:
        return spark.createDataFrame(
            [], T.StructType([*schema.fields, T.StructField("_rank", T.LongType())])
        )
    row_bytes = 8 * max(shape["d"], 1)
    size = min(MAX_BLOCK_BYTES, max(BLOCK_BYTES, n * row_bytes // BLOCKS))
    block_rows = block_rows or max(256, size // row_bytes)
    pivots = _pick_pivots(b, min(MAX_PIVOTS, max(1, n // block_rows)))

    def nearest(batch: pd.DataFrame) -> pd.DataFrame:
        gaps = _to_pivots(_matrix(batch["_vec"]), pivots)
        cell = gaps.argmin(axis=1)
        return batch.assign(_cell=cell.astype("int64"), _gap=gaps[np.arange(len(cell)), cell])

    placed = stage(_add_columns(b, "_cell long, _gap double", nearest), "knn-placed")
    placed = placed.withColumn("_tie", F.xxhash64("_id"))
    ranked = global_rank(placed, "_gap", "_tie", by="_cell", out="_pos", size="_size")
    in_cell = F.ceil(F.col("_size") / F.lit(block_rows))
    part = F.floor((F.col("_pos") - 1) * in_cell / F.col("_size"))
    blocks = stage(
        ranked.withColumn("_block", F.shiftleft("_cell", 40) + part).drop(
            "_pos", "_size", "_tie"
        ),
        "knn-blocks",
    )
    rings = stage(
        blocks.groupBy("_cell", "_block").agg(
            F.min("_gap").alias("_low"), F.max("_gap").alias("_high"), F.count("*").alias("_n")
        ),
        "knn-rings",
    )
    cells = (
        rings.groupBy("_cell").agg(F.min("_low").alias("low"), F.max("_high").alias("high"))
        .orderBy("_cell").toPandas()
    )  # at most MAX_PIVOTS rows
    cell, low, high = (cells[c].to_numpy() for c in ("_cell", "low", "high"))
    between = _to_pivots(pivots, pivots)

    def floors(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least possible distance from each query to each cell, and its distance to the pivot."""
        gaps = _to_pivots(vectors, pivots)
        here = gaps[:, cell]
        ring = np.maximum(low[None, :] - here, here - high[None, :]) - _ROUNDING * (
            here + high[None, :]
        )
        # Members of a cell are nearer to its pivot than to the pivot next to the query.
        own = gaps.argmin(axis=1)
        closest = gaps[np.arange(len(own)), own]
        apart = between[own][:, cell]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (here**2 * (1 - _ROUNDING) - closest[:, None] ** 2) / (2 * apart)
        plane = np.where(apart > 0, plane, 0.0)
        return np.maximum(np.maximum(ring, plane), 0.0), here

    def go(first: int, stop: int):
        """Emit the queries with the cells at these places of their own order, if in reach."""

        def run(batch: pd.DataFrame) -> pd.DataFrame:
            radius = _radius(batch["_d"])
            vectors, found = _matrix(batch["_vec"]), []
            for i in range(0, len(batch), _TILE_QUERIES):
                least, here = floors(vectors[i : i + _TILE_QUERIES])
                order = np.argsort(least, axis=1, kind="stable")[:, first:stop]
                bound = np.take_along_axis(least, order, axis=1)
                rows, place = np.nonzero(bound <= radius[i : i + _TILE_QUERIES, None])
                at = order[rows, place]
                found.append(
                    batch.iloc[rows + i].assign(
                        _cell=cell[at], _gap=here[rows, at], _floor=least[rows, at]
                    )
                )
            return pd.concat(found)

        return run

    fields = ["_id", "_group", "_vec", "_d", "_home"]
    at_cell = "_cell long, _gap double, _floor double"

    def meet_rings(visits: DataFrame, home: bool) -> DataFrame:
        """The blocks of each visited cell that are in reach; at home, only the nearest one."""
        shape = T.StructType([*visits.select(*fields).schema.fields, T.StructField("_block", T.LongType())])

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            block, count = right["_block"].to_numpy(), right["_n"].to_numpy()
            near, far = right["_low"].to_numpy(), right["_high"].to_numpy()
            radius, found = _radius(left["_d"]), []
            for i in range(0, len(left), _TILE_QUERIES):
                some = left.iloc[i : i + _TILE_QUERIES]
                gap = some["_gap"].to_numpy()[:, None]
                least = np.maximum(near[None] - gap, gap - far[None]) - _ROUNDING * (gap + far[None])
                if home:
                    roomy = count >= min(2 * k, count.max())
                    rows = np.arange(len(some))
                    cols = np.where(roomy[None], least, np.inf).argmin(axis=1)
                else:
                    kept = least <= radius[i : i + _TILE_QUERIES, None]
                    rows, cols = np.nonzero(kept & (block[None] != some["_home"].to_numpy()[:, None]))
                found.append(some.iloc[rows][fields].assign(_block=block[cols]))
            return pd.concat(found)

        return _meet(visits, rings, ["_cell"], run, shape, query_rows)

    start = q.withColumns({"_d": F.lit(None).cast("double"), "_home": F.lit(-1).cast("long")})
    homes = stage(
        meet_rings(_add_columns(start, at_cell, go(0, 1)), home=True).withColumn(
            "_home", F.col("_block")
        ),
        "knn-home",
    )
    best = stage(_visit(homes, blocks, k, grouped, schema, query_rows), "knn-first")
    order = Window.partitionBy("query_id").orderBy("_d", "base_id")
    first, width = 0, 1
    # With one block in all, every query has seen it.
    while first < len(cell) and rings.limit(2).count() > 1:
        # A full set of k bounds the k-th distance; otherwise there is no bound.
        reach = best.groupBy(F.col("query_id").alias("_id")).agg(
            F.when(F.count("*") >= k, F.max("_d")).alias("_d")
        )
        bounded = homes.drop("_d", "_block").join(reach, "_id", "left").select(*fields)
        # Each use of it would search the cells of all queries again.
        going = stage(_add_columns(bounded, at_cell, go(first, first + width)), "knn-going")
        visits = stage(meet_rings(going, home=False), "knn-visits")
        if visits.isEmpty() and going.isEmpty():
            break  # cells come best first, so none of the others is in reach either
        more = _visit(visits, blocks, k, grouped, schema, query_rows)
        best = stage(
            best.unionByName(more).withColumn("_rank", F.row_number().over(order))
            .filter(F.col("_rank") <= k).drop("_rank"),
            "knn-best",
        )
        first, width = first + width, min(2 * width, ROUND_CELLS)
    return best.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)


def _radius(reach: pd.Series | np.ndarray) -> np.ndarray:
    """Distance within which a query can still find a neighbour, with room for rounding."""
    d = np.asarray(reach, dtype=np.float64)
    return np.sqrt(np.where(np.isnan(d), np.inf, d + 1.0) / _SCALE) * (1 + _SLACK) + _SLACK


def _meet(
    left: DataFrame, right: DataFrame, keys: list[str], run, schema: T.StructType, left_rows: int
) -> DataFrame:
    """``run`` with each chunk of about ``left_rows`` rows of a key and all its ``right`` rows."""
    chunks = left.groupBy(*keys).agg(
        F.ceil(F.count("*") / F.lit(left_rows)).cast("int").alias("_chunks")
    )
    asked = left.join(chunks, keys).withColumn(
        "_chunk", F.pmod(F.xxhash64("_id"), F.col("_chunks")).cast("int")
    )
    copies = right.join(chunks, keys).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))
    )

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in schema.fields})
        return run(a, b)[schema.names]

    return (
        asked.drop("_chunks").groupBy(*keys, "_chunk")
        .cogroup(copies.drop("_chunks").groupBy(*keys, "_chunk"))
        .applyInPandas(both, schema)
    )


def _visit(
    visits: DataFrame, blocks: DataFrame, k: int, grouped: bool, schema: T.StructType,
    query_rows: int,
) -> DataFrame:
    """Search each visited block for its queries, ``query_rows`` of them per task."""

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = _search_leaves(
            _matrix(left["_vec"]), left["_group"].to_numpy() if grouped else None,
            _matrix(right["_vec"]), right["_id"].to_numpy(),
            right["_group"].to_numpy() if grouped else None, k,
            left["_d"].fillna(np.inf).to_numpy(dtype=np.float64),
        )
        return _pairs_frame(schema, left["_id"].to_numpy(), right, *found, rank=False)

    return _meet(visits, blocks, ["_block"], search, schema, query_rows)


class _Hashes:
    """Random projections cut into steps of one width, ``tables`` times ``per_table`` of them."""

    def __init__(self, dim: int, tables: int, per_table: int, probes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.axes = rng.normal(size=(dim, tables * per_table))
        self.shift = rng.uniform(size=tables * per_table)
        self.shape, self.probes, self.width = (tables, per_table), probes, 1.0
        # A probe leaves the query's own step on one or two axes, towards either side.
        one = [((j, s),) for j in range(per_table) for s in (-1, 1)]
        two = [(*a, *b) for a in one for b in one if a[0][0] < b[0][0]]
        self.moves = np.zeros((1 + len(one) + len(two), per_table), dtype=np.int64)
        for row, move in enumerate([(), *one, *two]):
            for j, side in move:
                self.moves[row, j] = side

    def _steps(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.axes / self.width + self.shift).reshape(len(x), *self.shape)

    def _numbers(self, steps: np.ndarray) -> np.ndarray:
        """A number for each bucket (the last axis are its steps), alike in every task."""
        tables = np.arange(1, self.shape[0] + 1, dtype=np.uint64)
        out = np.broadcast_to(tables.reshape(1, -1, *[1] * (steps.ndim - 3)), steps.shape[:-1]).copy()
        with np.errstate(over="ignore"):
            for j in range(steps.shape[-1]):
                out = (out ^ steps[..., j].astype(np.int64).view(np.uint64)) * _MIX
                out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def own(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        return self._numbers(np.floor(self._steps(x)))

    def probed(self, x: np.ndarray) -> np.ndarray:
        """The buckets that each query looks into, in each table: nearest steps first."""
        steps = self._steps(x)
        low = np.floor(steps)
        inside = steps - low
        # Squared distance, in steps, from the query to the edge that each move crosses.
        cross = (self.moves < 0) * 1.0, (self.moves > 0) * 1.0
        cost = inside**2 @ cross[0].T + (1 - inside) ** 2 @ cross[1].T
        best = np.argsort(cost, axis=2, kind="stable")[:, :, : self.probes]
        return self._numbers(low[:, :, None, :] + self.moves[best])

    def fit(self, x: np.ndarray, k: int, cover: float) -> None:
        """The least width (by steps of a fifth) at which the sample's neighbours are found."""
        ask = np.arange(0, len(x), max(1, len(x) // FIT_QUERIES))
        gaps = _to_pivots(x[ask], x)
        gaps[np.arange(len(ask)), ask] = np.inf
        near = np.argsort(gaps, axis=1, kind="stable")[:, : min(k, max(1, len(x) - 1))]
        far = np.take_along_axis(gaps, near, axis=1)
        far = far[np.isfinite(far) & (far > 0)]
        self.width = float(np.median(far)) / 2 if len(far) else 1.0
        for _ in range(40):
            held, asked = self.own(x), self.probed(x[ask])
            hit = np.zeros(near.shape, dtype=bool)
            for t in range(self.shape[0]):
                hit |= (held[near, t][:, :, None] == asked[:, t][:, None, :]).any(axis=2)
            if hit.mean() >= cover:
                break
            self.width *= 1.2


def _bucket_join(
    q: DataFrame, b: DataFrame, hashes: _Hashes, k: int, grouped: bool, schema: T.StructType,
    block_rows: int, query_rows: int, counts: tuple[int, int],
) -> DataFrame:
    """The k best rows of each bucket that a query looks into; both travel to each of them."""

    def spread(df: DataFrame, numbers, kept: list[str]) -> DataFrame:
        """A row for each bucket of a row; those of a few rows are held at a time."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), _TILE_SPREAD):
                    some = batch.iloc[at : at + _TILE_SPREAD]
                    found = numbers(_matrix(some["_vec"])).reshape(len(some), -1)
                    rows = np.repeat(np.arange(len(some)), found.shape[1])
                    yield some[kept].iloc[rows].assign(_bucket=found.ravel())

        shape = [*df.select(*kept).schema.fields, T.StructField("_bucket", T.LongType())]
        return df.mapInPandas(run, T.StructType(shape))

    held = stage(spread(b, hashes.own, b.columns), "lsh-buckets")
    parts = held.groupBy("_bucket").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("_parts"))
    parts = stage(parts, "lsh-parts")
    block = F.xxhash64("_bucket", "_part").alias("_block")
    held = held.join(parts, "_bucket").withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
    # Vectors follow only to buckets that have rows.
    asked = (
        spread(q, hashes.probed, ["_id"]).join(parts, "_bucket")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .select("_id", block).join(q, "_id").withColumn("_d", F.lit(None).cast("double"))
    )
    return _visit(asked, held.select(*b.columns, block), k, grouped, schema, query_rows)


def _packed(
    df: DataFrame, hashes: _Hashes, rows: int, parts: int, name: str, own: bool
) -> str:
    """A table of ``df`` in packs of at most ``rows`` rows: a number (``_pack``) and bytes (``_rows``).

    Rows of one bucket of the first table lie together, so packs have few buckets where vectors
    have structure. A pack holds the vectors, the other columns and, if ``own``, the different
    buckets of its rows and the places of each row's own among them. There a repeated row is held
    once.
    """
    kind = np.float32 if isinstance(df.schema["_vec"].dataType.elementType, T.FloatType) else np.float64
    kept = [c for c in df.columns if c != "_vec"]

    def first(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(_at=hashes.own(_matrix(batch["_vec"]))[:, 0])

    def one(some: pd.DataFrame) -> bytes:
        x = _matrix(some["_vec"])
        others = {c: some[c].to_numpy() for c in kept}
        if own:
            alike = (x[1:] == x[:-1]).all(axis=1)
            for v in (others["_id"], others["_group"]):
                alike &= (v[1:] == v[:-1]) | (pd.isna(v[1:]) & pd.isna(v[:-1]))
            keep = np.append(True, ~alike)
            x, others = x[keep], {c: v[keep] for c, v in others.items()}
        buckets = _places(hashes.own(x)) if own else None
        return pickle.dumps((x.astype(kind), others, buckets), protocol=5)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            while len(held) >= rows:
                yield pd.DataFrame({"_rows": [one(held.iloc[:rows])]})
                held = held.iloc[rows:]
        if held is not None and len(held):
            yield pd.DataFrame({"_rows": [one(held)]})

    order = ["_at", F.xxhash64("_id")]
    dealt = _add_columns(df, "_at long", first).repartitionByRange(parts, *order).sortWithinPartitions(*order, "_id")
    packs = dealt.drop("_at").mapInPandas(pack, "_rows binary")
    path = fresh_path(df.sparkSession, name)
    packs.withColumn("_pack", F.monotonically_increasing_id()).write.parquet(path)
    return path


def _places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes, in order, and the place of each entry's own among them."""
    different, at = np.unique(codes, return_inverse=True)
    return different, at.reshape(codes.shape).astype(np.min_scalar_type(len(different)))


class _Asking:
    """A pack of queries, the buckets that they look into, and the best rows they have met."""

    def __init__(self, packed: bytes, hashes: _Hashes, k: int):
        x, others, _ = pickle.loads(packed)
        self.x, self.id, self.group, self.k = x.astype(np.float64), others["_id"], others["_group"], k
        looks = np.concatenate(
            [hashes.probed(self.x[at : at + _TILE_SPREAD]) for at in range(0, len(x), _TILE_SPREAD)]
        )
        self.buckets = _places(looks.reshape(len(x), -1))


class _Best:
    """The k best rows of each query among those it has met."""

    def __init__(self, id: np.ndarray, k: int):
        self.id, self.k, self.limit = id, k, np.full(len(id), np.inf)
        self.rows, self.dist, self.others = np.zeros(0, dtype=np.int64), np.zeros(0), {}

    def add(self, rows: np.ndarray, cols: np.ndarray, dist: np.ndarray, others: dict) -> None:
        rows, dist = np.concatenate([self.rows, rows]), np.concatenate([self.dist, dist])
        others = {
            c: np.concatenate([self.others[c], v[cols]]) if self.others else v[cols]
            for c, v in others.items() if c != "_group"
        }
        best = np.lexsort((others["_id"], dist, rows))
        rows, dist, id = rows[best], dist[best], others["_id"][best]
        # A repeated row may be in two packs.
        once = np.append(True, (rows[1:] != rows[:-1]) | (dist[1:] != dist[:-1]) | (id[1:] != id[:-1]))[: len(rows)]
        rows, dist, best = rows[once], dist[once], best[once]
        place = _rank_in_row(rows)
        last, kept = place == self.k - 1, place < self.k
        self.limit[rows[last]] = dist[last]
        self.rows, self.dist = rows[kept], dist[kept]
        self.others = {c: v[best[kept]] for c, v in others.items()}

    def frame(self) -> pd.DataFrame:
        out = {"query_id": self.id[self.rows], "base_id": self.others["_id"], "_d": self.dist}
        return pd.DataFrame({**out, **{c: v for c, v in self.others.items() if c != "_id"}})


def _search_shared(
    asking: _Asking, b: np.ndarray, b_id: np.ndarray, b_group: np.ndarray | None,
    buckets: tuple[np.ndarray, np.ndarray], limit: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``_search``, of rows that share a bucket with the query.

    A few queries at a time go through the rows that share a bucket with any of them. A product
    in single precision, lowered by more than its rounding error, selects the pairs that can still
    be among the best; of these, the ones that share a bucket are measured.
    """
    k, q, q_group, found = asking.k, asking.x, asking.group, []
    (looks, asked), (codes, at) = asking.buckets, buckets
    # The place among the buckets of the rows of each bucket that a query looks into.
    place = np.minimum(np.searchsorted(codes, looks), len(codes) - 1)
    place = np.where(codes[place] == looks, place, len(codes))
    if place.min() == len(codes):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    center = b.mean(axis=0)
    near_q, near_b = q - center, b - center
    q_norm, b_norm = (near_q * near_q).sum(axis=1), (near_b * near_b).sum(axis=1)
    single = max(q_norm.max(), b_norm.max()) < 1e30
    kind, unit = (np.float32, 1.2e-7) if single else (np.float64, 1e-15)
    error = unit * (q.shape[1] + 8)
    near_q, near_b = near_q.astype(kind), (-2.0 * near_b).astype(kind)
    low_b = (b_norm * (1 - error)).astype(kind)
    for q0 in range(0, len(q), _TILE_QUERIES):
        q1 = min(q0 + _TILE_QUERIES, len(q))
        hit = np.zeros((q1 - q0, len(codes) + 1), dtype=bool)
        hit[np.arange(q1 - q0)[:, None], place[asked[q0:q1]]] = True
        hit = hit[:, :-1]
        near = np.nonzero(hit.any(axis=0)[at].any(axis=1))[0]
        bound = limit[q0:q1].copy()
        rows = cols = np.zeros(0, dtype=np.int64)
        dist = np.zeros(0)
        b0 = 0
        while b0 < len(near):
            # Few rows give the first bounds, as these need a look at each pair.
            some = near[b0 : b0 + (LEAF_ROWS if np.isinf(bound).any() else _TILE_BASE)]
            b0 += len(some)
            low = near_q[q0:q1] @ near_b[some].T
            low += low_b[some]
            bar = (bound + 1.0) / _SCALE - q_norm[q0:q1] * (1 - error)
            free = np.nonzero(np.isinf(bound))[0]
            if len(free) and len(some) > k:
                meets = np.zeros((len(free), len(some)), dtype=bool)
                for table in at[some].T:
                    meets |= hit[free][:, table]
                if b_group is not None:
                    meets &= q_group[q0:q1][free][:, None] != b_group[None, some]
                kth = np.partition(np.where(meets, low[free], np.inf), k - 1, axis=1)[:, k - 1]
                bar[free] = kth + 2 * error * (q_norm[q0:q1][free] + b_norm[some].max()) + 1.0 / _SCALE
            # Rounding a bar to single precision must not lower it.
            pairs = np.flatnonzero(low <= np.nextafter(bar.astype(kind), kind(np.inf))[:, None])
            r, c = pairs // len(some), some[pairs % len(some)]
            meets = hit[r[:, None], at[c]].any(axis=1)
            if b_group is not None:
                meets &= q_group[q0 + r] != b_group[c]
            r, c = r[meets], c[meets]
            if not len(r):
                continue
            rows, cols = np.concatenate([rows, r]), np.concatenate([cols, c])
            dist = np.concatenate([dist, _exact(q, q0 + r, b, c)])
            best = np.lexsort((b_id[cols], dist, rows))
            rows, cols, dist = rows[best], cols[best], dist[best]
            rank = _rank_in_row(rows)
            last = rank == k - 1
            bound[rows[last]] = np.minimum(bound[rows[last]], dist[last])
            rows, cols, dist = rows[rank < k], cols[rank < k], dist[rank < k]
        found.append((rows + q0, cols, dist))
    return tuple(np.concatenate(x) for x in zip(*found))


def _packed_join(
    q: DataFrame, b: DataFrame, hashes: _Hashes, k: int, grouped: bool, schema: T.StructType,
    block_rows: int, query_rows: int, counts: tuple[int, int],
) -> DataFrame:
    """The k best rows, among those of shared buckets, of each query; nothing is copied by bucket.

    Both sides are packed. Each task reads some packs of queries and streams the packs of rows past
    them, so what is written grows with the rows, not with the buckets that a query looks into.
    """
    spark = q.sparkSession
    element = b.schema["_vec"].dataType.elementType
    row_bytes = len(hashes.axes) * (4 if isinstance(element, T.FloatType) else 8)
    cores, (asking, n) = spark.sparkContext.defaultParallelism, counts
    fit = max(256, _PACK_BYTES // row_bytes)

    def packed(df: DataFrame, rows: int, count: int, name: str, own: bool) -> str:
        parts = max(-(-count * row_bytes // _PACKED_BYTES), min(cores, -(-count // rows)), 1)
        return _packed(df, hashes, rows, parts, name, own)

    b_path = packed(b, min(block_rows, fit), n, "lsh-rows", own=True)
    # Enough packs of queries for all cores.
    some = min(query_rows, fit, max(1024, -(-asking // (4 * cores))))
    q_path = packed(q.filter(F.col("_id").isNotNull()), some, asking, "lsh-queries", own=False)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, now, asks = {}, None, None
        for batch in batches:
            for number, ask, rows in zip(batch["_pack"], batch["_ask"], batch["_rows"]):
                if number != now:
                    now, asks = number, _Asking(ask, hashes, k)
                if number not in best:
                    best[number] = _Best(asks.id, k)
                held = best[number]
                x, others, buckets = pickle.loads(rows)
                pairs = _search_shared(
                    asks, x.astype(np.float64), others["_id"], others["_group"] if grouped else None,
                    buckets, held.limit,
                )
                if len(pairs[0]):
                    held.add(*pairs, others)
        for held in best.values():
            if len(held.rows):
                yield held.frame()[schema.names]

    # A session of its own, as its rows are large: few may be in a batch, or held by a task.
    large = spark.newSession()
    large.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", _ARROW_PACKS)
    large.conf.set("spark.sql.files.maxPartitionBytes", _HELD_BYTES)
    large.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    asks = large.read.parquet(q_path).select("_pack", F.col("_rows").alias("_ask"))
    pairs = asks.hint("shuffle_replicate_nl").crossJoin(large.read.parquet(b_path).select("_rows"))
    # Those of one part of the queries with all parts of the rows follow each other, mostly in one task.
    tasks = max(asks.rdd.getNumPartitions(), 4 * cores)
    path = fresh_path(spark, "lsh-found")
    pairs.coalesce(tasks).mapInPandas(search, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path).repartition("query_id")


def approx_knn_join(
    query: DataFrame,
    base: DataFrame,
    k: int,
    features: str | Sequence[str],
    id: str = "id",
    exclude: str | None = None,
    carry: Sequence[str] = (),
    tables: int = 8,
    per_table: int = 4,
    probes: int = 12,
    cover: float = COVER,
    block_rows: int = 8192,
    query_rows: int = 8192,
    seed: int = 42,
) -> DataFrame:
    """Like ``knn_join``, but only rows that share a bucket with a query are measured.

    Vectors are projected on random axes and cut into steps; ``per_table`` steps name a
    bucket, in each of ``tables`` tables. A query looks into its own bucket of each table
    and the ``probes - 1`` that are nearest across the edges. The width of a step is fitted
    on at most ``FIT_ROWS`` rows by hash so that the share ``cover`` of their neighbours is
    found; every base row is indexed. Distances are exact; a query may get fewer than k rows.

    Where few rows travel (``MEET_NUMBERS``), they meet by bucket. A bucket with more than
    ``block_rows`` rows is cut into parts by hash, each a task's work; no task returns more than
    k rows for a query. Else rows are packed once, at most ``block_rows`` and ``query_rows``
    together, and pairs that share a bucket are measured where two packs meet.
    """
    spark = base.sparkSession
    group = F.col(exclude) if exclude else F.lit(None).cast("int")
    q = query.select(F.col(id).alias("_id"), group.alias("_group"), _vector_of(query, features).alias("_vec"))
    b = base.select(
        F.col(id).alias("_id"), group.alias("_group"), _vector_of(base, features).alias("_vec"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
    )
    payload = [T.StructField(f"_carry_{c}", base.schema[c].dataType) for c in carry]
    schema = _output_schema(query.schema[id].dataType, base.schema[id].dataType, payload)
    out = [
        "query_id", "base_id", F.col("_rank").cast("int").alias("rank"),
        F.sqrt(F.col("_d") / F.lit(_SCALE)).alias("distance"), *[F.col(f"_carry_{c}").alias(c) for c in carry],
    ]
    b = stage(_distinct_base(b, k, exclude, id), "lsh-base")
    sample = _pick_pivots(b, FIT_ROWS)
    if not len(sample):
        empty = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_rank", T.LongType())]))
        return empty.select(*out)
    hashes = _Hashes(sample.shape[1], tables, per_table, probes, seed)
    hashes.fit(sample, k, cover)

    n, asking = b.count(), q.count()
    copies = tables * (n + asking * probes * -(-n // block_rows))
    join = _bucket_join if copies * sample.shape[1] <= MEET_NUMBERS else _packed_join
    found = join(q, b, hashes, k, exclude is not None, schema, block_rows, query_rows, (asking, n))
    # A row found in several tables is one; its distance is the same in each.
    order = Window.partitionBy("query_id").orderBy("_d", "base_id")
    once = found.dropDuplicates(["query_id", "base_id"])
    return once.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).select(*out)


def knn_classify(
    query: DataFrame,
    base: DataFrame,
    k: int,
    features: str | Sequence[str],
    label: str,
    id: str = "id",
    exclude: str | None = None,
    mode: str = "auto",
) -> DataFrame:
    """Majority class of the k nearest rows and the share of class 1.

    Returns ``id, prediction, score``; of equally frequent classes the smallest wins.
    """
    pairs = knn_join(query, base, k, features, id, exclude, carry=[label], mode=mode)
    return pairs.groupBy(F.col("query_id").alias(id)).agg(
        F.mode(F.col(label), True).cast("double").alias("prediction"),
        F.avg((F.col(label) == 1).cast("double")).alias("score"),
    )
