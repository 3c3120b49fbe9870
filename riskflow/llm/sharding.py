"""Shard rows by a uniform shuffle with exact shard sizes.

Rows lie in hash partitions of bounded size. A communication matrix says how many rows of
each partition go to each shard; it is drawn from the distribution a uniform permutation
of all rows would give, a multivariate hypergeometric with the partition sizes and the
shard sizes as margins. The matrix is drawn down a tree: a node's column counts are split
over its children, so a task draws for ``FAN_OUT`` children only and no task sees all
partitions. Each partition is permuted locally and cut by its row of the matrix; after the
exchange each shard is permuted again, in sub-buckets with offsets, so that no task holds a
whole shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import col, hidden, row_hash, uniform
from riskflow.workspace import stage

FAN_OUT = 64
#: Rows of a partition, and of a sub-bucket of a shard, on average.
BLOCK_ROWS = 20_000
#: numpy draws hypergeometric numbers below this population; larger ones are split first.
_NUMPY_MAX = 900_000_000


def draw_counts(rng: np.random.Generator, colors: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows drawn without replacement have each color, given their counts."""
    out, left, pool = np.zeros(len(colors), dtype=np.int64), int(n), int(colors.sum())
    for j, good in enumerate(colors):
        pool -= int(good)
        if left == 0:
            break
        got = hypergeometric(rng, int(good), pool, left)
        out[j], left = got, left - got
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric number of any size.

    Beyond numpy's range it is drawn by rejection from a geometric-tailed proposal around
    the mode; ratios of probabilities are evaluated as differences of log-gamma terms near
    the mode, which keeps double precision.
    """
    if good == 0 or n == 0:
        return 0
    if bad == 0:
        return n
    if good + bad <= _NUMPY_MAX:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(good, n)
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    spread = np.sqrt(max(n * (good / total) * (bad / total) * ((total - n) / total), 0.0)) + 1.0

    def log_ratio(k: int) -> float:
        """log p(k) - log p(mode)."""
        def rise(base: int, d: int) -> float:
            """log((base + d)! / base!)"""
            x, y = base + 1.0, base + d + 1.0
            if min(x, y) < 1e4:
                step, lo, hi = (1, base, base + d) if d >= 0 else (-1, base + d, base)
                return step * float(np.log(np.arange(lo + 1, hi + 1, dtype=float)).sum())
            return (y - 0.5) * float(np.log1p(d / x)) + d * (float(np.log(x)) - 1) + (1 / y - 1 / x) / 12

        d = k - mode
        return -(
            rise(mode, d) + rise(good - mode, -d) + rise(n - mode, -d) + rise(bad - n + mode, d)
        )

    while True:
        # The difference of two geometric numbers has the mass of exp(-|d| / spread) at every
        # whole d, and dominates the log-concave distribution up to the factor e.
        p = -np.expm1(-1.0 / spread)
        d = int(rng.geometric(p)) - int(rng.geometric(p))
        k = mode + d
        if low <= k <= high and np.log(rng.random()) < log_ratio(k) + abs(d) / spread - 1.0:
            return k


def communication_matrix(sizes: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, counts): rows of each partition for each shard. ``sizes`` has part and n.

    Partitions are numbered from 0 without gaps. Shard sizes are at most one apart, the
    larger ones first.
    """
    totals = sizes.agg(F.sum("n").alias("n"), F.max("part").alias("p")).first()
    rows, parts = int(totals.n or 0), int(totals.p if totals.p is not None else -1) + 1
    levels = [sizes.select(F.col("part").cast("long").alias("node"), "n")]
    while parts > 1:
        parts = -(-parts // FAN_OUT)
        levels.append(stage(
            levels[-1].groupBy(F.floor(F.col("node") / FAN_OUT).alias("node")).agg(F.sum("n").alias("n")),
            "shard-tree",
        ))
    base, more = divmod(rows, shards)
    first = F.array(*[F.lit(base + (j < more)).cast("long") for j in range(shards)])
    counts = levels[-1].select("node", first.alias("counts"))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        left = np.asarray(pdf["counts"].iloc[0], dtype=np.int64).copy()
        rng = np.random.default_rng([seed, int(pdf["depth"].iloc[0]), int(pdf["parent"].iloc[0])])
        out = []
        for n in pdf["n"]:
            got = draw_counts(rng, left, n)
            left -= got
            out.append(got)
        return pd.DataFrame({"node": pdf["node"], "counts": out})

    for depth, children in reversed(list(enumerate(levels[:-1]))):
        pairs = children.withColumn("parent", F.floor(F.col("node") / FAN_OUT)).join(
            counts.select(F.col("node").alias("parent"), "counts"), "parent"
        ).withColumn("depth", F.lit(depth))
        counts = stage(
            pairs.groupBy("parent").applyInPandas(split, "node long, counts array<long>"), "shard-matrix"
        )
    return counts.withColumnRenamed("node", "part")


def assign(rows: DataFrame, shards: int = 40, seed: int = 42) -> DataFrame:
    """Add ``shard`` and ``slot`` to a frame, each row once; ties are broken by a hash.

    Equal rows are counted before the shuffle and numbered afterwards, so a row that
    occurs very often is spread over all partitions.
    """
    names = rows.columns
    nth, h, part, rank = hidden(rows, "nth", "h", "part", "rank")
    units = stage(rows.groupBy(*[col(c) for c in names]).agg(F.count("*").alias(nth)), "shard-units")
    total = units.agg(F.sum(nth)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_ROWS))
    numbered = (
        units.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(nth))))
        .withColumn(h, row_hash([*names, nth], seed))
        .withColumn(part, F.pmod(F.col(h), F.lit(blocks)))
    )
    found = numbered.groupBy(part).agg(F.count("*").alias("n"))
    sizes = stage(
        rows.sparkSession.range(blocks).withColumnRenamed("id", "part")
        .join(found.withColumnRenamed(part, "part"), "part", "left")
        .select("part", F.coalesce("n", F.lit(0)).alias("n")),
        "shard-sizes",
    )
    matrix = communication_matrix(sizes, shards, seed)
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(shards)),
        lambda j: F.aggregate(F.slice(F.col("counts"), F.lit(1), j), F.lit(0).cast("long"), lambda a, x: a + x),
    )
    matrix = matrix.select(F.col("part").alias(part), ends.alias("ends"))
    local = Window.partitionBy(part).orderBy(uniform(F.lit(seed), F.lit(1), F.col(h)), h)
    sent = (
        numbered.withColumn(rank, F.row_number().over(local) - 1).join(matrix, part)
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= col(rank))).cast("int"))
    )
    sent = stage(sent.select(*[col(c) for c in names], h, "shard"), "shard-sent")

    # The second permutation: random priorities, cut into sub-buckets with known offsets.
    buckets = max(1, -(-total // (shards * BLOCK_ROWS)))
    bucketed = sent.withColumn("u", uniform(F.lit(seed), F.lit(2), F.col(h))).withColumn(
        "bucket", F.floor(F.col("u") * buckets)
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("u", h)) - 1
    return (
        bucketed.withColumn("place", place).join(offsets, ["shard", "bucket"])
        .select(*[col(c) for c in names], "shard", (F.col("place") + F.col("offset")).cast("long").alias("slot"))
    )


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def shard_rows(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, seed: int = 42
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shard counts are at most one apart. A null text has size 16 and
    the checksum of an empty one; repeated rows each get a place of their own; an empty
    table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    rows = df.select(
        col(id_col).alias("id"), text_size(text).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return assign(rows, shards, seed).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_table(df: DataFrame, shards: int = 40, seed: int = 42) -> DataFrame:
    """All rows with all their columns, and ``shard`` and ``slot`` (renamed if taken).

    Places are drawn on hashes of whole rows; texts move once, in the join that brings
    the places back. Rows that occur more than once are fetched once and repeated.
    """
    names = df.columns
    k1, k2, m = hidden(df, "k1", "k2", "m")
    keyed = df.withColumns({k1: row_hash(names, 1), k2: row_hash(names, 2)})
    places = stage(assign(keyed.select(k1, k2), shards, seed), "shard-places")
    counted = places.groupBy(k1, k2).agg(F.count("*").alias(m))
    repeated = stage(counted.where(F.col(m) > 1).drop(m), "shard-repeated")
    taken = {c.lower() for c in names}
    shard, slot = ("shard", "slot") if not taken & {"shard", "slot"} else hidden(df, "shard", "slot")
    places = places.withColumnsRenamed({"shard": shard, "slot": slot})
    if repeated.isEmpty():
        out = keyed.join(places.hint("shuffle_hash"), [k1, k2])
    else:
        single = places.join(repeated, [k1, k2], "left_anti")
        once = keyed.join(repeated, [k1, k2], "left_semi").dropDuplicates([k1, k2])
        out = keyed.join(single.hint("shuffle_hash"), [k1, k2]).unionByName(
            once.join(places.join(repeated, [k1, k2]), [k1, k2])
        )
    return out.select(*[col(c) for c in names], shard, slot)
