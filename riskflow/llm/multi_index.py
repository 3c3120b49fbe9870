"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: signs after rotations learned by iterative quantisation, several
rotations side by side. A code is cut into substrings and each substring is indexed. If two
codes differ in at most ``radius`` bits, they differ in at most ``radius // substrings``
bits of at least one substring; so probing each substring's index at all values within that
many bits retrieves every code within the radius. What is retrieved is verified by its
Hamming distance and reranked by exact distance on the original vectors.

Rotations and radius are fitted on a bounded sample; every row is indexed. Queries and rows
meet in blocks, and only a block's best few rows per query leave it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import col
from riskflow.workspace import stage

#: Rows that rotations and radius are fitted on, at most, in hash order.
SAMPLE = 8_192
ROTATIONS, ITERATIONS = 4, 25
#: Bits of a substring; its index has 2 ** SUB_BITS lists.
SUB_BITS = 8
#: Share of the sample's true neighbours whose codes lie within the radius.
COVER = 0.985
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 1_024


def learn_rotations(x: np.ndarray, rotations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, one matrix of all rotations) by alternating codes and Procrustes solutions."""
    rng, mean, d = np.random.default_rng(seed), x.mean(axis=0), x.shape[1]
    v, out = x - mean, []
    for _ in range(rotations):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(ITERATIONS):
            u, _, vt = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ vt).T
        out.append(r)
    return mean, np.concatenate(out, axis=1)


def encode(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Codes as rows of bytes; each byte is a substring."""
    return np.packbits((x - mean) @ rotation > 0, axis=1)


def fit_radius(x: np.ndarray, codes: np.ndarray, k: int, cover: float) -> int:
    """The radius that holds a share of the true k nearest neighbours of sampled queries."""
    ask = np.arange(0, len(x), max(1, len(x) // 256))
    far = []
    for q in ask:
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        near = np.argpartition(d, min(k, len(d) - 1) - 1)[:k] if len(d) > k else np.arange(len(d))
        near = near[near != q]
        far.append(np.bitwise_count(codes[near] ^ codes[q]).sum(axis=1))
    far = np.concatenate(far) if far else np.zeros(1)
    return int(np.quantile(far, cover, method="higher")) if len(far) else codes.shape[1] * 8


class SubstringIndex:
    """Lists of the rows of a block by the value of each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        values = np.arange(2**SUB_BITS + 1)
        self.starts = np.stack([
            np.searchsorted(codes[self.order[:, s], s], values) for s in range(codes.shape[1])
        ])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code lies within the radius, by pigeonhole probing."""
        errors = radius // self.codes.shape[1]
        near = _PATTERNS[np.bitwise_count(_PATTERNS) <= errors]
        seen = np.zeros(len(self.codes), dtype=bool)
        for s in range(self.codes.shape[1]):
            probes = (near ^ code[s]).astype(np.int64)
            lo = self.starts[s, probes]
            n = self.starts[s, probes + 1] - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            seen[self.order[at, s]] = True
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(axis=1) <= radius]


_PATTERNS = np.arange(2**SUB_BITS, dtype=np.uint8)


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(col(vector_col), lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        df.select(col(id_col).alias("id"), v.alias("v")).where("v is not null and size(v) > 0 and id is not null")
        .where(good & F.exists("v", lambda x: x != 0)).dropDuplicates()
    )


def nearest(
    df: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42
) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found of each row whose id divides by ``every``.

    Vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor
    do rows without an id, nor vectors of a length other than the most common one. Rows
    equal in id and vector count once; a query's own id is never its neighbour. Ties go to
    the smaller id. With fewer than k rows within the radius the query is searched again
    over all rows. An empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"query_id {id_type}, id {id_type}, score double"
    rows = stage(_usable(df, id_col, vector_col).withColumn("h", F.xxhash64(F.lit(seed), "id", "v")), "ann-rows")
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    empty = spark.createDataFrame([], f"query_id {id_type}, rank int, id {id_type}, score double")
    if size is None:
        return empty
    rows = rows.where(F.size("v") == size.d)
    sample = rows.select("v").distinct().orderBy(F.xxhash64("v")).limit(SAMPLE).toPandas()
    x = np.stack([np.asarray(v, dtype=np.float64) for v in sample["v"]])
    mean, rotation = learn_rotations(x, ROTATIONS, seed)
    radius = fit_radius(x, encode(x, mean, rotation), k, COVER)

    asked = rows.where(F.col("id") % every == 0)
    n_queries = asked.count()
    blocks = max(1, -(-size.n // BLOCK_ROWS))
    teams = max(1, -(-n_queries // BLOCK_QUERIES))
    at = F.pmod("h", F.lit(blocks)).cast("int").alias("block")
    team = F.pmod("h", F.lit(teams)).cast("int").alias("team")

    def search(reach: int):
        def run(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
            if not len(queries) or not len(base):
                return pd.DataFrame({"query_id": [], "id": [], "score": []})
            ids = base["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], np.stack(base["v"].to_numpy())[order]
            asked_ids, asked_v = queries["id"].to_numpy(), np.stack(queries["v"].to_numpy())
            index = SubstringIndex(encode(vectors, mean, rotation))
            out = []
            for q, v, code in zip(asked_ids, asked_v, encode(asked_v, mean, rotation)):
                found = index.within(code, reach)
                found = found[ids[found] != q]
                gap = np.sqrt(((vectors[found] - v) ** 2).sum(axis=1))
                best = np.lexsort((ids[found], gap))[:k]
                out.append(pd.DataFrame({"query_id": q, "id": ids[found][best], "score": gap[best]}))
            return pd.concat(out, ignore_index=True)

        return run

    def meet(queries: DataFrame, reach: int) -> DataFrame:
        left = queries.select("id", "v", team, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        right = rows.select("id", "v", at, F.explode(F.sequence(F.lit(0), F.lit(teams - 1))).alias("team"))
        found = left.groupBy("team", "block").cogroup(right.groupBy("team", "block")).applyInPandas(search(reach), schema)
        order = Window.partitionBy("query_id").orderBy("score", "id")
        return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)

    first = stage(meet(asked, radius), "ann-found")
    short = asked.join(
        first.groupBy("query_id").agg(F.count("*").alias("n")), F.col("id") == F.col("query_id"), "left"
    ).where(F.coalesce("n", F.lit(0)) < k).select("id", "v", "h")
    short = stage(short, "ann-short")
    if not short.isEmpty():
        again = meet(short, rotation.shape[1])
        first = first.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
    return first.select("query_id", "rank", "id", "score")
