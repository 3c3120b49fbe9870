"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits. Two fingerprints that differ in at most ``distance`` bits agree
on at least ``blocks - distance`` of ``blocks`` blocks, so they share one of the keys made
of that many blocks (20 keys of about 32 bits for 6 blocks and 3 bits). Equal fingerprints
are one row before anything is joined. Fingerprints are brought together by key; inside a
key only a spanning forest of the links is given out, never all pairs, and a key that holds
many fingerprints is cut again by the same principle on the bits that still vary. Every
link found is verified by its Hamming distance. Components come from the forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import col, hidden, row_hash, small_batches
from riskflow.llm.components import connected_components
from riskflow.workspace import stage

BITS = 64
#: Shingles hashed at a time, which bounds memory for very long texts.
_CHUNK = 200_000
#: A group of so many fingerprints is compared directly; a larger one is cut again.
_DIRECT = 1024


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, A-Z lower-cased; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    line = b" ".join(words)
    ends = (ends - 1).tolist()
    k = min(shingle, len(words))
    total, votes = len(words) - k + 1, np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, _CHUNK):
        upto = min(at + _CHUNK, total)
        hashes = np.fromiter(
            (digest(line[s:e], seed) for s, e in zip(starts[at:upto], ends[at + k - 1:upto + k - 1])),
            dtype="<u8", count=upto - at,
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str, out: str, shingle: int = 3) -> DataFrame:
    """Add the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint(t, shingle) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(values.view(np.int64))

    return df.withColumn(out, of(col(text_col)))


def _spans(bits: np.ndarray, blocks: int) -> list[int]:
    """Cut the given bit positions into blocks, each as a mask."""
    return [int(sum(1 << int(b) for b in part)) for part in np.array_split(bits, blocks)]


def key_masks(bits: np.ndarray, distance: int, blocks: int) -> list[int]:
    """Masks of which any two fingerprints within ``distance`` agree on at least one."""
    spans = _spans(bits, blocks)
    return [sum(c) for c in combinations(spans, blocks - distance)]


def links(prints: np.ndarray, distance: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest whose components are those of all links among distinct fingerprints."""
    if len(prints) <= _DIRECT:
        return _forest(prints, distance)
    vary = np.bitwise_or.reduce(prints ^ prints[0])
    bits = np.flatnonzero(np.unpackbits(np.array([vary], dtype="<u8").view(np.uint8), bitorder="little"))
    if len(bits) <= 2 * blocks:
        return _forest(prints, distance)
    lefts, rights = [], []
    for mask in key_masks(bits, distance, blocks):
        keys = prints & np.uint64(mask)
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for part in np.split(order, cuts):
            if 1 < len(part) < len(prints):
                a, b = links(prints[part], distance, blocks)
            elif len(part) == len(prints):
                a, b = _forest(prints, distance)
            else:
                continue
            lefts.append(a)
            rights.append(b)
    if not lefts:
        return prints[:0], prints[:0]
    return np.concatenate(lefts), np.concatenate(rights)


def _forest(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    rest, lefts, rights = prints, [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                queue.extend(found)
                lefts.append(np.full(len(found), at, dtype=np.uint64))
                rights.append(found)
    if not lefts:
        return prints[:0], prints[:0]
    return np.concatenate(lefts), np.concatenate(rights)


def link_forest(prints: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b) links of distinct fingerprints (``fp`` long) that span all components."""
    masks = key_masks(np.arange(BITS), distance, blocks)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed]))
    keyed = prints.select("fp", keys.alias("no", "key"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            no, key = pdf["no"].to_numpy(), pdf["key"].to_numpy()
            cuts = np.flatnonzero((np.diff(no) != 0) | (np.diff(key) != 0)) + 1
            if not len(cuts):
                held = pdf
                continue
            held = pdf.iloc[cuts[-1]:]
            yield from groups(pdf["fp"].to_numpy()[: cuts[-1]], cuts[:-1])
        if held is not None:
            yield from groups(held["fp"].to_numpy(), np.empty(0, dtype=np.int64))

    def groups(fp: np.ndarray, cuts: np.ndarray) -> Iterator[pd.DataFrame]:
        fp = np.ascontiguousarray(fp).view(np.uint64)
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [len(fp)]]))
        pair = starts[sizes == 2]
        pair = pair[np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= distance]
        lefts, rights = [fp[pair]], [fp[pair + 1]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            a, b = links(fp[s:s + n], distance, blocks)
            lefts.append(a)
            rights.append(b)
        a, b = np.concatenate(lefts), np.concatenate(rights)
        if len(a):
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return keyed.repartition("no", "key").sortWithinPartitions("no", "key").mapInPandas(find, "a long, b long")


def near_duplicate_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = 3, distance: int = 3, blocks: int = 6,
) -> DataFrame:
    """One row per input row: the id, ``fingerprint`` (16 hex digits) and ``component_id``.

    A null or empty text has fingerprint zero and links like any other. The component id is
    the smallest non-null id reachable over links, null if there is none. Repeated rows stay
    as they are; an empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    with small_batches(spark):
        # Python runs over the texts once, behind the written table.
        docs = stage(
            fingerprints(df.select(col(id_col).alias("id"), col(text_col).alias("t")), "t", "fp", shingle)
            .select("id", "fp"),
            "simhash",
        )
    classes = stage(docs.groupBy("fp").agg(F.min("id").alias("first")), "simhash-classes")
    forest = stage(link_forest(classes.select("fp"), distance, blocks).distinct(), "simhash-links")
    roots = connected_components(forest)
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id")
    return docs.join(labels, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = 3, distance: int = 3, blocks: int = 6,
) -> DataFrame:
    """The rows of ``df`` with one row of each component: that with the smallest id.

    Ties on the id go to the smallest hash of the whole row; rows equal in all columns
    count once. A component without any id keeps the row with the smallest hash.
    """
    names = df.columns
    k1, k2 = hidden(df, "k1", "k2")
    keyed = df.withColumns({k1: row_hash(names, 1), k2: row_hash(names, 2)})
    ids = keyed.select(col(id_col).alias("id"), col(text_col).alias("t"), F.col(k1).alias("k1"), F.col(k2).alias("k2"))
    spark = df.sparkSession
    with small_batches(spark):
        docs = stage(fingerprints(ids, "t", "fp", shingle).select("id", "k1", "k2", "fp"), "simhash")
    best = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "k1", "k2")).alias("best")
    classes = stage(docs.groupBy("fp").agg(best), "simhash-classes")
    forest = stage(link_forest(classes.select("fp"), distance, blocks).distinct(), "simhash-links")
    roots = connected_components(forest)
    kept = (
        classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
        .select(F.col("best.k1").alias(k1), F.col("best.k2").alias(k2))
    )
    kept = stage(kept, "simhash-kept")
    out = keyed.join(kept.hint("shuffle_hash"), [k1, k2], "left_semi")
    repeated = stage(docs.join(kept.withColumnsRenamed({k1: "k1", k2: "k2"}), ["k1", "k2"])
                     .groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select(
                         F.col("k1").alias(k1), F.col("k2").alias(k2)), "simhash-repeated")
    if not repeated.isEmpty():
        once = out.join(repeated, [k1, k2], "left_semi").dropDuplicates([k1, k2])
        out = out.join(repeated, [k1, k2], "left_anti").unionByName(once)
    return out.select(*[col(c) for c in names])
