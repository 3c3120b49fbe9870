"""Hard negatives by window searches in a multiway hyperplane tree.

Scores are inner products of whole-number vectors. One more coordinate lifts every row to
the same norm, so an inner product with an anchor becomes a Euclidean distance to it, and a
window of scores becomes an annulus around the anchor.

The tree splits a node's rows among several split points: each row goes to the nearest, so
the parts are bounded by hyperplanes. Every split point stores the least and the largest
distance to the rows of each part, its own and its siblings'. A part is left out of a
search when, seen from any of the split points, its range of distances does not intersect
the annulus. What is left is followed down to the leaves, where scores are exact.

The tree grows level by level as tables: a node's split points are rows chosen by hash, rows
meet them by node, and nothing but counts reaches the driver. Rows and searches of a busy
node are dealt over several tasks, each with a copy of the node's split points. Copies of
one vector with one label are reduced before that to those that can be among the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import col
from riskflow.workspace import stage

#: Split points of a node, and rows of a leaf at most (but for nodes that cannot be split).
FAN, LEAF_ROWS = 16, 4096
#: Rows by hash among which a node's split points are chosen, for each split point.
CANDIDATES = 3
#: Node numbers have FAN ** depth values; a long holds so many levels.
DEPTH = 15
#: Rows or searches of a node that one task takes, about.
TASK_ROWS = 8_192
#: Distances are compared with this slack, relative to the common norm; rounding is below it.
SLACK = 1e-6
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between this share of the positive's score, in percent, and all of it.
LEAST_SHARE = 80
_TILE = 1_024


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) for each component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    return F.coalesce(F.forall(vector, lambda x: finite(x.cast("double"))), F.lit(False))


class _Space:
    """Vectors as matrices: padded with zeros to one width, and lifted to one norm."""

    def __init__(self, width: int, norm: int, largest: int):
        self.width, self.norm = max(width, 1), float(norm)
        self.slack = SLACK * norm**0.5
        # Sums of products of doubles are exact below 2 ** 53.
        self.kind = np.float64 if self.width * largest * largest < 2**53 else np.int64

    def matrix(self, column: pd.Series) -> np.ndarray:
        out = np.zeros((len(column), self.width), dtype=np.int64)
        for i, v in enumerate(column):
            out[i, :len(v)] = v
        return out

    def lifted(self, x: np.ndarray, anchor: bool = False) -> np.ndarray:
        x = x.astype(np.float64)
        rest = np.zeros(len(x)) if anchor else np.sqrt(np.maximum(0.0, self.norm - (x * x).sum(axis=1)))
        return np.column_stack([x, rest])

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        both = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
        return np.sqrt(np.maximum(0.0, both - 2.0 * (x @ y.T)))

    def annuli(self, x: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distance at which a row scores so much; ``scores`` has a row for each anchor."""
        own = (x * x).sum(axis=1)[:, None]
        return np.sqrt(np.maximum(0.0, own + self.norm - 2.0 * scores))


def _meet(left: DataFrame, right: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` for all of a node's ``right`` rows with each bounded share of its ``left`` rows."""
    shares = left.groupBy("node").agg(F.ceil(F.count("*") / F.lit(TASK_ROWS)).cast("int").alias("shares"))
    dealt = left.join(shares, "node").withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int"))
    copies = right.join(shares, "node").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    keys = ["node", "share"]
    return (
        dealt.drop("shares").groupBy(*keys).cogroup(copies.drop("shares").groupBy(*keys)).applyInPandas(run, schema)
    )


_ROW = "key long, id {id}, label {label}, vec array<long>, node long"


def _split_points(rows: DataFrame, space: _Space, fan: int) -> DataFrame:
    """(node, part, point): split points far from each other, for every node of ``rows``."""
    by_hash = Window.partitionBy("node").orderBy(F.xxhash64(F.lit(17), "vec"), "key")
    some = rows.select("node", "vec", F.row_number().over(by_hash).alias("n")).where(F.col("n") <= CANDIDATES * fan)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", ignore_index=True)
        x = space.matrix(pdf["vec"])
        taken, far = [0], (np.abs(x - x[0])).sum(axis=1).astype(np.float64)
        between = space.distances(space.lifted(x), space.lifted(x))
        far = np.where(far > 0, between[0], -1.0)
        while len(taken) < fan and far.max() > 0:
            taken.append(int(far.argmax()))
            same = (x == x[taken[-1]]).all(axis=1)
            far = np.where(same, -1.0, np.minimum(far, between[taken[-1]]))
        return pd.DataFrame({
            "node": pdf["node"].iloc[0], "part": np.arange(len(taken)), "point": [x[i] for i in taken],
        })

    return some.groupBy("node").applyInPandas(pick, "node long, part int, point array<long>")


class Tree:
    """``levels``: a table for each depth with a row for each part of a split node: (node,
    part, point, low, high); ``leaves``: all rows with the number of their leaf."""

    def __init__(self, space: _Space, fan: int, levels: list[DataFrame], leaves: DataFrame):
        self.space, self.fan, self.levels, self.leaves = space, fan, levels, leaves

    @classmethod
    def grow(cls, rows: DataFrame, space: _Space, fan: int = FAN, leaf_rows: int = LEAF_ROWS) -> Tree:
        """A tree over ``rows`` (key, id, label, vec)."""
        kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
        schema = _ROW.format(**kinds)
        now, levels, leaves = stage(rows.withColumn("node", F.lit(0).cast("long")), "tree-rows"), [], None
        while True:
            sizes = now.groupBy("node").agg(F.count("*").alias("size"))
            large = stage(sizes.where(F.col("size") > leaf_rows).select("node"), "tree-large")
            last = len(levels) >= DEPTH or large.isEmpty()
            small = now if last else now.join(large, "node", "left_anti")
            small = small.select("key", "id", "label", "vec", "node")
            leaves = small if leaves is None else leaves.unionByName(small)
            if last:
                return cls(space, fan, levels, leaves)
            going = now.join(large, "node")
            points = stage(_split_points(going, space, fan), "tree-points")

            def deal(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
                right = right.sort_values("part")
                gaps = space.distances(space.lifted(space.matrix(left["vec"])), space.lifted(space.matrix(right["point"])))
                return left[["key", "id", "label", "vec", "node"]].assign(
                    part=gaps.argmin(axis=1).astype("int32"), gaps=list(gaps)
                )

            dealt = stage(_meet(going, points, deal, f"{schema}, part int, gaps array<double>"), "tree-dealt")
            gap = [F.get("gaps", i) for i in range(fan)]
            ranges = dealt.groupBy("node", "part").agg(
                F.array(*[F.min(g) for g in gap]).alias("low"), F.array(*[F.max(g) for g in gap]).alias("high")
            )
            levels.append(stage(points.join(ranges, ["node", "part"]), "tree-level"))
            now = dealt.withColumn("node", F.col("node") * fan + F.col("part") + 1).drop("part", "gaps")

    def reached(self, searches: DataFrame) -> DataFrame:
        """``searches`` (key, vec, low, high) with the number of each leaf that may hold an answer.

        ``low`` and ``high`` are arrays of scores, the ends of an anchor's windows; a null end is open.
        """
        space, fan = self.space, self.fan
        names = [c for c in searches.columns if c != "node"]
        now = stage(searches.select(*names).withColumn("node", F.lit(0).cast("long")), "tree-searches")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema) + ", ended boolean"
        out = None

        def follow(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):  # a node without parts is a leaf
                return left[[*names, "node"]].assign(ended=True)
            right = right.sort_values("part", ignore_index=True)
            n = len(right)
            points = space.lifted(space.matrix(right["point"]))
            least, most = (np.stack(right[c].to_numpy())[:, :n].astype(float) for c in ("low", "high"))
            found = []
            for at in range(0, len(left), _TILE):
                some = left.iloc[at:at + _TILE]
                x = space.lifted(space.matrix(some["vec"]), anchor=True)
                q = space.distances(x, points)
                # From each split point: the part's rows are no nearer and no farther than this.
                near = np.maximum(least[None] - q[:, None, :], q[:, None, :] - most[None]).max(axis=2)
                far = (q[:, None, :] + most[None]).min(axis=2)
                outer, inner = (space.annuli(x, _ends(some[c], end)) for c, end in (("low", -np.inf), ("high", np.inf)))
                hit = (near[:, :, None] <= outer[:, None, :] + 2 * space.slack) & (
                    far[:, :, None] >= inner[:, None, :] - 2 * space.slack
                )
                i, part = np.nonzero(hit.any(axis=2))
                kept = some.iloc[i]
                found.append(kept.assign(node=kept["node"].to_numpy() * fan + right["part"].to_numpy()[part] + 1))
            return pd.concat(found)[[*names, "node"]].assign(ended=False)

        for level in self.levels:
            met = stage(_meet(now, level, follow, schema), "tree-reached")
            ended, now = met.where("ended").drop("ended"), met.where(~F.col("ended")).drop("ended")
            out = ended if out is None else out.unionByName(ended)
        return now if out is None else out.unionByName(now)


def _ends(column: pd.Series, open_end: float) -> np.ndarray:
    """Ends of the windows as a matrix; missing windows are empty, null ends open."""
    width = max((len(v) for v in column), default=1) or 1
    out = np.full((len(column), width), np.nan)
    for i, v in enumerate(column):
        out[i, :len(v)] = [open_end if e is None or e != e else e for e in v]
    return out


def _first(pairs: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of (anchor, row) pairs the first k rows of each anchor: higher scores, then smaller ids."""
    a, r = pairs
    order = np.lexsort((ids[r], -scores, a))
    a, r, scores = a[order], r[order], scores[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], r[keep], scores[keep]


def _scored(visits: DataFrame, tree: Tree, k: int, same: bool) -> DataFrame:
    """(key, window, id, score): the first k rows of each window in each visited leaf.

    ``same``: rows of the anchor's label but not its id; else rows of another label.
    """
    space = tree.space
    kind = tree.leaves.schema["id"].dataType.simpleString()
    columns = ["key", "window", "id", "score"]

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            base = space.matrix(right["vec"]).astype(space.kind)
            ids, labels = right["id"].to_numpy(), right["label"].to_numpy()
            for at in range(0, len(left), _TILE):
                some = left.iloc[at:at + _TILE]
                product = space.matrix(some["vec"]).astype(space.kind) @ base.T
                equal = some["label"].to_numpy()[:, None] == labels[None, :]
                able = equal & (some["id"].to_numpy()[:, None] != ids[None, :]) if same else ~equal
                lows, highs = _ends(some["low"], -np.inf), _ends(some["high"], np.inf)
                for w in range(lows.shape[1]):
                    pairs = np.nonzero(able & (product >= lows[:, w, None]) & (product <= highs[:, w, None]))
                    a, r, s = _first(pairs, product[pairs].astype(np.int64), ids, k)
                    found.append(pd.DataFrame({
                        "key": some["key"].to_numpy()[a], "window": w, "id": ids[r], "score": s,
                    }))
        # An empty frame beside others would turn whole numbers into doubles.
        return pd.concat(found)[columns] if found else pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})

    return _meet(visits, tree.leaves, score, f"key long, window int, id {kind}, score long")


def _numbered(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bounds(found: DataFrame, k: int) -> DataFrame:
    """(key, window, least): the k-th best score of each window with k rows."""
    full = _numbered(found, k).groupBy("key", "window").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    return full.where(F.col("n") >= k).select("key", "window", "least")


def hard_negatives(
    df: DataFrame, id_col: str, vec_col: str, label: Column, anchor: Column, positives: int = POSITIVES,
    negatives: int = NEGATIVES, least_share: int = LEAST_SHARE, scale: int = 256, fan: int = FAN,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``label`` and ``anchor`` are expressions over ``df``. An anchor's positives are the first
    ``positives`` other rows of its label by score, ties by smaller id; for each, the first
    ``negatives`` rows of another label score between ``least_share`` percent of the
    positive's score and all of it. Rows with a null id, label or vector, or a null or
    non-finite component, take no part. Rows equal in id, label and vector are one; of
    rows that share an id otherwise, none is another's positive. A shorter vector counts as
    filled up with zeros. An empty table, or one without a second row of an anchor's label,
    gives no rows for it. Other columns are not read, whatever their names. Scores beyond a
    long raise an error.
    """
    held = df.select(
        col(id_col).alias("id"), label.alias("label"), col(vec_col).alias("v"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).where("id is not null and label is not null").where(usable(F.col("v")))
    rows = stage(
        held.select("id", "label", quantised(F.col("v"), scale).alias("vec"), "anchor").distinct()
        .withColumn("key", F.xxhash64("id", "label", "vec")),
        "negatives-rows",
    )
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    shape = rows.agg(
        F.max(F.size("vec")).alias("width"), F.max(squares).alias("norm"),
        F.max(F.array_max(F.transform("vec", F.abs))).alias("largest"),
    ).first()
    if (shape["norm"] or 0.0) >= 2.0**62:
        raise ValueError("scores of these vectors do not fit a long")
    space = _Space(shape["width"] or 0, int(shape["norm"] or 0), int(shape["largest"] or 0))
    # An anchor passes over at most one copy, its own row.
    copies = Window.partitionBy("label", "vec").orderBy("id")
    base = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= max(positives + 1, negatives))
    tree = Tree.grow(base.select("key", "id", "label", "vec"), space, fan, leaf_rows)
    tree.leaves = stage(tree.leaves, "negatives-leaves")

    # Equal vectors may meet in different leaves only by rounding; any of them is a good start.
    home = tree.leaves.groupBy(F.xxhash64("vec").alias("vh")).agg(F.min("node").alias("node"))
    asked = rows.where("anchor").select("key", "id", "label", "vec", F.xxhash64("vec").alias("vh"))
    open_end = F.array(F.lit(None).cast("long"))
    start = stage(
        asked.join(home, "vh").drop("vh").withColumns({"low": open_end, "high": open_end}), "negatives-start"
    )
    bound = stage(_bounds(_scored(start, tree, positives, same=True), positives), "negatives-bound")
    searches = start.drop("low", "node").join(bound.select("key", F.array("least").alias("low")), "key", "left")
    searches = searches.withColumn("low", F.coalesce("low", open_end))
    near = stage(_numbered(_scored(tree.reached(searches), tree, positives, same=True), positives), "negatives-positives")

    # Window w of an anchor belongs to its positive of rank w + 1; scores below zero have none.
    windows = near.where("score >= 0").groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), "score"))).alias("near")
    )
    least = lambda s: F.call_function("div", s * least_share + 99, F.lit(100))
    windows = windows.select(
        "key", "near", F.transform("near", lambda p: least(p["score"])).alias("low"),
        F.transform("near", lambda p: p["score"]).alias("high"),
    )
    begin = stage(start.drop("low", "high").join(windows, "key"), "negatives-windows")
    bound = _bounds(_scored(begin.drop("near"), tree, negatives, same=False), negatives)
    bound = stage(bound, "negatives-bounds").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("least"))
    searches = begin.drop("near", "node").join(bound, "key", "left").withColumn(
        "low", F.transform("low", lambda x, i: F.greatest(x, F.try_element_at("least", i)))
    ).drop("least")
    found = _numbered(_scored(tree.reached(searches), tree, negatives, same=False), negatives)
    named = begin.select("key", F.col("id").alias("anchor_id"), "near")
    return found.join(named, "key").select(
        "anchor_id", F.get("near", F.col("window"))["positive_id"].alias("positive_id"), "rank",
        F.col("id").alias("negative_id"), F.get("near", F.col("window"))["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


ORACLE = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
