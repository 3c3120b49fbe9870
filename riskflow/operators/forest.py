"""Random forest whose passes over the rows do not grow with its nodes.

Nodes with many rows are split level by level: a pass adds up, per open node, the class counts
of the bins of its features. A node with few rows is a cell: its rows travel once, to one task,
which finishes the subtree below. Bins, bags, features of a node, gains and pruning are those of
Spark ML's forest, and the result is its model class; random draws are hashes of row and node.
"""

from __future__ import annotations

import json
import math
import time

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.workspace import fresh_path, stage

# Rows of a cell: from the first to the second as the rows grow, so that a tree has about CELLS.
CELL_ROWS, MAX_CELL_ROWS, CELLS = 20_000, 500_000, 32
# Rows that bins are cut on (as Spark ML does), and nodes of a cell that are split together.
BIN_ROWS, NODES = 10_000, 4_096
_MODEL = "org.apache.spark.ml.classification.RandomForestClassificationModel"
_TREE = "org.apache.spark.ml.classification.DecisionTreeClassificationModel"


def _mix(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64 bits of each number."""
    with np.errstate(over="ignore"):
        x = (np.asarray(x).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _bag(rows: np.ndarray, key: np.uint64, cdf: np.ndarray) -> np.ndarray:
    """How often each row is in the sample of a tree: Poisson draws."""
    u = (_mix(_mix(rows) ^ key) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(cdf, u, side="right").astype(np.uint8)


def _chosen(key: np.uint64, nodes: np.ndarray, size: int, subset: int) -> np.ndarray:
    """The features that each node may split on."""
    keys = _mix(_mix(nodes ^ np.int64(-1))[:, None] ^ _mix(np.arange(size))[None] ^ key)
    return np.sort(np.argsort(keys, axis=1)[:, :subset], axis=1)


def _gini(counts: np.ndarray) -> np.ndarray:
    n = counts.sum(axis=-1, keepdims=True)
    return 1.0 - ((counts / np.maximum(n, 1.0)) ** 2).sum(axis=-1)


def best_splits(hist: np.ndarray, least: int, min_gain: float):
    """``slot, bin, gain`` of the best split of each node, and its class counts.

    ``hist`` holds nodes, features, bins, classes. A split sends bins up to ``bin`` left;
    the gain is 0 where no split is allowed.
    """
    total = hist[:, 0].sum(axis=1)
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    right = total[:, None, None] - left
    n, a, b = total.sum(axis=-1)[:, None, None], left.sum(axis=-1), right.sum(axis=-1)
    gain = _gini(total)[:, None, None] - a / n * _gini(left) - b / n * _gini(right)
    gain[(a < least) | (b < least) | (gain < min_gain)] = -np.inf
    flat = gain.reshape(len(hist), -1)
    if not flat.shape[1]:
        zero = np.zeros(len(hist), dtype=np.int64)
        return zero, zero, np.zeros(len(hist)), total
    best = flat.argmax(axis=1)
    slot, cut = np.divmod(best, gain.shape[2])
    return slot, cut, np.maximum(flat[np.arange(len(hist)), best], 0.0), total


def _histogram(bins, y, w, local, features, nodes: int, width: int, classes: int) -> np.ndarray:
    """Weighted class counts by node, slot of its features, and bin."""
    subset = features.shape[1]
    at = np.take_along_axis(bins, features[local], axis=1).astype(np.int64)
    at += (local[:, None] * subset + np.arange(subset)) * width
    flat = (at * classes + y[:, None]).ravel()
    sums = np.bincount(flat, np.repeat(w.astype(np.float64), subset), nodes * subset * width * classes)
    return sums.reshape(nodes, subset, width, classes)


def grow_cell(bins, y, w, root: int, key: np.uint64, plan: dict) -> dict[str, np.ndarray]:
    """All nodes of the subtree below ``root`` (numbers as in a heap, 1 is the tree's root)."""
    done: dict[str, list] = {c: [] for c in ("node", "feature", "bin", "gain", "counts")}
    nodes, local = np.array([root], dtype=np.int64), np.zeros(len(y), dtype=np.int64)
    rows, depth = np.arange(len(y)), int(root).bit_length() - 1
    while len(nodes):
        following, kept, below = [], [], 0
        starts = np.searchsorted(local, np.arange(len(nodes) + 1))
        for a in range(0, len(nodes), NODES):
            part = nodes[a : a + NODES]
            r = rows[starts[a] : starts[a + len(part)]]
            at = local[starts[a] : starts[a + len(part)]] - a
            features = _chosen(key, part, bins.shape[1], plan["subset"])
            hist = _histogram(bins[r], y[r], w[r], at, features, len(part), plan["width"], plan["classes"])
            slot, cut, gain, total = best_splits(hist, plan["least"], plan["min_gain"])
            if depth == plan["depth"]:
                gain = np.zeros(len(part))
            gain[_gini(total) < 2.3e-16] = 0.0
            feature = np.where(gain > 0, features[np.arange(len(part)), slot], -1)
            for name, value in zip(done, (part, feature, cut, gain, total)):
                done[name].append(value)
            split = feature >= 0
            # Children of the nodes that split, in order, numbered from ``below``.
            first = below + 2 * (np.cumsum(split) - 1)
            inside = split[at]
            r, at = r[inside], at[inside]
            right = bins[r, feature[at]] > cut[at]
            kept.append((r, first[at] + right))
            children = 2 * part[split]
            following.append(np.column_stack([children, children + 1]).ravel())
            below += 2 * int(split.sum())
        rows, local = (np.concatenate(x) for x in zip(*kept))
        order = np.argsort(local, kind="stable")
        rows, local, nodes, depth = rows[order], local[order], np.concatenate(following), depth + 1
    return {name: np.concatenate(parts) for name, parts in done.items()}


class _Top:
    """The upper part of one tree: splits found so far and the nodes below them."""

    def __init__(self, cell: bool):
        self.node, self.feature, self.cut, self.left, self.state = [1], [-1], [0], [0], ["cell" if cell else "open"]

    def add(self, node: int, state: str) -> None:
        for column, value in zip((self.node, self.feature, self.cut, self.left, self.state), (node, -1, 0, 0, state)):
            column.append(value)

    def arrays(self, state: str):
        wanted = [i for i, s in enumerate(self.state) if s == state]
        slot = np.full(len(self.node), -1)
        slot[wanted] = np.arange(len(wanted))
        return tuple(np.array(c) for c in (self.feature, self.cut, self.left)), slot, np.array([self.node[i] for i in wanted], dtype=np.int64)


def _route(bins: np.ndarray, arrays) -> np.ndarray:
    feature, cut, left = arrays
    at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while True:
        f = feature[at]
        moving = f >= 0
        if not moving.any():
            return at
        at = np.where(moving, left[at] + (bins[rows, f] > cut[at]), at)


def _thresholds(values: np.ndarray, splits: int) -> np.ndarray:
    """Cut points of one feature: between all values, or about equally filled bins."""
    distinct, counts = np.unique(values, return_counts=True)
    middle = (distinct[:-1] + distinct[1:]) / 2
    if len(middle) <= splits:
        return middle
    stride, out, seen = len(values) / (splits + 1), [], counts[0]
    target = stride
    for i in range(1, len(distinct)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def _subset(strategy: str, size: int, trees: int) -> int:
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt"
    named = {"all": size, "sqrt": math.ceil(math.sqrt(size)), "onethird": math.ceil(size / 3),
             "log2": max(1, math.ceil(math.log2(size)))}
    if strategy in named:
        return named[strategy]
    return min(size, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * size)


def _tree_nodes(pdf: pd.DataFrame, classes: int) -> pd.DataFrame:
    """One tree in Spark ML's node format: pruned where both leaves predict alike."""
    pdf = pdf.sort_values("node", ignore_index=True)
    node, feature = pdf["node"].to_numpy(), pdf["feature"].to_numpy().copy()
    counts = pdf[[f"c{i}" for i in range(classes)]].to_numpy()
    prediction, keep = counts.argmax(axis=1), np.ones(len(node), dtype=bool)
    depth = np.frexp(node.astype(np.float64))[1]
    for d in range(int(depth.max()), 0, -1):
        inner = np.flatnonzero((depth == d) & (feature >= 0))
        left = np.searchsorted(node, 2 * node[inner])
        alike = (feature[left] < 0) & (feature[left + 1] < 0) & (prediction[left] == prediction[left + 1])
        feature[inner[alike]] = -1
        keep[left[alike]] = keep[left[alike] + 1] = False
    place = np.cumsum(keep) - 1
    inner = feature >= 0
    left = np.full(len(node), -1)
    left[inner] = np.searchsorted(node, 2 * node[inner])
    child = np.where(inner, place[left], -1)
    out = pd.DataFrame({
        "tree": pdf["tree"], "id": place, "prediction": prediction.astype(np.float64), "impurity": _gini(counts),
        "raw": counts.sum(axis=1).astype(np.int64), "gain": np.where(inner, pdf["gain"], -1.0), "left": child,
        "right": np.where(inner, child + 1, -1), "feature": feature, "bin": pdf["bin"],
        **{f"c{i}": counts[:, i] for i in range(classes)},
    })
    return out[keep]


def grow_nodes(rows: DataFrame, n: int, edges: list, classes: int, trees: int, seed: int, rate: float, plan: dict) -> DataFrame:
    """``tree, node, feature, bin, gain, c0 ..`` of all trees, unpruned, as a staged table.

    ``rows`` holds ``_row, _x, _y``. The upper parts of the trees, and no more, are on the driver.
    """
    spark = rows.sparkSession
    kind = np.uint8 if plan["width"] <= 256 else np.uint16
    keys = _mix(_mix(np.arange(trees)) ^ _mix(np.array([seed])))
    cdf = np.cumsum([math.exp(-rate) * rate**i / math.factorial(i) for i in range(40)])[:-1]
    limit = min(max(n // CELLS, CELL_ROWS), MAX_CELL_ROWS)
    size, names = len(edges), [f"c{i}" for i in range(classes)]
    tops = [_Top(n * rate <= limit) for _ in range(trees)]
    schema = "tree int, node long, feature int, bin int, gain double, " + ", ".join(f"{c} double" for c in names)

    def read(batch: pd.DataFrame):
        x = np.stack(batch["_x"].to_numpy())
        bins = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
        return batch["_row"].to_numpy(), bins.astype(kind), batch["_y"].to_numpy(dtype=np.int64)

    finished = []
    while any("open" in t.state for t in tops):
        layout = {t: top.arrays("open") for t, top in enumerate(tops) if "open" in top.state}

        def count(batches, layout=layout):
            chosen = {t: _chosen(keys[t], nodes, size, plan["subset"]) for t, (_, _, nodes) in layout.items()}
            sums: dict = {}
            for batch in batches:
                if not len(batch):
                    continue
                row, bins, y = read(batch)
                for t, (arrays, slot, nodes) in layout.items():
                    w = _bag(row, keys[t], cdf)
                    local = slot[_route(bins, arrays)]
                    i = np.flatnonzero((local >= 0) & (w > 0))
                    found = _histogram(bins[i], y[i], w[i], local[i], chosen[t], len(nodes), plan["width"], classes)
                    sums[t] = sums[t] + found if t in sums else found
            for t, found in sums.items():
                yield pd.DataFrame({"tree": t, "node": layout[t][2], "hist": [h.tobytes() for h in found]})

        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            t, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
            hist = sum(np.frombuffer(h) for h in pdf["hist"]).reshape(1, plan["subset"], plan["width"], classes)
            slot, cut, gain, total = best_splits(hist, plan["least"], plan["min_gain"])
            feature = _chosen(keys[t], np.array([node]), size, plan["subset"])[0, slot[0]]
            left = hist[0, slot[0], : cut[0] + 1].sum(axis=0)
            kept = gain[0] > 0 and node.bit_length() <= plan["depth"]
            out = {"tree": t, "node": node, "feature": feature if kept else -1, "bin": cut[0], "gain": gain[0] if kept else 0.0}
            return pd.DataFrame([{**out, **dict(zip(names, total[0])), **{f"l{c}": v for c, v in zip(names, left)}}])

        found = (
            rows.mapInPandas(count, "tree int, node long, hist binary").groupBy("tree", "node")
            .applyInPandas(split, schema + "".join(f", l{c} double" for c in names)).collect()
        )
        for r in found:
            top = tops[r["tree"]]
            i = top.node.index(r["node"])
            top.state[i] = "done"
            finished.append((r["tree"], r["node"], r["feature"], r["bin"], r["gain"], *[r[c] for c in names]))
            if r["feature"] < 0:
                continue
            top.feature[i], top.cut[i], top.left[i] = r["feature"], r["bin"], len(top.node)
            left = np.array([r[f"l{c}"] for c in names])
            for side, counts in enumerate((left, np.array([r[c] for c in names]) - left)):
                node = 2 * r["node"] + side
                if node.bit_length() > plan["depth"] or _gini(counts) < 2.3e-16:
                    top.add(node, "done")
                    finished.append((r["tree"], node, -1, 0, 0.0, *counts.tolist()))
                else:
                    top.add(node, "cell" if counts.sum() <= limit else "open")

    layout = {t: top.arrays("cell") for t, top in enumerate(tops) if "cell" in top.state}

    def deal(batches):
        for batch in batches:
            if not len(batch):
                continue
            row, bins, y = read(batch)
            packed = np.column_stack([bins, y.astype(kind)])
            out = []
            for t, (arrays, slot, nodes) in layout.items():
                w = _bag(row, keys[t], cdf)
                local = slot[_route(bins, arrays)]
                i = np.flatnonzero((local >= 0) & (w > 0))
                i = i[np.argsort(local[i], kind="stable")]
                full = np.column_stack([packed[i], w[i].astype(kind)])
                ends = np.searchsorted(local[i], np.arange(len(nodes) + 1))
                out += [(t, nodes[c], full[a:b].tobytes()) for c, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
            yield pd.DataFrame(out, columns=["tree", "node", "rows"])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        x = np.frombuffer(b"".join(pdf["rows"]), dtype=kind).reshape(-1, size + 2)
        got = grow_cell(x[:, :size], x[:, size].astype(np.int64), x[:, size + 1], node, keys[t], plan)
        counts = got.pop("counts")
        return pd.DataFrame({"tree": t, **got, **{c: counts[:, i] for i, c in enumerate(names)}})

    cells = rows.mapInPandas(deal, "tree int, node long, rows binary").groupBy("tree", "node").applyInPandas(grow, schema)
    if finished:
        finished = [(int(t), int(v), int(f), int(b), float(g), *map(float, c)) for t, v, f, b, g, *c in finished]
        cells = cells.unionByName(spark.createDataFrame(finished, schema))
    return stage(cells, "forest-nodes")


class CellForestClassifier(RandomForestClassifier):
    """Spark ML's forest, grown by cells. Gini, bags drawn with replacement, rows of equal
    weight and numeric features; other settings are left to Spark ML."""

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        spark, get = dataset.sparkSession, self.getOrDefault
        nominal = {"nominal", "binary"} & set(
            dataset.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
        )
        other = nominal or self.isSet(self.weightCol) or not get("bootstrap") or get("minWeightFractionPerNode") > 0
        if other or get("impurity") != "gini" or self.isSet(self.thresholds):
            return super()._fit(dataset)
        trees, rate, seed = self.getNumTrees(), get("subsamplingRate"), get("seed")
        slim = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("_x"), F.col(self.getLabelCol()).cast("double").alias("_label")
        )
        slim = stage(slim, "forest-raw")
        label = F.col("_label")
        good = F.coalesce((label >= 0) & (label == F.floor(label)) & (label < 100), F.lit(False))
        n, top, bad = slim.agg(F.count("*"), F.max("_label"), F.sum((~good).cast("int"))).first()
        if not n or bad:
            raise ValueError("labels of a forest must be whole numbers from 0 to 99, and there must be rows")
        classes = max(2, int(top) + 1)
        cores = spark.sparkContext.defaultParallelism
        parts = max(1, math.ceil(n / 1_000_000), min(math.ceil(n * trees / 400_000), 2 * cores))
        spread = slim.repartition(parts).select("_x", label.cast("int").alias("_y"))
        # Sorted, as exchanged rows come in any order, and written once: a row's number, and
        # with it its draws, stays.
        spread = spread.sortWithinPartitions("_x", "_y")
        rows = stage(spread.withColumn("_row", F.monotonically_increasing_id()), "forest-rows")
        draw = F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        sample = rows.filter(draw < min(1.0, 1.2 * BIN_ROWS / n)) if n > BIN_ROWS else rows
        x = np.array([r[0] for r in sample.select("_x").collect()])
        bins = min(get("maxBins"), n)
        edges = [_thresholds(x[:, j], bins - 1) for j in range(x.shape[1])]
        plan = {
            "subset": _subset(get("featureSubsetStrategy"), len(edges), trees), "width": 1 + max(len(e) for e in edges),
            "classes": classes, "least": get("minInstancesPerNode"), "min_gain": get("minInfoGain"),
            "depth": get("maxDepth"),
        }
        nodes = grow_nodes(rows, n, edges, classes, trees, seed, rate, plan)
        return self._copyValues(self._model(nodes, edges, classes, trees))

    def _model(self, nodes: DataFrame, edges: list, classes: int, trees: int) -> RandomForestClassificationModel:
        """Spark ML's model, by way of its stored form."""
        spark, path = nodes.sparkSession, fresh_path(nodes.sparkSession, "forest-model")
        names = [f"c{i}" for i in range(classes)]
        flat = nodes.groupBy("tree").applyInPandas(
            lambda pdf: _tree_nodes(pdf, classes),
            "tree int, id int, prediction double, impurity double, raw long, gain double, left int, right int, "
            "feature int, bin int, " + ", ".join(f"{c} double" for c in names),
        )
        cuts = F.lit(None).cast("array<double>")
        for j, e in enumerate(edges):
            cuts = F.when(F.col("feature") == j, F.array(*[F.lit(float(v)) for v in e]).cast("array<double>")).otherwise(cuts)
        inner = F.col("feature") >= 0
        split = F.struct(
            F.col("feature").alias("featureIndex"),
            F.when(inner, F.array(F.get(cuts, F.col("bin")))).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
            F.lit(-1).alias("numCategories"),
        )
        data = F.struct(
            "id", "prediction", "impurity", F.array(*names).alias("impurityStats"), F.col("raw").alias("rawCount"),
            "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"),
        )
        flat.select(F.col("tree").alias("treeID"), data.alias("nodeData")).write.parquet(f"{path}/data")

        own = {p.name: self.getOrDefault(p) for p in self.params if self.isSet(p)}
        default = {p.name: self.getOrDefault(p) for p in self.params if self.hasDefault(p) and not self.isSet(p)}

        def record(kind: str, uid: str, **more) -> str:
            return json.dumps({
                "class": kind, "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
                "paramMap": {}, "defaultParamMap": {}, **more,
            })

        size = len(edges)
        one = [(t, record(_TREE, f"{self.uid}_tree{t}", numFeatures=size, numClasses=classes), 1.0) for t in range(trees)]
        spark.createDataFrame(one, "treeID int, metadata string, weights double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        whole = record(_MODEL, self.uid, numFeatures=size, numClasses=classes, numTrees=trees, paramMap=own, defaultParamMap=default)
        spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
        return RandomForestClassificationModel.load(path)
