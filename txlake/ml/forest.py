"""Isolation forest: a bounded sample per tree, trees grown in tasks of their own, vectorized scoring."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES = 100
SUBSAMPLE = 256
_NODE_SCHEMA = "tree int, points int, node int, feature int, threshold double, left int, right int, path double"
_STEP = 37
_EULER = 0.5772156649015329


def usual_path(n: int) -> float:
    """Mean length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + _EULER) - 2.0 * (n - 1) / n


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree: (node, feature, threshold, left, right, path); leaves have feature -1."""
    nodes: list[tuple] = []
    todo = [(0, points, 0)]
    count = 1
    while todo:
        node, part, depth = todo.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or len(varied) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + usual_path(len(part))))
            continue
        feature = int(rng.choice(varied))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= threshold
        nodes.append((node, feature, threshold, count, count + 1, 0.0))
        todo += [(count, part[goes_left], depth + 1), (count + 1, part[~goes_left], depth + 1)]
        count += 2
    return nodes


def tree_samples(scaled: DataFrame, key: str, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 42) -> DataFrame:
    """``tree`` and ``v``: the points of every tree, ``subsample`` of all rows by a hash of its own, or all if there are fewer.

    A row is dealt to one tree by its key's hash, and where rows are few to as many as give each tree twice its sample; with
    fewer than that, to all. Spark keeps ``subsample`` rows per tree and task before it shuffles.
    """
    count = scaled.count()
    copies = min(trees, math.ceil(2 * subsample * trees / max(count, 1)))
    # Steps without a common factor with the number of trees lead to different trees.
    step = next(n for n in range(_STEP, _STEP + trees + 1) if math.gcd(n, trees) == 1)
    first = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(trees))
    dealt = scaled.select(F.col(key).alias("key"), vector_to_array("features").alias("v"), F.explode(
        F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda n: ((first + n * step) % trees).cast("int"))).alias("tree"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed), "tree", "key"), "key", F.xxhash64("v")))
    return dealt.withColumn("place", place).where(F.col("place") <= subsample).select("tree", "v")


def fit_forest(scaled: DataFrame, key: str = "transaction_id", trees: int = TREES, subsample: int = SUBSAMPLE,
               seed: int = 42) -> DataFrame:
    """Forest as rows, at most ``trees * 2 * subsample`` of them; every tree grows from its own sample, in a task of its own."""
    def grow(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        points = np.array(sorted(sample["v"].map(tuple)), dtype="float64")
        nodes = _grow(points, np.random.default_rng([seed, tree]), math.ceil(math.log2(max(2, len(points)))))
        frame = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "path"])
        frame.insert(0, "points", len(points))
        frame.insert(0, "tree", tree)
        return frame

    return tree_samples(scaled, key, trees, subsample, seed).groupBy("tree").applyInPandas(grow, _NODE_SCHEMA)


def _walkable(tree: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Arrays of one tree by node: feature, threshold, right and left child in turn, path, and the depth.

    A leaf is its own child, so that every row takes as many steps as the tree is deep and none asks whether it is done.
    """
    feature, left, right = (tree[c].to_numpy(dtype="int64") for c in ("feature", "left", "right"))
    leaf, own = feature < 0, np.arange(len(tree))
    children = np.stack([np.where(leaf, own, right), np.where(leaf, own, left)], axis=1)
    depth, level = 0, np.zeros(1, dtype="int64")
    while not leaf[level].all():
        level, depth = np.unique(children[level]), depth + 1
    return np.maximum(feature, 0), tree["threshold"].to_numpy(dtype="float64"), children.ravel(), tree["path"].to_numpy(dtype="float64"), depth


def anomaly_score(forest: DataFrame, features: str = "features") -> Column:
    """Anomaly in (0, 1], higher is stranger. Reads the bounded forest and ships it to the tasks."""
    nodes = forest.toPandas().sort_values(["tree", "node"])
    arrays = [_walkable(part) for _, part in nodes.groupby("tree")]
    model = forest.sparkSession.sparkContext.broadcast(arrays)
    # Of one point nothing can be told apart.
    usual = usual_path(int(nodes["points"].max())) or 1.0

    @F.pandas_udf(T.DoubleType())
    def score(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype="float64")
        x = np.concatenate(vectors.to_numpy()).astype("float64", copy=False)
        first = np.arange(len(vectors), dtype="int64") * (len(x) // len(vectors))
        total = np.zeros(len(vectors))
        for feature, threshold, children, path, depth in model.value:
            at = np.zeros(len(vectors), dtype="int64")
            for _ in range(depth):
                goes_left = x.take(first + feature.take(at)) <= threshold.take(at)
                at = children.take(2 * at + goes_left)
            total += path.take(at)
        return pd.Series(np.power(2.0, -(total / len(model.value)) / usual))

    return score(vector_to_array(features))
