"""Boosted trees and exact attributions that follow the trees' own paths."""

from __future__ import annotations

import uuid
from functools import lru_cache
from math import factorial

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import shared_dir


def fit_surrogate(df: DataFrame, features: str = "features", label: str = "label", trees: int = 20, depth: int = 4, rate: float = 0.1, least: int = 5, seed: int = 42) -> GBTClassificationModel:
    """features: an array of doubles."""
    data = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=least, seed=seed).fit(data)


class Ensemble:
    """Trees as arrays: feature (-1 at a leaf), threshold, left, right, value, cover; and a weight for each tree."""

    def __init__(self, trees: list[dict[str, np.ndarray]], weights: list[float]):
        self.trees, self.weights = trees, weights

    @staticmethod
    def of(model: GBTClassificationModel, spark) -> Ensemble:
        """Read back from the model's own files: their size follows from the number and depth of the trees."""
        path = f"{shared_dir(spark)}/flowprep/model-{uuid.uuid4().hex}"
        model.write().overwrite().save(path)
        rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        trees = []
        for t in sorted({r["treeID"] for r in rows}):
            nodes = sorted((r for r in rows if r["treeID"] == t), key=lambda r: r["id"])
            split = [r["split"] for r in nodes]
            leaf = [r["leftChild"] < 0 for r in nodes]
            trees.append({"feature": np.array([-1 if end else s["featureIndex"] for s, end in zip(split, leaf, strict=True)]), "threshold": np.array([0.0 if end else s["leftCategoriesOrThreshold"][0] for s, end in zip(split, leaf, strict=True)]), "left": np.array([r["leftChild"] for r in nodes]), "right": np.array([r["rightChild"] for r in nodes]), "value": np.array([r["prediction"] for r in nodes]), "cover": np.array([float(r["rawCount"]) for r in nodes])})
        return Ensemble(trees, list(model.treeWeights))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t, w in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), int)
            while (go := t["feature"][at] >= 0).any():
                below = x[np.arange(len(x)), np.maximum(t["feature"][at], 0)] <= t["threshold"][at]
                at = np.where(go, np.where(below, t["left"][at], t["right"][at]), at)
            out += w * t["value"][at]
        return out

    def expected(self) -> float:
        return sum(w * float((t["value"] * t["cover"])[t["feature"] < 0].sum() / t["cover"][0]) for t, w in zip(self.trees, self.weights, strict=True))

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """Shapley values of the margin, by row and feature: they and expected() add up to margin().

        Each leaf is a product game over the features on its path: a feature that is known lets the row pass or not,
        one that isn't lets the share of the cover pass. A leaf's game has few players, so it is solved in closed form.
        """
        out = np.zeros(x.shape)
        for t, w in zip(self.trees, self.weights, strict=True):
            todo: list[tuple[int, dict[int, tuple[np.ndarray, float]]]] = [(0, {})]
            while todo:
                k, path = todo.pop()
                f = int(t["feature"][k])
                if f < 0:
                    _leaf(out, w * t["value"][k], path)
                    continue
                goes = x[:, f] <= t["threshold"][k]
                for child, passes in ((int(t["left"][k]), goes), (int(t["right"][k]), ~goes)):
                    seen, share = path.get(f, (np.ones(len(x)), 1.0))
                    todo.append((child, path | {f: (seen * passes, share * t["cover"][child] / t["cover"][k])}))
        return out


@lru_cache(64)
def coalition_weights(n: int) -> np.ndarray:
    return np.array([factorial(k) * factorial(n - k - 1) / factorial(n) for k in range(n)])


def _leaf(out: np.ndarray, value: float, path: dict[int, tuple[np.ndarray, float]]) -> None:
    n = len(path)
    for f, (passes, share) in path.items():
        ways = np.zeros((n, len(out)))  # by size of the coalition of the others: what it lets pass
        ways[0] = 1
        for g, (p, s) in path.items():
            if g != f:
                grown = ways * s
                grown[1:] += ways[:-1] * p
                ways = grown
        out[:, f] += value * (passes - share) * (coalition_weights(n) @ ways)
