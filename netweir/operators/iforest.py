"""Isolation Forest: trees are built from small samples, one group a tree; scoring walks all trees at once in Arrow batches."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import ordered
from .features import FeatureState, transform
from .features import fit as fit_features
from .quantiles import quantiles
from .sampling import split, uniform
from .thresholds import calibrated

NODE = "tree int, node int, feature int, cut double, left int, right int, size int, depth int"


def average_path(n):
    """Mean depth of an unsuccessful search in a binary tree of n rows: 2 H(n-1) - 2 (n-1) / n."""
    n = np.asarray(n, float)
    big = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big))


def grown(tree: int, x: np.ndarray, seed: int) -> list[tuple]:
    """Nodes of one tree over a sample: a random feature and a random cut between its ends, down to log2 of the rows."""
    rng = np.random.default_rng([seed, tree])
    most = int(np.ceil(np.log2(max(2, len(x)))))
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0)]
    nodes.append([tree, 0, -1, 0.0, -1, -1, len(x), 0])
    at = 0
    while at < len(todo):
        rows, depth = todo[at]
        lo, hi = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
        free = np.flatnonzero(hi > lo)
        if depth < most and len(rows) > 1 and len(free):
            f = int(rng.choice(free))
            cut = float(rng.uniform(lo[f], hi[f]))
            small = x[rows, f] < cut
            nodes[at][2:6] = [f, cut, len(nodes), len(nodes) + 1]
            for part in (rows[small], rows[~small]):
                nodes.append([tree, len(nodes), -1, 0.0, -1, -1, len(part), depth + 1])
                todo.append((part, depth + 1))
        at += 1
    return [tuple(n) for n in nodes]


@dataclass
class IsolationForestModel:
    """Nodes of all trees, bounded by trees and sample size, and the offset of the decision."""

    features: list[str]
    nodes: np.ndarray
    samples: int
    offset: float = -0.5

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row over all trees."""
        total, trees = np.zeros(len(x)), np.unique(self.nodes["tree"])
        for t in trees:
            n = self.nodes[self.nodes["tree"] == t]
            at = np.zeros(len(x), int)
            while (inner := n["feature"][at] >= 0).any():
                k = at[inner]
                at[inner] = np.where(x[np.flatnonzero(inner), n["feature"][k]] < n["cut"][k], n["left"][k], n["right"][k])
            total += n["depth"][at] + average_path(n["size"][at])
        return total / max(1, len(trees))

    def transform(self, df: DataFrame, to: str = "decision") -> DataFrame:
        """df with score - offset: negative for anomalies."""
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def decide(*cols: pd.Series) -> pd.Series:
            m = model.value
            x = np.column_stack([c.to_numpy(float) for c in cols])
            return pd.Series(-np.power(2.0, -m.paths(x) / average_path(m.samples)) - m.offset)

        return df.withColumn(to, decide(*(F.col(c) for c in self.features)))

    def dump(self) -> str:
        return json.dumps({"features": self.features, "nodes": self.nodes.tolist(), "samples": self.samples, "offset": self.offset})

    @classmethod
    def load(cls, text: str) -> IsolationForestModel:
        d = json.loads(text)
        kind = np.dtype([(x.split(" ")[0], "f8" if x.endswith("double") else "i8") for x in NODE.split(", ")])
        return cls(d["features"], np.array([tuple(x) for x in d["nodes"]], kind).view(np.recarray), d["samples"], d["offset"])


def fit(df: DataFrame, features: list[str], key: list[str], trees: int = 300, samples: int = 256, contamination: float | None = None, seed: int = 42) -> IsolationForestModel:
    """Fit on rows of df: one pool of trees * samples rows by md5 order is dealt out to the trees.

    Features must be numbers without nulls.  With a contamination the offset is that quantile of the training scores,
    else -0.5.
    """
    n = df.count()
    size = min(samples, n)
    if size < 2:
        raise ValueError("an Isolation Forest needs two rows at least")
    order = ordered(seed, *map(F.col, key)).alias("_o")
    if n >= trees * size:
        top = uniform(df, trees * size, key, seed).select(*features, order)
        dealt = top.withColumn("tree", (F.row_number().over(Window.orderBy("_o")) - 1) % trees)  # trees * samples rows
    else:  # each tree draws its own rows by the order of another hash; features meet the drawn rows only
        pool = df.select(*features, order).withColumn("_d", F.row_number().over(Window.partitionBy("_o").orderBy("_o")))
        each = pool.select("_o", "_d").crossJoin(F.broadcast(df.sparkSession.range(trees).select(F.col("id").cast("int").alias("tree"))))
        each = each.withColumn("_p", F.row_number().over(Window.partitionBy("tree").orderBy(F.md5(F.concat("tree", F.lit(":"), "_o").cast("binary")))))
        dealt = each.filter(F.col("_p") <= size).join(pool, ["_o", "_d"])

    def build(g: pd.DataFrame) -> pd.DataFrame:
        t = int(g["tree"].iloc[0])
        return pd.DataFrame(grown(t, g.sort_values("_o")[features].to_numpy(float), seed), columns=[c.split(" ")[0] for c in NODE.split(", ")])

    nodes = dealt.select("tree", "_o", *features).groupBy("tree").applyInPandas(build, NODE).orderBy("tree", "node").toPandas()  # bounded by trees and samples
    model = IsolationForestModel(list(features), nodes.to_records(index=False), size)
    if contamination is not None:
        raw = model.transform(df.select(*features), "_d")
        model.offset += quantiles(raw, "_d", [contamination])[0]
    return model


@dataclass
class Detector:
    """A trained detector: how features are prepared, the forest, and its calibration."""

    state: FeatureState
    forest: IsolationForestModel
    calibration: dict

    def score(self, df: DataFrame) -> DataFrame:
        """df with the decision of each row; its features are prepared on the side."""
        x = [f"_x_{f}" for f in self.forest.features]
        named = dict(zip(self.forest.features, x))
        side = transform(df.select("*", *(F.col(f).alias(n) for f, n in named.items())), renamed(self.state, named), "robust")
        model = IsolationForestModel(x, self.forest.nodes, self.forest.samples, self.forest.offset)
        return model.transform(side).drop(*x)

    def save(self, spark, path: str) -> None:
        text = json.dumps({"state": self.state.dump(), "forest": self.forest.dump(), "calibration": self.calibration})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark, path: str) -> Detector:
        d = json.loads(spark.read.text(path).first()[0])
        return cls(FeatureState.load(d["state"]), IsolationForestModel.load(d["forest"]), d["calibration"])


def renamed(state: FeatureState, names: dict[str, str]) -> FeatureState:
    to = lambda d: {names.get(k, k): v for k, v in d.items()}
    return FeatureState([names.get(c, c) for c in state.numeric], [], to(state.medians), to(state.bounds), to(state.scales), to(state.knots), {})


def train(df: DataFrame, label: str, features: list[str], key: list[str], test: float = 0.2, target_fp: float = 0.05, references: DataFrame | None = None, least: int = 20, **given) -> Detector:
    """Split, fit the forest on benign rows of the training part, and calibrate its threshold on the held-out rows.

    ``references`` are more labelled attacks for the calibration.  Raises for fewer than ``least`` benign rows, in all or in the
    training part.
    """
    from ..functions.expressions import is_benign

    d = df.withColumn("_y", F.when(is_benign(F.col(label)), 0).otherwise(1))
    if (n := d.filter("_y = 0").count()) < least:
        raise ValueError(f"too little normal traffic: {n} benign rows, {least} are needed")
    d = split(d.select(*dict.fromkeys([*key, *features]), "_y"), "_y", test, key).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        benign = d.filter("not is_test and _y = 0")
        if (n := benign.count()) < least:
            raise ValueError(f"too little normal traffic after the split: {n} benign rows, {least} are needed")
        state = fit_features(benign, features, [], approx=True)  # sketches: all columns in two passes
        forest = fit(transform(benign, state, "robust"), features, key, **given)
        made = Detector(state, forest, {})
        held = d.filter("is_test").select(*features, "_y")
        if references is not None:
            held = held.unionByName(references.select(*features, F.when(is_benign(F.col(label)), 0).otherwise(1).alias("_y")))
        scored = made.score(held).select(F.col("_y").alias("label"), F.col("decision").alias("score")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            made.calibration = calibrated(scored, target_fp)
        finally:
            scored.unpersist()
    finally:
        d.unpersist()
    return made


