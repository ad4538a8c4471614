"""Isolation forest: one task builds a tree from its own sample, scoring runs over Arrow batches.

Published algorithm: samples of psi rows, a uniform feature among those that vary and a uniform cut between its
extremes, height at most ceil(log2 psi); score = -2^(-E[path]/c(psi)), raw = score - offset. The offset is -0.5, or with
a contamination the score below which that share of the pool lies.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import stored

TREES, SAMPLE, SEED = 300, 4096, 42
EULER = 0.5772156649015329
NODES = "tree int, node int, feature int, cut double, left int, right int, size int"


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2 * (np.log(n - 1) + EULER) - 2 * (n - 1) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def build(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """(node, feature, cut, left, right, size) of a tree; leaves have feature -1."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    out: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(out)
        out.append([at, -1, 0.0, -1, -1, len(rows)])
        if parent >= 0:
            out[parent][3 + side] = at
        if depth >= limit or len(rows) < 2:
            continue
        low, high = x[rows].min(0), x[rows].max(0)
        varies = np.flatnonzero(high > low)
        if not len(varies):
            continue
        f = int(rng.choice(varies))
        cut = float(rng.uniform(low[f], high[f]))
        below = x[rows, f] <= cut
        out[at][1:3] = [f, cut]
        todo += [(rows[~below], depth + 1, at, 1), (rows[below], depth + 1, at, 0)]
    return [tuple(r) for r in out]


def scaler(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations; a feature that doesn't vary is left at its scale."""
    row = rows.agg(*(F.avg(n).alias(f"m{i}") for i, n in enumerate(names)), *(F.stddev_pop(n).alias(f"s{i}") for i, n in enumerate(names))).first()
    # nine decimals: sums of doubles depend on their order
    mean = np.array([round(row[f"m{i}"] or 0.0, 9) for i in range(len(names))])
    return mean, np.array([round(row[f"s{i}"] or 0.0, 9) or 1.0 for i in range(len(names))])


def share(seed: int, *columns: str | Column) -> Column:
    """A number from 0 to 1 by a hash."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def fit(rows: DataFrame, names: list[str], id_column: str = "ordinal", trees: int = TREES, sample: int = SAMPLE, seed: int = SEED, pool: int = 80_000, contamination: float | None = None) -> dict:
    """The forest of about `pool` rows (those of the least hashes of the id): bit-stable for the same rows.

    Each tree's sample is the `sample` rows of the pool that have the least hashes of id and tree. A row is dealt to the
    trees that can need it (hashes under a share that leaves room for chance), and a tree is built where its rows
    meet: no row goes to the driver, and a group has little more than `sample` rows."""
    mean, scale = scaler(rows, names)
    n = rows.count()
    some = rows.where(share(seed, id_column) < pool / max(n, 1)) if n > pool else rows
    some = stored(some.select(F.col(id_column).alias("__id"), *names), "forest-pool")
    m = some.count()
    size = min(sample, m)
    enough = (size + 8 * math.sqrt(size) + 16) / max(m, 1)
    dealt = some.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("at", share(seed, "__id", "tree"))

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["at", *names])[names].to_numpy(float)[:size]
        nodes = build((x - mean) / scale, np.random.default_rng([seed, int(key[0])]))
        return pd.DataFrame([(int(key[0]), *v) for v in nodes], columns=["tree", "node", "feature", "cut", "left", "right", "size"])

    nodes = dealt.where(F.col("at") < enough).groupBy("tree").applyInPandas(make, NODES).toPandas()  # bounded by trees and sample
    model = {"nodes": nodes.sort_values(["tree", "node"], ignore_index=True), "mean": mean, "scale": scale, "size": size, "names": names, "offset": -0.5}
    if contamination is not None and size:
        scored = with_raw_score(some, {**model, "offset": 0.0})
        model["offset"] = float(scored.agg(F.percentile("raw_score", float(contamination))).first()[0])  # of the pool
    return model


class Walker:
    """All trees as flat arrays. A leaf is its own child, so that every row takes the same number of steps."""

    def __init__(self, nodes: pd.DataFrame):
        self.trees = []
        for _, t in nodes.groupby("tree"):
            at = np.arange(len(t))
            leaf = t["feature"].to_numpy() < 0
            child = np.stack([np.where(leaf, at, t["right"]), np.where(leaf, at, t["left"])], 1).ravel().astype(np.int64)
            depth = np.zeros(len(t))
            for k in np.flatnonzero(~leaf):  # parents stand before their children
                depth[[t["left"].iat[k], t["right"].iat[k]]] = depth[k] + 1
            length = depth + expected_path(t["size"].to_numpy())
            self.trees.append((np.where(leaf, 0, t["feature"]).astype(np.int64), t["cut"].to_numpy(float), child, length, int(depth.max())))

    def mean_path(self, x: np.ndarray) -> np.ndarray:
        flat, base = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        total = np.zeros(len(x))
        for feature, cut, child, length, depth in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = child[2 * at + (flat[base + feature[at]] <= cut[at])]
            total += length[at]
        return total / max(len(self.trees), 1)


def samples(x: np.ndarray, walker: Walker, size: int) -> np.ndarray:
    """Minus the anomaly score of the published algorithm: -2^(-E[path]/c(size))."""
    return -(2.0 ** (-walker.mean_path(x) / max(float(expected_path(size)), 1e-9)))


def with_raw_score(rows: DataFrame, model: dict, to: str = "raw_score") -> DataFrame:
    """Adds the decision score: lower is more anomalous."""
    shared = rows.sparkSession.sparkContext.broadcast((Walker(model["nodes"]), model["mean"], model["scale"], model["size"], model["offset"]))

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        walker, mean, scale, size, offset = shared.value
        x = (np.stack([c.to_numpy(float) for c in columns], 1) - mean) / scale
        return pd.Series(samples(x, walker, size) - offset if len(x) else [])

    return rows.withColumn(to, score(*model["names"]))
