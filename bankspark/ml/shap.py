"""Additive feature contributions of boosted trees.

Every leaf is a small game: a feature is "in" when the row meets the leaf's bounds on it and
contributes the leaf's share of training rows otherwise. With at most ``depth`` features per leaf
all in/out patterns can be tabulated once on the driver; scoring a row is then a table lookup per
leaf, done batch-wise on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _leaves(nodes: pd.DataFrame) -> list[tuple[float, dict[int, list]]]:
    """Each leaf as (value, {feature: [low, high, missing values pass, share of rows]}); NaN is no bound."""
    by_id = {int(r.node): r for r in nodes.itertuples()}
    found, open_nodes = [], [(0, {})]
    while open_nodes:
        at, path = open_nodes.pop()
        r = by_id[at]
        if r.left < 0:
            found.append((float(r.value), path))
            continue
        f = int(r.feature)
        for child, is_left in ((int(r.left), True), (int(r.right), False)):
            low, high, passes, share = path.get(f, [np.nan, np.nan, True, 1.0])
            bound = [low, np.fmin(high, r.threshold)] if is_left else [np.fmax(low, r.threshold), high]
            passes = passes and bool(r.missing_left) == is_left
            open_nodes.append((child, {**path, f: [*bound, passes, share * by_id[child].cover / r.cover]}))
    return found


def _pattern_values(shares: np.ndarray) -> np.ndarray:
    """Contribution of every feature of a leaf (value 1) for every in/out pattern of its features."""
    m = len(shares)
    weight = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
    out = np.zeros((2**m, m))
    for pattern in range(2**m):
        met = [(pattern >> j) & 1 for j in range(m)]
        for f in range(m):
            poly = np.ones(1)  # coefficient k: total weight of coalitions of k other features
            for j in range(m):
                if j != f:
                    poly = np.convolve(poly, [shares[j], met[j]])
            out[pattern, f] = (met[f] - shares[f]) * sum(w * c for w, c in zip(weight, poly))
    return out


class LeafTables:
    """All leaves of an ensemble as arrays, small enough to broadcast (its size is the model's)."""

    def __init__(self, nodes: pd.DataFrame, n_features: int):
        self.trees = []
        self.base = 0.0
        cache: dict[tuple, np.ndarray] = {}
        for _, rows in nodes.groupby("tree"):
            leaves = _leaves(rows)
            depth = max(1, max(len(path) for _, path in leaves))
            feature = np.zeros((len(leaves), depth), dtype=np.int64)
            low = np.full((len(leaves), depth), np.nan)
            high = np.full((len(leaves), depth), np.nan)
            passes = np.ones((len(leaves), depth), dtype=bool)
            table = np.zeros((len(leaves), 2**depth, n_features))
            for i, (value, path) in enumerate(leaves):
                shares = np.ones(depth)  # unused places are features that never matter
                for j, (f, (lo, hi, ok, share)) in enumerate(path.items()):
                    feature[i, j], low[i, j], high[i, j], passes[i, j], shares[j] = f, lo, hi, ok, share
                key = tuple(shares)
                if key not in cache:
                    cache[key] = _pattern_values(shares)
                for j, f in enumerate(path):
                    table[i, :, f] += value * cache[key][:, j]
                self.base += value * float(np.prod(shares))
            self.trees.append((feature, low, high, passes, table))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for feature, low, high, passes, table in self.trees:
            v = x[:, feature]
            met = np.where(np.isnan(v), passes, ~(v <= low) & ~(v > high))
            pattern = met @ (1 << np.arange(feature.shape[1]))
            out += table[np.arange(len(table)), pattern].sum(axis=1)
        return out


def shap_values(model, df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Keys, one contribution per feature (log-odds) and the base value; they sum to the margin."""
    tables = LeafTables(model.nodes(), len(features))
    shared = df.sparkSession.sparkContext.broadcast(tables)  # its size is the model's
    names = list(features)

    def score(batches):
        for pdf in batches:
            parts = shared.value.contributions(pdf[names].to_numpy(dtype=float))
            out = pdf[list(keys)].copy()
            for j, name in enumerate(names):
                out[f"shap_{name}"] = parts[:, j]
            out["base_value"] = shared.value.base
            yield out

    rows = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in names])
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    schema = ", ".join([key_types, *[f"shap_{f} DOUBLE" for f in names], "base_value DOUBLE"])
    return rows.mapInPandas(score, schema)


def shap_long(values: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per key and feature."""
    return values.unpivot(list(keys), [f"shap_{f}" for f in features], "feature", "shap_value").withColumn(
        "feature", F.substr("feature", F.lit(6))
    )


def mean_absolute(long: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    return (
        long.groupBy("feature")
        .agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))
        .orderBy(F.desc("mean_abs_shap"), "feature")
    )
