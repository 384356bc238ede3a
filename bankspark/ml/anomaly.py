"""Unsupervised anomaly scores: isolation forest and a small autoencoder."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankspark.operators.columns import standardise
from bankspark.session import cut_lineage

# --- isolation forest ----------------------------------------------------------------------------


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def tree_samples(df: DataFrame, key: str, features: Sequence[str], trees: int, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` distinct rows for each tree, drawn by hashes of the key.

    The table is passed once; what leaves the filter is about 1.3 * trees * rows rows, whatever the
    size of the table.
    """
    n = df.count()
    per_row = min(float(trees) * 4, 1.3 * trees * rows / max(n, 1))  # trees a row should go to
    copies = max(1, math.ceil(per_row))

    def uniform(*salt):
        return F.pmod(F.xxhash64(key, *[F.lit(s) for s in salt[:1]], *salt[1:]), F.lit(1 << 30)) / float(1 << 30)

    drawn = (
        df.select(key, *[F.col(f).cast("double").alias(f) for f in features])
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        .filter(uniform(seed, F.col("_copy")) < per_row / copies)
        .withColumn("tree", F.pmod(F.xxhash64(key, "_copy", F.lit(seed + 1)), F.lit(trees)).cast("int"))
        .dropDuplicates(["tree", key])
    )
    order = W.partitionBy("tree").orderBy(F.xxhash64(key, "tree"), key)
    return drawn.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= rows).drop("_r", "_copy")


_NODES = "tree INT, node INT, feature INT, split DOUBLE, left INT, right INT, depth DOUBLE, sample INT"


def _grow(features: Sequence[str], seed: int):
    """A grouped function that grows one isolation tree from its (bounded) sample."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(list(features))[list(features)].to_numpy(dtype=float)
        rng = np.random.default_rng(seed * 100003 + tree)
        limit = math.ceil(math.log2(max(len(x), 2)))
        rows, waiting = [], [(0, np.arange(len(x)), 0)]
        used = 1
        while waiting:
            node, idx, depth = waiting.pop()
            part = x[idx]
            low, high = part.min(axis=0), part.max(axis=0)
            open_features = np.flatnonzero(high > low)
            if depth >= limit or len(idx) <= 1 or len(open_features) == 0:
                rows.append((tree, node, -1, 0.0, -1, -1, depth + average_path(len(idx)), len(x)))
                continue
            f = int(rng.choice(open_features))
            split = float(rng.uniform(low[f], high[f]))
            goes_left = part[:, f] <= split
            left, right, used = used, used + 1, used + 2
            rows.append((tree, node, f, split, left, right, float(depth), len(x)))
            waiting += [(left, idx[goes_left], depth + 1), (right, idx[~goes_left], depth + 1)]
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "split", "left", "right", "depth", "sample"])

    return grow


def fit_isolation_forest(
    df: DataFrame, key: str, features: Sequence[str], trees: int = 100, rows: int = 256, seed: int = 42
) -> DataFrame:
    """The forest as rows of nodes (at most 2 * rows per tree); write them to Parquet to keep it."""
    samples = tree_samples(df, key, features, trees, rows, seed)
    return samples.groupBy("tree").applyInPandas(_grow(features, seed), _NODES)


def isolation_scores(
    forest: DataFrame, df: DataFrame, features: Sequence[str], name: str = "iso_anomaly_score"
) -> DataFrame:
    """Attach the anomaly score 2^(-mean of depth / expected depth) to every row.

    The expected depth is that of a tree's own sample, which is smaller than asked for where the table is.
    """
    spark = df.sparkSession
    nodes = forest.toPandas()  # bounded by trees * 2 * rows
    packed = []
    for _, t in nodes.sort_values("node").groupby("tree"):
        packed.append(
            tuple(
                t[c].to_numpy(dtype=kind)
                for c, kind in [("feature", int), ("split", float), ("left", int), ("right", int)]
            )
            + (t["depth"].to_numpy(dtype=float) / max(average_path(int(t["sample"].iloc[0])), 1e-9),)
        )
    shared = spark.sparkContext.broadcast(packed)
    names = list(features)

    def score(batches):
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            depth_sum = np.zeros(len(x))
            every = np.arange(len(x))
            for feature, split, left, right, depth in shared.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    goes_left = x[every, np.maximum(f, 0)] <= split[at]
                    at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
                depth_sum += depth[at]
            yield pdf.assign(**{name: np.power(2.0, -depth_sum / len(shared.value))})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{name} DOUBLE"])
    return df.mapInPandas(score, schema)


# --- autoencoder ---------------------------------------------------------------------------------

_WIDTHS = (10, 2, 10)


def _shapes(n: int) -> list[tuple[int, int]]:
    sizes = [n, *_WIDTHS, n]
    return list(zip(sizes, sizes[1:]))


def _unpack(flat: np.ndarray, n: int):
    out, at = [], 0
    for a, b in _shapes(n):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _start(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in _shapes(n):
        parts += [rng.normal(0, math.sqrt(1 / a), a * b), np.zeros(b)]
    return np.concatenate(parts)


def _gradient(flat: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """The gradient of the mean loss, and the sum of the rows' losses."""
    layers = _unpack(flat, x.shape[1])
    acts = [x]
    for i, (w, bias) in enumerate(layers):
        z = acts[-1] @ w + bias
        acts.append(z if i == len(layers) - 1 else np.tanh(z))
    off = acts[-1] - x
    loss = float((off**2).mean(axis=1).sum())
    delta = 2 * off / x.size
    grads = []
    for i in range(len(layers) - 1, -1, -1):
        grads.append((acts[i].T @ delta, delta.sum(axis=0)))
        if i:
            delta = (delta @ layers[i][0].T) * (1 - acts[i] ** 2)
    return np.concatenate([part for w, b in reversed(grads) for part in (w.ravel(), b)]), loss


_BLOCK = 16_384  # rows that a gradient takes at a time


def _in_blocks(rows: DataFrame) -> DataFrame:
    """The rows of numbers as records ``x`` of many rows each, one row after the other."""

    def pack(batches):
        held, many = [], 0

        def block():
            flat = np.concatenate(held).ravel()
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(flat)], pa.array(flat))], names=["x"])

        for batch in batches:
            if batch.num_rows:
                held.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
                many += batch.num_rows
            if many >= _BLOCK:
                yield block()
                held, many = [], 0
        if held:
            yield block()

    return rows.mapInArrow(pack, "x array<double>")


def fit_autoencoder(
    scaled: DataFrame, features: Sequence[str], steps: int = 60, rate: float = 0.05, seed: int = 42, settled: float = 1e-5
) -> np.ndarray:
    """Train the n-10-2-10-n tanh network and return its flat weights.

    Each step sums the gradient over all rows and moves once (Adam), so the weights do not depend on
    how rows are dealt to partitions. Training ends after ``steps`` or when the loss has
    settled. What moves is one small array per partition; the rows are read from a written copy, in blocks.
    Rows with a null are left out.
    """
    names, n = list(features), len(features)
    rows = cut_lineage(_in_blocks(scaled.select(*[F.col(f).cast("double").alias(f) for f in names]).dropna("any")))
    weights = _start(n, seed)
    spark = scaled.sparkSession
    m, v, last = np.zeros_like(weights), np.zeros_like(weights), math.inf

    def one_step(shared):
        def run(batches):
            total, loss, seen = np.zeros(len(shared.value)), 0.0, 0
            for batch in batches:
                for block in batch.column(0):
                    x = block.values.to_numpy(zero_copy_only=False).reshape(-1, n)
                    gradient, lost = _gradient(shared.value, x)
                    total += gradient * len(x)
                    loss += lost
                    seen += len(x)
            if seen:
                place = pa.array(np.arange(len(total) + 2, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([place, pa.array(np.concatenate([total, [loss, seen]]))], names=["place", "total"])

        return run

    for step in range(1, steps + 1):
        shared = spark.sparkContext.broadcast(weights)
        sums = rows.mapInArrow(one_step(shared), "place INT, total DOUBLE").groupBy("place").agg(F.sum("total").alias("t"))
        got = np.array([r["t"] for r in sorted(sums.collect(), key=lambda r: r["place"])])  # one number per weight
        shared.unpersist()
        if not len(got):
            break
        gradient, loss = got[:-2] / got[-1], got[-2] / got[-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient * gradient
        weights = weights - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if abs(last - loss) < settled * max(loss, 1e-12):
            break
        last = loss
    return weights


def reconstruction_error(
    weights: np.ndarray, scaled: DataFrame, features: Sequence[str], name: str = "ae_reconstruction_error"
) -> DataFrame:
    """Attach the mean squared reconstruction error of every row, a batch at a time."""
    names = list(features)
    shared = scaled.sparkSession.sparkContext.broadcast(weights)  # 125 numbers

    def score(batches):
        layers = _unpack(shared.value, len(names))
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            out = x
            for w, bias in layers[:-1]:
                out = np.tanh(out @ w + bias)
            out = out @ layers[-1][0] + layers[-1][1]
            yield pdf.assign(**{name: ((out - x) ** 2).mean(axis=1)})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in scaled.schema] + [f"{name} DOUBLE"])
    return scaled.mapInPandas(score, schema)


def scaled_fraud_features(tx: DataFrame) -> DataFrame:
    """Log amount, hour and weekend flag, centred and scaled, beside the transaction id."""
    raw = tx.select(
        "transaction_id", F.log1p("amount").alias("amount"), F.col("hour").cast("double").alias("hour"),
        F.col("is_weekend").cast("double").alias("is_weekend"),
    )
    return standardise(raw, ["amount", "hour", "is_weekend"])
