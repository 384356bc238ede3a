"""Profile-likelihood intervals of a logistic regression.

The bound of a term is where the log-likelihood, maximised over all other terms, has fallen by half
of the chi-square quantile. Both bounds of all terms are searched side by side: each step sums, in one
pass over the rows, the log-likelihood, its gradient and its weighted least squares matrix at the current
point of every search, and solves the quadratic model there for the next points.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HALF_CHI_SQUARE = 3.841458820694124 / 2  # of one degree of freedom, at 95 %


@dataclass(frozen=True)
class Profile:
    """``best``: the maximum (features, then intercept); ``top``: its log-likelihood; ``points``: per term
    and side the point of the bound, NaN where the search found none (separated classes)."""

    best: np.ndarray
    top: float
    points: np.ndarray


def likelihood_sums(rows: DataFrame, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and information X'WX of the rows (x array, y) at every point, in one pass."""
    count, p = points.shape
    sent = rows.sparkSession.sparkContext.broadcast(points)  # at most two points per term
    size = 1 + p + p * p

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, size))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for k, point in enumerate(sent.value):
                eta = x @ point
                mu = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                total[k, 0] += (y * eta - np.logaddexp(0, eta)).sum()
                total[k, 1 : 1 + p] += x.T @ (y - mu)
                total[k, 1 + p :] += (x.T @ (x * (mu * (1 - mu))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count * size)), pa.array(total.ravel())], names=["at", "v"])

    found = np.zeros(count * size)
    for r in rows.mapInArrow(sums, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # one number per sum
        found[r["at"]] = r["v"]
    found = found.reshape(count, size)
    return found[:, 0], found[:, 1 : 1 + p], found[:, 1 + p :].reshape(count, p, p)


def design(df: DataFrame, scales: dict[str, float], features: Sequence[str], label: str) -> DataFrame:
    """(x, y): scaled features and a one for the intercept; incomplete rows are left out."""
    x = F.array(*[(F.col(f) / scales[f]).cast("double") for f in features], F.lit(1.0))
    rows = df.select(x.alias("x"), F.col(label).cast("double").alias("y"))
    return rows.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)) & F.col("y").isNotNull())


def profile(rows: DataFrame, start: np.ndarray, steps: int = 40) -> Profile:
    """Maximum and bounds of all terms, from a ``start`` near the maximum. ``rows``: see ``design``."""
    rows = rows.persist()
    try:
        best = np.asarray(start, float).copy()
        for _ in range(steps):
            top, gradient, information = (v[0] for v in likelihood_sums(rows, best[None]))
            move = np.linalg.pinv(information) @ gradient
            if np.abs(move * gradient).sum() < 1e-14 * (1 + abs(top)):
                break
            best = best + move
        p = len(best)
        spread = np.sqrt(np.maximum(np.diag(np.linalg.pinv(information)), 0))
        term = np.repeat(np.arange(p), 2)
        side = np.tile([-1.0, 1.0], p)
        goal = top - HALF_CHI_SQUARE
        points = np.array([_along(best, np.zeros(p), information, j, s * 1.96 * spread[j]) for j, s in zip(term, side, strict=True)])
        done = np.zeros(2 * p, bool)
        for _ in range(steps):
            live = np.flatnonzero(~done)
            if not len(live):
                break
            value, gradient, information = likelihood_sums(rows, points[live])
            for k, v, g, h in zip(live, value, gradient, information, strict=True):
                j = term[k]
                others = np.arange(p) != j
                inverse = np.linalg.pinv(h[np.ix_(others, others)])
                off = g[others] @ inverse @ g[others]  # twice what the others could still gain
                if abs(v - goal) < 1e-9 * (1 + abs(goal)) and off < 1e-10:
                    done[k] = True
                    continue
                # along the others' maximum: v + off / 2 + slope * step - curve * step^2 / 2 = goal
                slope = g[j] - h[j, others] @ inverse @ g[others]
                curve = h[j, j] - h[j, others] @ inverse @ h[others, j]
                root = slope * slope + 2 * curve * (v + off / 2 - goal)
                step = (slope + side[k] * np.sqrt(root)) / curve if root >= 0 and curve > 0 else side[k] * spread[j] / -2
                points[k] = _along(points[k], g, h, j, float(np.clip(step, -2 * spread[j], 2 * spread[j])))
        points[~done] = np.nan
        return Profile(best, float(top), points.reshape(p, 2, p))
    finally:
        rows.unpersist()


def _along(point: np.ndarray, gradient: np.ndarray, information: np.ndarray, j: int, step: float) -> np.ndarray:
    """Term ``j`` moved by ``step`` and the others to their maximum of the quadratic model."""
    others = np.arange(len(point)) != j
    moved = point.copy()
    moved[j] += step
    moved[others] += np.linalg.pinv(information[np.ix_(others, others)]) @ (gradient[others] - information[others, j] * step)
    return moved
