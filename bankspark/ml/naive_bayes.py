"""Naive Bayes over numeric (normal) and categorical columns together.

Training is one grouped pass per kind of column; the parameters are tiny tables. Scoring is
expressions and lookups of those tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankspark.operators.joins import lookup_join

_FLOOR = 0.001  # stands for a probability of zero


@dataclass
class NaiveBayes:
    label: str
    numeric: dict[str, dict[int, tuple[float, float]]]  # column -> class -> (mean, deviation)
    priors: dict[int, float]
    levels: dict[str, DataFrame]  # column -> (column, log-likelihood ratio)

    @staticmethod
    def fit(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str]) -> NaiveBayes:
        stats = df.groupBy(label).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(c).alias(f"{c}_m") for c in numeric],
            *[F.stddev_samp(c).alias(f"{c}_s") for c in numeric],
        ).collect()  # one row per class
        by_class = {int(r[label]): r for r in stats}
        total = sum(r["n"] for r in stats)
        moments = {c: {k: (r[f"{c}_m"], r[f"{c}_s"]) for k, r in by_class.items()} for c in numeric}
        size = {k: r["n"] for k, r in by_class.items()}
        levels = {}
        for c in categorical:
            counts = df.groupBy(c).agg(
                F.count_if(F.col(label) == 0).alias("_n0"), F.count_if(F.col(label) == 1).alias("_n1")
            )
            p0, p1 = (
                F.when(F.col(f"_n{k}") > 0, F.col(f"_n{k}").cast("double") / size[k]).otherwise(_FLOOR)
                for k in (0, 1)
            )
            levels[c] = counts.select(c, (F.log(p1) - F.log(p0)).alias(f"_ll_{c}"))
        return NaiveBayes(label, moments, {k: n / total for k, n in size.items()}, levels)

    def _normal(self, c: str, k: int) -> Column:
        mean, sd = self.numeric[c][k]
        z = (F.col(c) - F.lit(mean)) / F.lit(sd)
        return -z * z / 2 - F.lit(math.log(sd * math.sqrt(2 * math.pi)))

    def predict(self, df: DataFrame) -> DataFrame:
        """Attach the probability of class 1."""
        ratio = F.lit(math.log(self.priors[1]) - math.log(self.priors[0]))
        for c in self.numeric:
            ratio = ratio + (self._normal(c, 1) - self._normal(c, 0))
        out = df
        for c, table in self.levels.items():
            out = lookup_join(out, table, c)
            ratio = ratio + F.coalesce(F.col(f"_ll_{c}"), F.lit(0.0))  # a new level says nothing
        prob = 1 / (1 + F.exp(-ratio))
        return out.withColumn("predicted_prob", prob).select(*df.columns, "predicted_prob")
