"""Classification metrics as Spark aggregates over (label, probability) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankspark.functions.numbers import ratio
from bankspark.operators.quantiles import running_totals


def outcome(label: Column, predicted: Column) -> Column:
    """True / False Positive, False Negative; anything else is a True Negative."""
    return (
        F.when((label == 1) & (predicted == 1), "True Positive")
        .when((label == 0) & (predicted == 1), "False Positive")
        .when((label == 1) & (predicted == 0), "False Negative")
        .otherwise("True Negative")
    )


def errors_only(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Rows that the model got wrong, with their kind of error."""
    kind = outcome(F.col(label), F.col(predicted))
    return df.withColumn("classification", kind).filter(
        F.col("classification").isin("False Positive", "False Negative")
    )


def average_ranks(df: DataFrame, score: str) -> DataFrame:
    """One row per distinct score: its rows and the tie-averaged rank of each of them."""
    counted = df.groupBy(score).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counted, score, ["n"])
    return ranked.withColumn("avg_rank", F.col("n_upto") - (F.col("n") - 1) / 2).drop("n_upto")


def _by_score(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by the rank-sum formula; a higher score means label 1.

    Rows are first grouped by score, so ties and frequent scores collapse before anything is
    ordered.
    """
    ranked = running_totals(_by_score(df, label, score, by), score, ["pos", "neg"], by)
    below = F.col("neg_upto") - F.col("neg")
    wins = F.col("pos") * (below + F.col("neg") / 2)
    area = F.try_divide(F.sum(wins), (F.sum("pos") * F.sum("neg")).cast("double"))
    return ranked.groupBy(*by).agg(F.round(area, 9).alias("auc"))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """Threshold, false and true positive rate at every distinct score (rows at or above it)."""
    ranked = running_totals(_by_score(df, label, score), score, ["pos", "neg"])
    totals = ranked.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")).first()
    p, q = F.lit(totals["p"]), F.lit(totals["q"])
    return ranked.select(
        F.col(score).alias("threshold"),
        ratio(q - F.col("neg_upto") + F.col("neg"), q).alias("fpr"),
        ratio(p - F.col("pos_upto") + F.col("pos"), p).alias("tpr"),
    )


def confusion(df: DataFrame, label: str, score: str, by: Sequence[str] = (), cut: float = 0.5) -> DataFrame:
    """Counts, accuracy, sensitivity, specificity and kappa at a strict cut.

    The positive class is 0 (the first level): sensitivity is the recall of label 0 and
    specificity the recall of label 1.
    """
    one, guess = F.col(label) == 1, F.col(score) > cut
    counts = df.groupBy(*by).agg(
        F.count_if(~one & ~guess).alias("n00"), F.count_if(one & ~guess).alias("n10"),
        F.count_if(~one & guess).alias("n01"), F.count_if(one & guess).alias("n11"),
    )
    n00, n10, n01, n11 = (F.col(c).cast("double") for c in ("n00", "n10", "n01", "n11"))
    n = n00 + n10 + n01 + n11
    agree = F.try_divide(n00 + n11, n)
    chance = F.try_divide((n00 + n01) * (n00 + n10) + (n10 + n11) * (n01 + n11), n * n)
    return counts.withColumns(
        {
            "accuracy": F.round(agree, 9),
            "sensitivity": F.round(F.try_divide(n00, n00 + n01), 9),
            "specificity": F.round(F.try_divide(n11, n10 + n11), 9),
            "kappa": F.round(F.try_divide(agree - chance, 1 - chance), 9),
        }
    )


def compare_models(df: DataFrame, model: str, label: str, score: str) -> DataFrame:
    """Accuracy, AUC, sensitivity and specificity per model, from one long (model, label, score) frame."""
    rates = confusion(df, label, score, [model]).select(model, "accuracy", "sensitivity", "specificity")
    return rates.join(auc(df, label, score, [model]), model)
