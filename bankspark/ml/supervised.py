"""Supervised models on MLlib: logistic regression with inference, trees, forests, boosting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankspark import fixed_values as V
from bankspark.functions.numbers import dummies
from bankspark.ml.boosting import Boosting, fit_boosted
from bankspark.ml.profile_likelihood import Profile, design, profile
from bankspark.operators.sampling import fold_of, rank_by_hash

LOAN_NUMERIC = ["loan_amount", "interest_rate", "term_months", "income", "age", "score"]
RISK_DUMMIES = [f"risk_level_{level.lower()}" for level in V.RISK_LEVELS]
LOAN_MATRIX = LOAN_NUMERIC + RISK_DUMMIES
FRAUD_FEATURES = [
    "amount", "hour", "is_weekend", "type_anomaly", "channel_anomaly", "time_anomaly", "location_anomaly",
]


def model_matrix(df: DataFrame) -> DataFrame:
    """The loan features with one 0/1 column per risk level (no intercept, so every level stays)."""
    return df.withColumns(dummies(F.col("risk_level"), V.RISK_LEVELS, "risk_level"))


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows for fitting: those with a null or NaN feature are left out."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def assemble_all(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows for scoring: all of them; ``_complete`` tells those that have every feature."""
    complete = F.lit(True)
    for f in features:
        complete = complete & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    filled = df.withColumns({f"_f{i}": F.when(complete, F.col(f).cast("double")).otherwise(0.0) for i, f in enumerate(features)} | {"_complete": complete})
    names = [f"_f{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="features").transform(filled).drop(*names)


def fit_boosting(train: DataFrame, features: Sequence[str], label: str, rounds: int = 100) -> Boosting:
    """Gradient boosted trees with logistic loss, depth 6 and step 0.3; rows with null features are kept."""
    return fit_boosted(train, features, label, rounds)


def fit_forest(
    train: DataFrame, features: Sequence[str], label: str, trees: int = 500, per_split: str = "3",
    leaf_rows: int = 5, depth: int = 5, seed: int = 123,
):
    """Random forest; at depth 5 a tree has at most 32 leaves."""
    rows = assemble(train, features).select("features", F.col(label).cast("double").alias(label)).persist()
    model = RandomForestClassifier(
        labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy=per_split,
        minInstancesPerNode=leaf_rows, seed=seed,
    ).fit(rows)
    rows.unpersist()
    return model


def fit_tree(
    train: DataFrame, features: Sequence[str], label: str, min_gain: float = 0.001, depth: int = 8, seed: int = 123
):
    """One classification tree; growth stops on small nodes, on small gains and at ``depth``."""
    rows = assemble(train, features).select("features", F.col(label).cast("double").alias(label))
    return DecisionTreeClassifier(
        labelCol=label, maxDepth=depth, minInstancesPerNode=3, minInfoGain=min_gain, seed=seed
    ).fit(rows)


def fit_forest_cross_validated(
    train: DataFrame, features: Sequence[str], label: str, key: str, folds: int = 5, seed: int = 42,
    trees: int = 20, per_split: Sequence[str] = ("2", "4"),
):
    """Random forest of ``trees`` trees chosen by cross validation over ``per_split``; folds come from a
    hash of the key."""
    rows = (
        assemble(train, features)
        .select("features", F.col(label).cast("double").alias(label), fold_of(F.col(key), folds, seed).alias("fold"))
        .persist()
    )
    forest = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=5, seed=seed)
    grid = ParamGridBuilder().addGrid(forest.featureSubsetStrategy, list(per_split)).build()
    best = (
        CrossValidator(
            estimator=forest, estimatorParamMaps=grid, numFolds=folds, foldCol="fold",
            evaluator=BinaryClassificationEvaluator(labelCol=label), parallelism=2,
        )
        .fit(rows)
        .bestModel
    )
    rows.unpersist()
    return best


def predict(model, df: DataFrame, features: Sequence[str], cut: float = 0.5) -> DataFrame:
    """Attach the probability of class 1 and the class (strictly above the cut) to every row.

    A row with a null or NaN feature keeps both as null, but for boosted trees, which have a side for it.
    """
    if isinstance(model, Boosting):
        scored = df.withColumn("predicted_prob", model.probability(df.sparkSession))
    else:
        scored = model.transform(assemble_all(df, features))
        prob = F.when(F.col("_complete"), vector_to_array("probability")[1])
        scored = scored.select(*df.columns, prob.alias("predicted_prob"))
    return scored.withColumn(
        "predicted_class", F.when(F.col("predicted_prob").isNull(), F.lit(None)).when(F.col("predicted_prob") > cut, 1).otherwise(0)
    )


def importance(model, features: Sequence[str], spark) -> DataFrame:
    """Share of the total gain per feature (one row per feature of the model)."""
    if isinstance(model, Boosting):
        shares = model.importance()
    else:
        shares = list(zip(features, map(float, model.featureImportances.toArray())))
    return spark.createDataFrame(shares, "feature STRING, gain DOUBLE").orderBy(
        F.desc("gain"), "feature"
    )


def permutation_importance(model, df: DataFrame, features: Sequence[str], label: str, key: str, seed: int = 7):
    """Loss of accuracy when one feature is taken from another row.

    Rows are put in hash order and every row borrows from the next one, so a single equality join
    on the position shuffles all features at once; no row is collected.
    """
    ranked = rank_by_hash(df.select(key, label, *features), key, seed).persist()
    donors = ranked.select(
        (F.col("_rank") % F.col("_size") + 1).alias("_rank"), F.struct(*features).alias("_donor")
    )
    paired = ranked.join(donors, "_rank")
    variants = [("", [F.col(f) for f in features])] + [
        (f, [F.col(f"_donor.{g}") if g == f else F.col(g) for g in features]) for f in features
    ]
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("feature"), *[c.cast("double").alias(g) for c, g in zip(cols, features)])
            for name, cols in variants
        ]
    )
    scored = model.transform(assemble(paired.select(F.col(label).alias("_label"), F.inline(rows)), features))
    right = (F.col("prediction") == F.col("_label")).cast("double")
    accuracy = scored.groupBy("feature").agg(F.avg(right).alias("accuracy"))
    # one row per feature from here on; the unnamed row is the untouched accuracy
    base = F.max(F.when(F.col("feature") == "", F.col("accuracy"))).over(W.partitionBy())
    return (
        accuracy.withColumn("accuracy_loss", base - F.col("accuracy"))
        .filter(F.col("feature") != "")
        .select("feature", "accuracy_loss")
    )


GLM_FEATURES = LOAN_NUMERIC + RISK_DUMMIES[1:]  # the first level is the reference


def _scales(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.stddev_samp(f).alias(f) for f in features]).first()
    return {f: (row[f] or 1.0) for f in features}


def fit_logistic(train: DataFrame, features: Sequence[str], label: str):
    """Binomial regression; columns are divided by their deviation for a stable fit.

    Returns the model and the scales.
    """
    scales = _scales(train, features)
    rows = train.select(F.col(label).cast("double").alias(label), *[(F.col(f) / scales[f]).alias(f) for f in features])
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol=label, maxIter=50, tol=1e-8
    ).fit(assemble(rows, features).persist())
    return model, scales


def predict_logistic(model, scales: dict[str, float], df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Attach the probability to every row; null where a feature is null or NaN."""
    scaled = df.withColumns({f"_x_{f}": F.col(f) / scales[f] for f in features})
    scored = model.transform(assemble_all(scaled, [f"_x_{f}" for f in features]))
    return scored.select(*df.columns, F.when(F.col("_complete"), F.col("prediction")).alias("predicted_prob"))


def coefficients(model, scales: dict[str, float], features: Sequence[str], spark) -> DataFrame:
    """Estimates on the original scale with standard errors, p-values and Wald 95 % intervals."""
    s = model.summary
    terms = [*features, "(Intercept)"]
    estimates = [*[float(c) for c in model.coefficients], float(model.intercept)]
    rows = []
    for term, est, se, p in zip(terms, estimates, s.coefficientStandardErrors, s.pValues):
        by = scales.get(term, 1.0)
        est, se = est / by, float(se) / by
        rows.append((term, est, se, est / se, float(p), est - 1.959963984540054 * se, est + 1.959963984540054 * se))
    return spark.createDataFrame(
        rows,
        "term STRING, estimate DOUBLE, std_error DOUBLE, statistic DOUBLE, p_value DOUBLE, "
        "conf_low DOUBLE, conf_high DOUBLE",
    )


def loan_profile(model, scales: dict[str, float], train: DataFrame, features: Sequence[str], label: str) -> Profile:
    """Profile-likelihood search from the fitted model, in scaled columns."""
    start = np.array([*map(float, model.coefficients), float(model.intercept)])
    return profile(design(train, scales, features, label), start)


def profile_coefficients(coefs: DataFrame, found: Profile, scales: dict[str, float], features: Sequence[str]) -> DataFrame:
    """``coefs`` with profile-likelihood in place of Wald intervals; a null bound has no finite place."""
    rows = []
    for j, term in enumerate([*features, "(Intercept)"]):
        bounds = [float(v) / scales.get(term, 1.0) for v in found.points[j, :, j]]
        rows.append((term, *[None if np.isnan(v) else v for v in bounds]))
    bounds = coefs.sparkSession.createDataFrame(rows, "term STRING, conf_low DOUBLE, conf_high DOUBLE")
    return coefs.drop("conf_low", "conf_high").join(bounds, "term")


def odds_ratios(coefs: DataFrame) -> DataFrame:
    """Odds ratio and its interval per term."""
    return coefs.select(
        "term", F.exp("estimate").alias("odds_ratio"), F.exp("conf_low").alias("or_low"),
        F.exp("conf_high").alias("or_high"),
    )


def gram_sums(df: DataFrame, columns: Sequence[str], weight=None) -> DataFrame:
    """Sums of products of every pair of columns: one row, one pass, p * (p + 1) / 2 numbers."""
    w = F.lit(1.0) if weight is None else weight
    return df.agg(
        *[
            F.sum(w * F.col(a) * F.col(b)).alias(f"{a}|{b}")
            for i, a in enumerate(columns)
            for b in list(columns)[i:]
        ]
    )


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, total) for i <= j from 1: sums of products of every pair of columns, for many columns.

    Each row is dealt into its entries, which are summed per i against all columns at once: a plan
    with p sums, not p * (p + 1) / 2.
    """
    names = list(columns)
    entries = df.select(*names, F.posexplode(F.array(*names)).alias("at", "x")).withColumn("i", F.col("at") + 1)
    sums = entries.groupBy("i").agg(*[F.sum(F.col("x") * F.col(c)).alias(c) for c in names])
    totals = [F.struct(F.lit(j).alias("j"), F.col(c).alias("total")) for j, c in enumerate(names, 1)]
    return sums.select("i", F.explode(F.array(*totals)).alias("u")).select("i", "u.*").where("i <= j")


def variance_inflation(
    model, scales: dict[str, float], train: DataFrame, features: Sequence[str], terms: dict[str, Sequence[str]]
) -> DataFrame:
    """Generalised VIF per term from the covariance of the coefficients.

    The information matrix X'WX is summed by Spark; only that p x p matrix reaches the driver.
    """
    spark = train.sparkSession
    scored = predict_logistic(model, scales, train, features)
    scored = scored.select(
        F.lit(1.0).alias("_one"), *[(F.col(f) / scales[f]).alias(f) for f in features], "predicted_prob"
    )
    cols = ["_one", *features]
    p = F.col("predicted_prob")
    sums = gram_sums(scored, cols, p * (1 - p)).first()
    info = np.zeros((len(cols), len(cols)))
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            info[i, j] = info[j, i] = sums[f"{a}|{cols[j]}"]
    cov = np.linalg.inv(info)[1:, 1:]
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    rows = []
    for term, members in terms.items():
        inside = [features.index(m) for m in members]
        others = [i for i in range(len(features)) if i not in inside]
        gvif = float(
            np.linalg.det(corr[np.ix_(inside, inside)])
            * np.linalg.det(corr[np.ix_(others, others)])
            / np.linalg.det(corr)
        )
        rows.append((term, gvif, len(inside), gvif ** (1 / (2 * len(inside)))))
    return spark.createDataFrame(rows, "term STRING, gvif DOUBLE, df INT, gvif_scaled DOUBLE")
