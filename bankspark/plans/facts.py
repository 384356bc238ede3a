"""Facts that model results must satisfy, each with an exact SQL twin.

The models themselves have none; what can be stated in SQL is which rows they must score and that
their parts agree with each other.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from bankspark.ml import anomaly as A
from bankspark.ml import clusters as K
from bankspark.ml import metrics as M
from bankspark.ml import supervised as S
from bankspark.operators import fraud as D
from bankspark.plans import clusters as PC
from bankspark.plans import models as PM
from bankspark.plans.registry import query
from bankspark.session import cut_lineage, fresh_path

_NONE_OFF = "SELECT CAST(0 AS BIGINT) AS rows_off"


def _rows_off(df, wrong):
    """How many rows break the rule; unknown counts as broken."""
    return df.agg(F.count_if(F.coalesce(wrong, F.lit(True))).alias("rows_off"))


@query("ml2_scores_every_row", "transactions_ev", "SELECT transaction_id, TRUE AS scored FROM transactions_ev")
def _(b):
    scored = A.isolation_scores(PM.fraud_forest(b), PM._iso_rows(b).select("transaction_id", *PM._ISO), PM._ISO)
    return scored.select("transaction_id", F.col("iso_anomaly_score").between(0, 1).alias("scored"))


@query("ml4_scores_every_row", "transactions_ev", "SELECT transaction_id, TRUE AS scored FROM transactions_ev")
def _(b):
    names = ["amount", "hour", "is_weekend"]
    scaled = A.scaled_fraud_features(D.time_features(b.transactions_ev))
    errors = A.reconstruction_error(PM.fraud_autoencoder(b), scaled, names)
    return errors.select("transaction_id", (F.col("ae_reconstruction_error") >= 0).alias("scored"))


@query("io9_saved_model_scores_the_same", "transactions_ev", _NONE_OFF)
def _(b):
    rows = PM._iso_rows(b).select("transaction_id", *PM._ISO)
    kept = A.isolation_scores(cut_lineage(PM.fraud_forest(b)), rows, PM._ISO, "again")
    both = A.isolation_scores(PM.fraud_forest(b), rows, PM._ISO).join(kept.select("transaction_id", "again"), "transaction_id", "full")
    return _rows_off(both, F.abs(F.col("iso_anomaly_score") - F.col("again")) > 1e-12)


@query(
    "ml18_scores_every_applicant",
    "customers credit_scores",
    "SELECT DISTINCT customer_id, TRUE AS scored FROM customers JOIN credit_scores USING (customer_id)",
)
def _(b):
    scored = PM.new_applicants(b)
    agrees = F.col("predicted_prob").between(0, 1) & (F.col("predicted_class") == (F.col("predicted_prob") > 0.5).cast("int"))
    return scored.select("customer_id", agrees.alias("scored"))


@query("ml17_contributions_add_up", "loans", _NONE_OFF)
def _(b):
    parts = PM._shap(b)
    total = reduce(lambda x, y: x + y, [F.col(f"shap_{f}") for f in S.LOAN_MATRIX]) + F.col("base_value")
    scored = PM._boosted(b).select("loan_id", "score_id", "predicted_prob")
    both = parts.select("loan_id", "score_id", (1 / (1 + F.exp(-total))).alias("p")).join(scored, ["loan_id", "score_id"], "full")
    return _rows_off(both, F.abs(F.col("p") - F.col("predicted_prob")) > 1e-6)


@query("sc25_odds_are_exponentials", "loans", _NONE_OFF)
def _(b):
    model, scales = PM.loan_logistic(b)
    estimates = S.coefficients(model, scales, S.GLM_FEATURES, b.spark)
    both = S.odds_ratios(estimates).select("term", "odds_ratio").join(estimates.select("term", "estimate"), "term", "full")
    return _rows_off(both, F.abs(F.col("odds_ratio") / F.exp("estimate") - 1) > 1e-9)


@query("sc25_deviance_at_the_bounds", "loans", _NONE_OFF)
def _(b):
    found = PM.loan_intervals(b)
    train, scales = PM.loan_split(b)[0], PM.loan_logistic(b)[1]
    names = [*S.GLM_FEATURES, "(Intercept)"]
    there = [(j, k) for j in range(len(names)) for k in (0, 1) if not np.isnan(found.points[j, k]).any()]
    points = [found.best, *[found.points[j, k] for j, k in there]]
    deviance = []
    for point in points:  # column expressions: nothing of the search's own sums
        eta = reduce(lambda x, y: x + y, [F.col(f) / scales[f] * float(c) for f, c in zip(S.GLM_FEATURES, point, strict=False)]) + float(point[-1])
        deviance.append(F.sum(-2 * (F.col("default") * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta))))))
    row = train.dropna(subset=[*S.GLM_FEATURES, "default"]).agg(F.array(*deviance).alias("d"))
    return row.select(F.explode(F.transform("d", lambda v, i: F.struct(i.alias("i"), (v - F.get("d", F.lit(0))).alias("more")))).alias("r")).agg(
        F.count_if((F.col("r.i") > 0) & (F.abs(F.col("r.more") - 3.841458820694124) > 1e-4)).alias("rows_off")
    )


@query("ml15_confusion_of_written_predictions", "loans", _NONE_OFF)
def _(b):
    written = cut_lineage(PM._boosted(b).select("default", "predicted_prob", "predicted_class"))
    cells = {"n11": (1, 1), "n01": (0, 1), "n10": (1, 0), "n00": (0, 0)}  # label, predicted class
    counted = written.agg(*[
        F.count_if((F.col("default") == y) & (F.col("predicted_class") == p)).alias(f"own_{name}") for name, (y, p) in cells.items()
    ])
    table = M.confusion(written, "default", "predicted_prob").crossJoin(counted)  # one row each
    return _rows_off(table, reduce(lambda x, y: x | y, [F.col(name) != F.col(f"own_{name}") for name in cells]))


@query("ml9_score_equations", "loans", _NONE_OFF)
def _(b):
    model, scales = PM.loan_logistic(b)
    train = PM.loan_split(b)[0].dropna(subset=[*S.GLM_FEATURES, "default"])
    scored = S.predict_logistic(model, scales, train, S.GLM_FEATURES)
    # at the maximum the residuals are orthogonal to every column, also to the intercept's
    terms = [F.lit(1.0), *[F.col(f) / scales[f] for f in S.GLM_FEATURES]]
    off = scored.agg(F.array(*[F.abs(F.sum((F.col("default") - F.col("predicted_prob")) * t)) / F.sum(F.abs(t)) for t in terms]).alias("off"))
    return _rows_off(off.select(F.explode("off").alias("v")), F.col("v") > 1e-6)


@query("ml11_probabilities_are_leaf_shares", "loans", _NONE_OFF)
def _(b):
    # a leaf gives the share of defaults among its training rows; equal shares fall together
    scored = S.predict(PM.loan_tree(b), PM.loan_split(b)[0], S.LOAN_MATRIX).dropna(subset=["predicted_prob"])
    leaves = scored.groupBy("predicted_prob").agg(F.avg("default").alias("share"))
    return _rows_off(leaves, F.abs(F.col("share") - F.col("predicted_prob")) > 1e-9)


@query("ml16_gains_are_reductions_of_loss", "loans", _NONE_OFF)
def _(b):
    model = PM.loan_boosting(b)
    path = fresh_path(b.spark, "boosting")
    model.save(b.spark, path)
    nodes = b.spark.read.parquet(path)
    worth = (F.col("value") / 0.3) ** 2 * (F.col("cover") + 1)  # G * G / (H + 1) of a node
    own = nodes.select("tree", "node", "cover", worth.alias("worth"))
    inner = nodes.filter("feature >= 0").select("tree", "node", "left", "right", "gain", F.col("cover").alias("whole"), worth.alias("before"))
    for side in ("left", "right"):
        child = own.select("tree", F.col("node").alias(side), F.col("worth").alias(f"{side}_worth"), F.col("cover").alias(f"{side}_cover"))
        inner = inner.join(child, ["tree", side], "left")
    gained = F.col("left_worth") + F.col("right_worth") - F.col("before")
    wrong = (F.abs(gained - F.col("gain")) > 1e-6) | (F.abs(F.col("left_cover") + F.col("right_cover") - F.col("whole")) > 1e-6)
    return _rows_off(inner, wrong)


@query(
    "ml19_scores_every_customer", "customers campaign_responses",
    "SELECT customer_id, COUNT(*) FILTER (responded) > 0 AS responded, TRUE AS scored FROM customers LEFT JOIN campaign_responses USING (customer_id) GROUP BY 1",
)
def _(b):
    agrees = F.col("predicted_prob").between(0, 1) & (F.col("predicted_class") == (F.col("predicted_prob") > 0.5).cast("int"))
    written = cut_lineage(PM.campaign_predictions(b))
    return written.select("customer_id", (F.col("responded") == 1).alias("responded"), agrees.alias("scored"))


@query("ml23_labels_are_the_nearest_centres", "vectors", "SELECT vec_id, TRUE AS nearest FROM vectors")
def _(b):
    rows, names = PC._scaled(b)
    model = PC._kmeans(b)
    centres = sorted(tuple(map(float, c)) for c in model.clusterCenters())
    vector = F.array(*names)
    distance = [F.aggregate(F.zip_with(vector, F.array(*map(F.lit, c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, d: t + d) for c in centres]
    labels = K.kmeans_labels(model, rows, names).withColumn("_d", F.array(*distance))
    own = F.element_at("_d", F.col("kmeans_cluster"))
    return labels.select("vec_id", (own <= F.array_min("_d") + 1e-9).alias("nearest"))


@query("ml24_components_keep_the_variance", "vectors", "SELECT vec_id, TRUE AS scored FROM vectors")
def _(b):
    rows, names = PC._scaled(b)
    scores = K.principal_components(rows, "vec_id", names, len(names))
    parts = [f"pc{i + 1}" for i in range(len(names))]
    both = scores.join(rows, "vec_id")
    square = lambda cs: reduce(lambda x, y: x + y, [F.col(c) * F.col(c) for c in cs])
    # all components together are a rotation: they keep the length of every row
    return both.select("vec_id", (F.abs(square(parts) - square(names)) < 1e-6 * (1 + square(names))).alias("scored"))


@query("ml25_labels_every_row", "vectors", "SELECT vec_id, TRUE AS labelled FROM vectors")
def _(b):
    return PC.ward_vectors(b)[1].select("vec_id", F.col("hc_cluster").between(1, 4).alias("labelled"))


@query("ml25_cost_of_the_labels", "vectors", "SELECT CAST(4 AS BIGINT) AS clusters, TRUE AS cost_is_the_models, TRUE AS leaves_cost_less")
def _(b):
    model, labels, pcs = PC.ward_vectors(b)
    # sum of squares around the cluster means, from the written labels
    sums = labels.groupBy("hc_cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in pcs], *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in pcs]
    )
    cost = sums.agg(F.count(F.lit(1)).alias("clusters"), F.sum(reduce(lambda x, y: x + y, [F.col(f"q_{c}") - F.col(f"s_{c}") * F.col(f"s_{c}") / F.col("n") for c in pcs])).alias("cost"))
    return cost.select(
        "clusters", (F.abs(F.col("cost") - model.cost) < 1e-6 * (1 + model.cost)).alias("cost_is_the_models"), (F.col("cost") >= model.within).alias("leaves_cost_less")
    )
