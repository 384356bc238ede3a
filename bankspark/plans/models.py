"""Model queries: loan default, fraud and campaign models.

Models are fitted once per application and data folder and shared by the queries that use them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bankspark import fixed_values as V
from bankspark.functions import numbers as N
from bankspark.ml import anomaly as A
from bankspark.ml import metrics as M
from bankspark.ml import shap as H
from bankspark.ml import supervised as S
from bankspark.ml.naive_bayes import NaiveBayes
from bankspark.operators import campaign as C
from bankspark.operators import columns as L
from bankspark.operators import fraud as D
from bankspark.operators.customers import loan_default_data
from bankspark.operators.sampling import fold_of, split_flag
from bankspark.plans.registry import query
from bankspark.sources.tables import VECTOR_SIZE
from bankspark.operators.quantiles import exact_quantiles
from bankspark.plans.campaign import INCOME_BRACKET_SQL, INCOME_EDGES_SQL
from bankspark.plans.scalars import split_sql
from bankspark.session import cut_lineage, fewer_tasks, spread

_FITTED: dict[tuple, object] = {}


def folder_state(b) -> tuple:
    """Name, size and time of every file of the folder."""
    jvm, conf = b.spark.sparkContext._jvm, b.spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(b.folder)
    files = path.getFileSystem(conf).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def once(b, name, make):
    """The result of ``make()`` for this application and the folder's files as they are now."""
    key = (b.spark.sparkContext.applicationId, b.folder, folder_state(b), name)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def forget() -> None:
    """Drop all fitted models; the next query fits its own."""
    _FITTED.clear()


# --- loan default --------------------------------------------------------------------------------


def loan_split(b):
    def make():
        data = loan_default_data(b.loans, b.customers, b.credit_scores)
        data = S.model_matrix(data).withColumn("row_id", F.xxhash64("loan_id", "score_id"))
        rows = split_flag(data, "row_id", 0.8, 123).persist()
        rows = fewer_tasks(rows, rows.count())
        return rows.filter("is_train").drop("is_train"), rows.filter("NOT is_train").drop("is_train")

    return once(b, "loan split", make)


def loan_boosting(b):
    return once(b, "loan boosting", lambda: S.fit_boosting(loan_split(b)[0], S.LOAN_MATRIX, "default"))


def loan_logistic(b):
    return once(b, "loan logistic", lambda: S.fit_logistic(loan_split(b)[0], S.GLM_FEATURES, "default"))


def loan_forest(b):
    return once(b, "loan forest", lambda: S.fit_forest(loan_split(b)[0], S.LOAN_MATRIX, "default"))


def loan_tree(b):
    return once(b, "loan tree", lambda: S.fit_tree(loan_split(b)[0], S.LOAN_MATRIX, "default"))


def loan_intervals(b):
    """The profile-likelihood search of the loan regression."""
    model, scales = loan_logistic(b)
    return once(b, "loan intervals", lambda: S.loan_profile(model, scales, loan_split(b)[0], S.GLM_FEATURES, "default"))


def _loan_coefficients(b):
    model, scales = loan_logistic(b)
    estimates = S.coefficients(model, scales, S.GLM_FEATURES, b.spark)
    return S.profile_coefficients(estimates, loan_intervals(b), scales, S.GLM_FEATURES)


@query("ml9_logistic_regression_with_inference")
def _(b):
    return _loan_coefficients(b)


@query("sc25_odds_ratio")
def _(b):
    return S.odds_ratios(_loan_coefficients(b))


@query("ml10_vif")
def _(b):
    model, scales = loan_logistic(b)
    terms = {f: [f] for f in S.LOAN_NUMERIC} | {"risk_level": S.RISK_DUMMIES[1:]}
    return S.variance_inflation(model, scales, loan_split(b)[0], S.GLM_FEATURES, terms)


_GRAM = [f"v{i}" for i in range(1, VECTOR_SIZE + 1)]
_GRAM_PAIRS = [(a, c) for i, a in enumerate(_GRAM) for c in _GRAM[i : i + 2]]  # every entry, and its neighbour


@query(
    "ml10_gram_sums",
    "vectors",
    "SELECT " + ", ".join(f"round(SUM({a} * {c}), 6) AS {a}_{c}" for a, c in _GRAM_PAIRS) + " FROM vectors",
)
def _(b):
    sums = S.gram_sums(b.vectors, _GRAM)
    return sums.select(*[F.round(F.col(f"{a}|{c}"), 6).alias(f"{a}_{c}") for a, c in _GRAM_PAIRS])


_ALL_PAIRS = [(i, j) for i in range(1, VECTOR_SIZE + 1) for j in range(i, VECTOR_SIZE + 1)]


@query(
    "ml10_gram_matrix",
    "vectors",
    "SELECT u.i, u.j, u.total FROM (SELECT unnest(["
    + ", ".join(f"{{'i': {i}, 'j': {j}, 'total': round(SUM(v{i} * v{j}), 6)}}" for i, j in _ALL_PAIRS)
    + "]) AS u FROM vectors)",
)
def _(b):
    return S.gram_matrix(b.vectors, _GRAM).withColumn("total", F.round("total", 6))


@query("ml11_decision_tree")
def _(b):
    return S.predict(loan_tree(b), loan_split(b)[1], S.LOAN_MATRIX).select(
        "loan_id", "score_id", "default", "predicted_prob", "predicted_class"
    )


@query("ml12_random_forest_importance")
def _(b):
    model, (_, test) = loan_forest(b), loan_split(b)
    gains = S.importance(model, S.LOAN_MATRIX, b.spark)
    losses = S.permutation_importance(model, test, S.LOAN_MATRIX, "default", "row_id")
    return losses.join(gains, "feature").orderBy(F.desc("accuracy_loss"), "feature")


def _boosted(b):
    return S.predict(loan_boosting(b), loan_split(b)[1], S.LOAN_MATRIX)


@query("ml15_gradient_boosting")
def _(b):
    return M.confusion(_boosted(b), "default", "predicted_prob")


@query("ml16_boosting_importance")
def _(b):
    return S.importance(loan_boosting(b), S.LOAN_MATRIX, b.spark).limit(10)


def _shap(b):
    return H.shap_values(loan_boosting(b), loan_split(b)[1], S.LOAN_MATRIX, ["loan_id", "score_id"])


@query("ml17_shap_values")
def _(b):
    return _shap(b)


@query("ml17_shap_long")
def _(b):
    return H.shap_long(_shap(b), S.LOAN_MATRIX, ["loan_id", "score_id"])


@query("ml17_shap_mean_absolute")
def _(b):
    return H.mean_absolute(H.shap_long(_shap(b), S.LOAN_MATRIX, ["loan_id", "score_id"]))


def new_applicants(b):
    # applicants: every customer asks for the same loan, with their own income, age and score
    applicants = b.customers.select("customer_id", "income", "age").join(
        b.credit_scores.groupBy("customer_id").agg(
            F.max_by("score", F.struct("date_recorded", "score_id")).alias("score"),
            F.max_by("risk_level", F.struct("date_recorded", "score_id")).alias("risk_level"),
        ),
        "customer_id",
    ).withColumns({"loan_amount": F.lit(500000.0), "interest_rate": F.lit(8.0), "term_months": F.lit(36)})
    rows = L.align_features(S.model_matrix(applicants), S.LOAN_MATRIX, keep=["customer_id"])
    return S.predict(loan_boosting(b), rows, S.LOAN_MATRIX).select(
        "customer_id", "predicted_prob", "predicted_class"
    )


@query("ml18_score_new_applicant")
def _(b):
    return new_applicants(b)


@query("ml19_prediction_table")
def _(b):
    return _boosted(b).select(
        "loan_id", "default", *S.LOAN_NUMERIC, "risk_level", "predicted_prob", "predicted_class"
    )


@query("jb12_loan_default_models")
def _(b):
    _, test = loan_split(b)
    model, scales = loan_logistic(b)
    scored = {
        "Logistic Regression": S.predict_logistic(model, scales, test, S.GLM_FEATURES),
        "Decision Tree": S.predict(loan_tree(b), test, S.LOAN_MATRIX),
        "Random Forest": S.predict(loan_forest(b), test, S.LOAN_MATRIX),
        "Gradient Boosting": _boosted(b),
    }
    return _compare(scored, "default")


def _compare(scored, label):
    long = None
    for name, df in scored.items():
        part = df.select(F.lit(name).alias("model"), F.col(label).alias("label"), "predicted_prob")
        long = part if long is None else long.unionByName(part)
    # rates and AUC both read the scores; the models run over the rows once
    return M.compare_models(cut_lineage(long), "model", "label", "predicted_prob")


# --- campaign response ---------------------------------------------------------------------------

_NUMERIC = ["age", "income"]
_CATEGORICAL = ["gender", "marital_status", "education_level", "occupation", "region"]


def campaign_rows(b):
    """Responses with customer attributes; incomplete rows are dropped. Split 70/30 per answer."""
    rows = b.campaign_responses.select("response_id", "customer_id", F.col("responded").cast("int").alias("label"))
    rows = rows.join(b.customers.select("customer_id", *_NUMERIC, *_CATEGORICAL), "customer_id", "left").dropna("any")
    return split_flag(rows.drop("customer_id"), "response_id", 0.7, 123, ["label"], round_up=True)


def kept_campaign_rows(b):
    """The rows of ``campaign_rows``, kept. The split joins them by answer, which leaves them in two partitions."""

    def make():
        total = b.campaign_responses.count()
        rows = spread(campaign_rows(b), total, "response_id").persist()
        return fewer_tasks(rows, total)

    return once(b, "campaign rows", make)


def _level_sql(c):
    return f"""ll_{c} AS (SELECT {c}, ln(CASE WHEN n1 > 0 THEN n1 / t1 ELSE 0.001 END)
  - ln(CASE WHEN n0 > 0 THEN n0 / t0 ELSE 0.001 END) AS v FROM (SELECT {c}, CAST(COUNT(*) FILTER (label = 1) AS DOUBLE) AS n1,
  CAST(COUNT(*) FILTER (label = 0) AS DOUBLE) AS n0 FROM train GROUP BY {c}), tot)"""


def _normal_sql(c):
    return " - ".join(
        f"(-power(({c} - {c}_m{k}) / {c}_s{k}, 2) / 2 - ln({c}_s{k} * sqrt(2 * pi())))" for k in (1, 0)
    )


_MOMENTS = ", ".join(
    f"AVG({c}) FILTER (label = {k}) AS {c}_m{k}, stddev_samp({c}) FILTER (label = {k}) AS {c}_s{k}"
    for c in _NUMERIC
    for k in (0, 1)
)
_BAYES = f"""WITH data AS (SELECT response_id, CAST(responded AS INTEGER) AS label, {", ".join(_NUMERIC + _CATEGORICAL)}
  FROM campaign_responses JOIN customers USING (customer_id)),
split AS ({split_sql('data', 'response_id', 'label', 123, 0.7, 'ceil')}),
train AS (SELECT * FROM split WHERE is_train),
tot AS (SELECT CAST(COUNT(*) FILTER (label = 1) AS DOUBLE) AS t1, CAST(COUNT(*) FILTER (label = 0) AS DOUBLE) AS t0,
  {_MOMENTS} FROM train),
{", ".join(_level_sql(c) for c in _CATEGORICAL)}
SELECT response_id, label, round(1 / (1 + exp(-(ln(t1) - ln(t0) + {" + ".join(_normal_sql(c) for c in _NUMERIC)}
  + {" + ".join(f"COALESCE(ll_{c}.v, 0)" for c in _CATEGORICAL)}))), 6) AS predicted_prob
FROM split {" ".join(f"LEFT JOIN ll_{c} USING ({c})" for c in _CATEGORICAL)}, tot WHERE NOT is_train"""


def _bayes(b):
    rows = kept_campaign_rows(b)
    model = NaiveBayes.fit(rows.filter("is_train"), "label", _NUMERIC, _CATEGORICAL)
    return model.predict(rows.filter("NOT is_train"))


@query("ml20_naive_bayes", "campaign_responses customers", _BAYES)
def _(b):
    return _bayes(b).select("response_id", "label", F.round("predicted_prob", 6).alias("predicted_prob"))


@query(
    "ag31_conversion_of_predictions",
    "campaign_responses customers",
    f"""SELECT {INCOME_BRACKET_SQL} AS income_bracket, round(AVG(predicted_prob), 5) AS conversion_rate
FROM ({_BAYES}) JOIN campaign_responses USING (response_id) JOIN customers USING (customer_id), {INCOME_EDGES_SQL}
GROUP BY 1""",
)
def _(b):
    edges = exact_quantiles(b.customers, "income", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    bracket = N.bin_right_closed(F.col("income"), edges, V.INCOME_BRACKETS, include_lowest=True)
    scored = C.mean_by_bracket(_bayes(b), bracket, "predicted_prob", "conversion_rate")
    return scored.select("income_bracket", F.round("conversion_rate", 5).alias("conversion_rate"))


@query(
    "ml22_errors_of_predictions",
    "campaign_responses customers",
    f"""SELECT response_id, label, CASE WHEN label = 0 THEN 'False Positive' ELSE 'False Negative' END AS classification
FROM ({_BAYES}) WHERE (label = 1) <> (predicted_prob > 0.5)""",
)
def _(b):
    predicted = _bayes(b).withColumn("predicted", (F.round("predicted_prob", 6) > 0.5).cast("int"))
    return M.errors_only(predicted, "label", "predicted").select("response_id", "label", "classification")


@query("ml21_campaign_model_comparison")
def _(b):
    rows, names = C.encode_customers(kept_campaign_rows(b))
    features = [*_NUMERIC, *names]
    reference = [next(n for n in names if n.startswith(f"{c}_")) for c in C.CUSTOMER_LABELS]
    rows = rows.persist()
    train, test = rows.filter("is_train"), rows.filter("NOT is_train")
    linear = [f for f in features if f not in reference]
    logistic, scales = S.fit_logistic(train, linear, "label")
    boosting = S.fit_boosting(train, features, "label")
    scored = {
        "Logistic Regression": S.predict_logistic(logistic, scales, test, linear),
        "Naive Bayes": _bayes(b),
        "Gradient Boosting": S.predict(boosting, test, features),
    }
    return _compare(scored, "label")


_HISTORY = [
    "age", "income", "total_campaigns", "response_rate", *[C.column_name(ch) for ch in V.CAMPAIGN_CHANNELS],
    "last_campaign_contacts",
]


def campaign_predictions(b):
    """Every customer with the probability of an answer; fitted on 80 % of them."""
    rows = C.campaign_features(b.customers, b.campaign_responses, b.campaigns).persist()
    rows, names = C.encode_customers(rows)
    features = [*_HISTORY, *names]
    split = split_flag(rows, "customer_id", 0.8, 123, ["responded"])
    model = S.fit_boosting(split.filter("is_train"), features, "responded")
    aligned = L.align_features(rows, features, keep=["customer_id", "responded"])
    return S.predict(model, aligned, features).select("customer_id", "responded", "predicted_prob", "predicted_class")


@query("ml19_campaign_predictions")
def _(b):
    return campaign_predictions(b)


# --- fraud ---------------------------------------------------------------------------------------

_ISO = ["log_amount", "hour", "is_weekend"]


def _iso_rows(b):
    return D.time_features(b.transactions_ev).withColumn("log_amount", F.log1p("amount"))


def fraud_forest(b):
    return once(
        b, "isolation forest",
        lambda: A.fit_isolation_forest(_iso_rows(b), "transaction_id", _ISO).persist(),
    )


def fraud_autoencoder(b):
    def make():
        scaled = A.scaled_fraud_features(D.time_features(b.transactions_ev))
        return A.fit_autoencoder(scaled, ["amount", "hour", "is_weekend"])

    return once(b, "autoencoder", make)


@query("ml2_isolation_forest_score")
def _(b):
    rows = _iso_rows(b).select("transaction_id", *_ISO)
    scored = cut_lineage(A.isolation_scores(fraud_forest(b), rows, _ISO))
    return D.top_share_flag(scored, "iso_anomaly_score", "iso_anomaly_flag")


@query("ml4_autoencoder_error")
def _(b):
    scaled = A.scaled_fraud_features(D.time_features(b.transactions_ev))
    scored = cut_lineage(A.reconstruction_error(fraud_autoencoder(b), scaled, ["amount", "hour", "is_weekend"]))
    return D.top_share_flag(scored, "ae_reconstruction_error", "ae_anomaly_flag")


def full_flags(b):
    """The whole feature and flag job: rules, both model scores, seven flags, fraud flag."""
    rows = D.rule_flags(D.time_features(D.time_since_last(b.transactions_ev)), D.usual_patterns(b.transactions_ev))
    rows = rows.withColumn("log_amount", F.log1p("amount"))
    scaled = A.scaled_fraud_features(D.time_features(b.transactions_ev))
    errors = A.reconstruction_error(fraud_autoencoder(b), scaled, ["amount", "hour", "is_weekend"])
    scored = A.isolation_scores(fraud_forest(b), rows, _ISO).join(
        errors.select("transaction_id", "ae_reconstruction_error"), "transaction_id"
    )
    scored = cut_lineage(scored)  # two quantiles read the scores; the models run over the rows once
    scored = D.top_share_flag(scored, "iso_anomaly_score", "iso_anomaly_flag")
    scored = D.top_share_flag(scored, "ae_reconstruction_error", "ae_anomaly_flag")
    return D.combine_flags(scored, [*D.MODEL_FLAGS, *D.RULE_FLAGS])


@query("jb13_fraud_feature_and_flags")
def _(b):
    return full_flags(b).select(
        "transaction_id", "account_id", "amount", "time_since_last", "iso_anomaly_score",
        "ae_reconstruction_error", *D.MODEL_FLAGS, *D.RULE_FLAGS, "combined_anomaly_score", "fraud_flag",
    )


def fraud_predictions(b):
    """Test rows with class and probability of the cross-validated forest, trained on alert labels."""
    rows = D.with_alerts(D.rule_scored(b.transactions_ev), b.fraud_alerts)
    rows = rows.withColumn("is_fraud", F.col("is_fraud").cast("int")).select(
        "transaction_id", "account_id", "is_fraud", *S.FRAUD_FEATURES
    )
    rows = split_flag(rows, "transaction_id", 0.8, 42, ["is_fraud"], round_up=True)
    rows = spread(rows, b.transactions_ev.count(), "transaction_id", "account_id").persist()
    model = S.fit_forest_cross_validated(
        rows.filter("is_train"), S.FRAUD_FEATURES, "is_fraud", "transaction_id"
    )
    return S.predict(model, rows.filter("NOT is_train"), S.FRAUD_FEATURES).withColumnsRenamed(
        {"predicted_prob": "rf_prob", "predicted_class": "rf_pred"}
    )


@query("ml8_random_forest_fraud")
def _(b):
    return fraud_predictions(b).select("transaction_id", "account_id", "amount", "is_fraud", "rf_pred", "rf_prob")


@query(
    "sp5_k_fold",
    "transactions_ev",
    """SELECT transaction_id, CAST(((transaction_id % 2147483647) * 2654435761 + 42) % 1000003 % 5 AS INTEGER) AS fold
FROM transactions_ev""",
)
def _(b):
    return b.transactions_ev.select("transaction_id", fold_of(F.col("transaction_id"), 5, 42).alias("fold"))
