"""Run a whole job from a folder of CSV tables to a folder of results.

    python -m bankspark.plans.run <job> --input <folder> --output <folder> [--as-of 2025-04-25]

Tables are read from ``<input>/<table>.csv`` (a file or a folder of part files); every result is a
folder of CSV part files under ``<output>``.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bankspark import fixed_values as V
from bankspark.functions import numbers as N
from bankspark.functions.dates import parse_date
from bankspark.ml import anomaly as A
from bankspark.ml import clusters as K
from bankspark.ml import metrics as M
from bankspark.ml import shap as H
from bankspark.ml import supervised as S
from bankspark.ml.dbscan import dbscan
from bankspark.ml.naive_bayes import NaiveBayes
from bankspark.operators import campaign as C
from bankspark.operators import cleaning, fraud, ranking
from bankspark.operators import customers as U
from bankspark.operators import profile as P
from bankspark.operators import reports as R
from bankspark.operators.quantiles import exact_quantiles
from bankspark.operators.sampling import split_flag
from bankspark.session import configure, cut_lineage, spread
from bankspark.sources import files

JOBS: dict[str, Callable[[Run], None]] = {}


class Run:
    """Input tables, output folder and parameters of one run."""

    def __init__(self, spark: SparkSession, source: str, out: str, as_of: str = "2025-04-25", today: str = "2025-05-10", rounds: int = 100):
        self.rounds = rounds  # of boosting
        self.spark, self.source, self.out, self.as_of, self.today = configure(spark), source, out, as_of, today

    def table(self, name: str) -> DataFrame:
        return files.read_bank_csv(self.spark, f"{self.source}/{name}.csv", name)

    def save(self, name: str, df: DataFrame) -> None:
        files.write_csv(df, f"{self.out}/{name}", mode="overwrite")


def job(build: Callable[[Run], None]):
    JOBS[build.__name__] = build
    return build


@job
def clean_transactions(run: Run) -> None:
    run.save("transactions", cleaning.clean_transactions(run.table("transactions")))


@job
def account_report(run: Run) -> None:
    accounts, customers = run.table("accounts").persist(), run.table("customers")
    run.save("account_nulls", P.null_profile(accounts))
    run.save(
        "account_distinct_and_ownership",
        P.distinct_profile(accounts).unionByName(P.count_of_counts(accounts, "customer_id")),
    )
    run.save(
        "balance_profile",
        P.scalar_profile(accounts, "balance", "Balance").unionByName(P.banded_histogram(accounts, "balance")),
    )
    chosen = ["account_type", "status", "open_date", "customer_id", "balance"]
    run.save("account_values", P.value_profile(accounts, "account_id", chosen))
    for column in ("status", "account_type"):
        run.save(f"accounts_by_{column}", R.value_counts(accounts, column))
        run.save(f"balance_by_{column}", R.sum_by(accounts, column, "balance", "total_balance"))
        both = R.count_and_sum_through(
            accounts, customers, "customer_id", "region", column, "balance", f"{column}_count", "balance"
        ).persist()
        run.save(f"accounts_by_region_and_{column}", both.drop("balance"))
        run.save(f"balance_by_region_and_{column}", both.drop(f"{column}_count"))
    run.save(
        "balance_by_region",
        R.count_and_sum_through(
            accounts, customers, "customer_id", "region", None, "balance", "accounts", "balance"
        ).drop("accounts"),
    )


@job
def transaction_report(run: Run) -> None:
    tx = run.table("transactions").persist()
    monthly = R.monthly_summary(tx).persist()
    by_location = R.monthly_summary(tx, ["location"], extremes=False).persist()
    run.save("monthly", monthly.orderBy("date_time"))
    run.save("monthly_by_type", R.monthly_summary(tx, ["type"], False, False).orderBy("type", "date_time"))
    run.save("monthly_by_location", by_location.orderBy("location", "date_time"))
    run.save("top_locations", R.share_of_total(tx, "location", 10))
    run.save("channels", R.channel_summary(tx))
    run.save("busiest_months", ranking.top_rows(monthly, [F.desc("transaction_count"), "date_time"], 5))
    run.save("highest_amount_months", ranking.top_rows(monthly, [F.desc("total_amount"), "date_time"], 5))
    run.save("locations_within_month", by_location.orderBy("date_time", F.desc("total_amount"), "location"))
    counts = R.value_counts(tx, "location", "number_of_transactions")
    run.save("transactions_by_location", counts)
    run.save("amount_by_location", R.sum_by(tx, "location", "amount", "total_transaction_amount"))
    run.save("location_activity", ranking.extremes(counts, "location", "number_of_transactions"))


@job
def location_peaks(run: Run) -> None:
    tx = run.table("transactions").persist()
    peaks = ranking.peak_and_least_months(tx).persist()
    run.save("location_peaks", peaks)
    files.write_per_key(peaks, "location", f"{run.out}/location_peaks_by_location", mode="overwrite")
    run.save("location_first_peaks", ranking.first_peak_months(tx))


@job
def account_statistics(run: Run) -> None:
    stats = R.account_statistics(run.table("transactions")).persist()
    run.save("account_statistics", stats)
    run.save("account_statistics_with_owner", R.with_owner(stats, run.table("accounts")))


@job
def usual_patterns(run: Run) -> None:
    run.save("usual_patterns", fraud.usual_patterns(run.table("transactions")))


_RESPONSE_HEADERS = {
    "no_response": "No Response", "responded": "Responded", "total": "Total", "response_rate_pct": "Response Rate (%)",
}


@job
def campaign_response(run: Run) -> None:
    customers, responses = run.table("customers").persist(), run.table("campaign_responses").persist()
    run.save("responses_overall", C.overall_split(customers, responses))
    for column in ("region", "gender", "income"):
        rates = C.response_rate_by(customers, responses, F.col(column), column)
        run.save(f"responses_by_{column}", rates.withColumnsRenamed(_RESPONSE_HEADERS))
    band = N.bin_left_closed(F.col("age"), V.AGE_EDGES, V.AGE_LABELS)
    ages = C.response_rate_by_bands(customers, responses, band, V.AGE_LABELS, "age_group")
    run.save("responses_by_age_group", ages.withColumnsRenamed(_RESPONSE_HEADERS))
    merged = customers.join(responses, "customer_id", "left")
    files.write_per_key(merged, "region", f"{run.out}/responses_per_region", mode="overwrite", files_per_key=16)


@job
def campaign_analysis(run: Run) -> None:
    customers, responses = run.table("customers").persist(), run.table("campaign_responses").persist()
    campaigns = run.table("campaigns")
    accounts, tx = run.table("accounts"), run.table("transactions")
    costs = run.table("campaign_costs").withColumns(
        {c: parse_date(F.col(c), "M/d/yyyy", "yyyy-MM-dd") for c in ("start_date", "end_date")}
    )
    features = C.campaign_features(customers, responses, campaigns).persist()
    run.save("campaign_features", features)
    predicted = response_predictions(features, run.rounds).persist()
    run.save("predictions", predicted)
    edges = exact_quantiles(customers, "income", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    bracket = N.bin_right_closed(F.col("income"), edges, V.INCOME_BRACKETS, include_lowest=True)
    run.save("income_conversion", C.mean_by_bracket(predicted, bracket, "predicted_prob", "conversion_rate"))
    features.unpersist()
    run.save("funnel", C.funnel(customers, responses))
    run.save("revenue_per_responder", C.revenue_stats(tx, accounts, responses))
    run.save("campaign_roi", C.campaign_roi(responses, costs, V.REVENUE_PER_RESPONSE))
    run.save("offers", C.offer_summary(tx, accounts, responses))
    run.save("ab_test", C.ab_statistics(responses, 123))
    band = N.bin_right_closed(F.col("age"), V.HEATMAP_AGE_EDGES, V.HEATMAP_AGE_LABELS)
    run.save(
        "response_rate_by_age_and_channel",
        C.rate_by_band_and_channel(responses, campaigns, customers.select("customer_id", "age"), band, "age_group"),
    )


def response_predictions(features: DataFrame, rounds: int) -> DataFrame:
    """Boosting over numeric and encoded columns, fitted on 80 % and applied to every customer."""
    rows, names = C.encode_customers(features)
    names += ["age", "income", "total_campaigns", "response_rate", *map(C.column_name, V.CAMPAIGN_CHANNELS), "last_campaign_contacts"]
    split = split_flag(rows, "customer_id", 0.8, 123, ["responded"]).persist()
    model = S.fit_boosting(split.filter("is_train"), names, "responded", rounds)
    return S.predict(model, split, names).select("customer_id", "income", "responded", "predicted_prob", "predicted_class")


@job
def campaign_models(run: Run) -> None:
    """Three models of the single answer, compared on the same held-out 30 %."""
    numeric, labels = ["age", "income"], C.CUSTOMER_LABELS
    customers = run.table("customers").select("customer_id", *numeric, *labels)
    answers = run.table("campaign_responses").select("response_id", "customer_id", F.col("responded").cast("int").alias("label"))
    rows = answers.join(customers, "customer_id", "left").dropna("any").drop("customer_id")
    rows = split_flag(rows, "response_id", 0.7, 123, ["label"], round_up=True)
    rows, names = C.encode_customers(rows)
    rows = rows.persist()
    train, test = rows.filter("is_train"), rows.filter("NOT is_train")
    first = {c: next(n for n in names if n.startswith(f"{c}_")) for c in labels}  # the reference level of each
    linear = numeric + [n for n in names if n not in first.values()]
    logistic, scales = S.fit_logistic(train, linear, "label")
    bayes = NaiveBayes.fit(train, "label", numeric, labels)
    boosting = S.fit_boosting(train, numeric + names, "label", run.rounds)
    scored = {
        "Logistic Regression": S.predict_logistic(logistic, scales, test, linear),
        "Naive Bayes": bayes.predict(test),
        "Gradient Boosting": S.predict(boosting, test, numeric + names),
    }
    parts = [df.select(F.lit(m).alias("model"), "label", "predicted_prob") for m, df in scored.items()]
    run.save("model_comparison", M.compare_models(reduce(lambda x, y: x.unionByName(y), parts), "model", "label", "predicted_prob"))
    rows.unpersist()


@job
def churn(run: Run) -> None:
    run.save(
        "churn_labels",
        U.churn_labels(run.table("customers"), run.table("transactions"), run.table("accounts"), run.as_of),
    )


@job
def segments(run: Run) -> None:
    features = U.customer_features(
        *[run.table(t) for t in ("customers", "credit_scores", "loans", "accounts", "transactions")]
    ).persist()
    names = ["age", "income", "score", "total_loans", "total_balance", "average_transaction"]
    rows, kept = K.scaled_features(features, "customer_id", names)
    rows = rows.persist()
    labels = K.kmeans_labels(K.fit_kmeans(rows, kept), rows, kept).select("customer_id", "kmeans_cluster")
    few = min(5, len(kept))
    components = K.principal_components(rows, "customer_id", kept, few)
    run.save("principal_components", components)
    ward = K.ward_labels(components, [f"pc{i + 1}" for i in range(few)]).select("customer_id", "hc_cluster")
    density = dbscan(rows, "customer_id", kept, 0.5, 5).select("customer_id", "dbscan_cluster")
    out = features
    for part in (labels, ward, density):
        out = out.join(part, "customer_id", "left")
    run.save("segments", out.withColumn("segment_label", K.segment_name(F.col("kmeans_cluster"))))


@job
def loan_default(run: Run) -> None:
    data = U.loan_default_data(run.table("loans"), run.table("customers"), run.table("credit_scores"))
    data = S.model_matrix(data).withColumn("row_id", F.xxhash64("loan_id", "score_id"))
    rows = split_flag(data, "row_id", 0.8, 123).persist()
    train, test = rows.filter("is_train"), rows.filter("NOT is_train")
    shown = ["default", *U.LOAN_FEATURES]
    run.save("loan_rows", rows.select(shown))
    run.save("train_rows", train.select(shown))
    run.save("test_rows", test.select(shown))
    logistic, scales = S.fit_logistic(train, S.GLM_FEATURES, "default")
    coefs = S.coefficients(logistic, scales, S.GLM_FEATURES, run.spark)
    run.save("logistic_coefficients", coefs)
    run.save("odds_ratios", S.odds_ratios(coefs))
    terms = {f: [f] for f in S.LOAN_NUMERIC} | {"risk_level": S.RISK_DUMMIES[1:]}
    run.save("variance_inflation", S.variance_inflation(logistic, scales, train, S.GLM_FEATURES, terms))
    forest = S.fit_forest(train, S.LOAN_MATRIX, "default")
    tree = S.fit_tree(train, S.LOAN_MATRIX, "default")
    others = {
        "logistic": S.predict_logistic(logistic, scales, test, S.GLM_FEATURES), "tree": S.predict(tree, test, S.LOAN_MATRIX),
        "forest": S.predict(forest, test, S.LOAN_MATRIX),
    }
    for name, found in others.items():
        run.save(f"{name}_confusion", M.confusion(found, "default", "predicted_prob"))
        run.save(f"{name}_roc_curve", M.roc_points(found, "default", "predicted_prob"))
    run.save("forest_importance", S.permutation_importance(forest, test, S.LOAN_MATRIX, "default", "row_id"))
    boosting = S.fit_boosting(train, S.LOAN_MATRIX, "default", run.rounds)
    scored = S.predict(boosting, test, S.LOAN_MATRIX)
    run.save("predictions", scored.select(*shown, "predicted_prob", "predicted_class"))
    run.save("boosting_importance", S.importance(boosting, S.LOAN_MATRIX, run.spark).limit(10))
    run.save("roc_curve", M.roc_points(scored, "default", "predicted_prob"))
    run.save("confusion", M.confusion(scored, "default", "predicted_prob"))
    parts = H.shap_values(boosting, test, S.LOAN_MATRIX, ["loan_id", "score_id"])
    run.save("shap_values", parts)
    run.save("shap_long", H.shap_long(parts, S.LOAN_MATRIX, ["loan_id", "score_id"]))


@job
def fraud_detection(run: Run) -> None:
    tx = run.table("transactions")
    rows = fraud.rule_flags(fraud.time_features(fraud.time_since_last(tx)), fraud.usual_patterns(tx))
    iso = ["log_amount", "hour", "is_weekend"]
    rows = rows.withColumn("log_amount", F.log1p("amount"))
    forest = A.fit_isolation_forest(rows, "transaction_id", iso).persist()
    files.append_table(forest, f"{run.out}/isolation_forest", run_date=run.today)
    scaled = A.scaled_fraud_features(fraud.time_features(tx))
    weights = A.fit_autoencoder(scaled, ["amount", "hour", "is_weekend"])
    errors = A.reconstruction_error(weights, scaled, ["amount", "hour", "is_weekend"])
    scored = A.isolation_scores(forest, rows, iso).join(
        errors.select("transaction_id", "ae_reconstruction_error"), "transaction_id"
    )
    scored = cut_lineage(scored.drop("log_amount"))
    scored = fraud.top_share_flag(scored, "iso_anomaly_score", "iso_anomaly_flag")
    scored = fraud.top_share_flag(scored, "ae_reconstruction_error", "ae_anomaly_flag")
    data = cut_lineage(fraud.combine_flags(scored, [*fraud.MODEL_FLAGS, *fraud.RULE_FLAGS]))
    run.save("flagged_transactions", data)
    files.write_gzip(data, f"{run.out}/flagged_transactions_gz", mode="overwrite")
    files.write_dated_run(data, f"{run.out}/runs", run.today)
    run.save("risky_transactions", data.filter(F.col("fraud_flag") == 1))
    run.save("daily_fraud", fraud.daily_summary(data))
    run.save("account_risk", fraud.account_risk(data))
    run.save("location_risk", fraud.location_risk(data))
    kept = ["iso_anomaly_score", "ae_reconstruction_error", "combined_anomaly_score", "fraud_flag"]
    run.save("anomaly_scores", data.select("transaction_id", "account_id", "amount", *kept))
    files.append_run_log(data, f"{run.out}/run_log", f"{run.today} 00:00:00")
    labelled = fraud.with_alerts(data, run.table("fraud_alerts")).withColumn("is_fraud", F.col("is_fraud").cast("int"))
    labelled = split_flag(labelled.select("transaction_id", "account_id", "is_fraud", *S.FRAUD_FEATURES), "transaction_id", 0.8, 42, ["is_fraud"], round_up=True)
    labelled = spread(labelled, data.count(), "transaction_id", "account_id").persist()
    best = S.fit_forest_cross_validated(labelled.filter("is_train"), S.FRAUD_FEATURES, "is_fraud", "transaction_id")
    predicted = cut_lineage(S.predict(best, labelled.filter("NOT is_train"), S.FRAUD_FEATURES).withColumnsRenamed({"predicted_prob": "rf_prob", "predicted_class": "rf_pred"}))
    run.save("forest_predictions", predicted)
    run.save("forest_errors", M.errors_only(predicted, "is_fraud", "rf_pred"))
    run.save("forest_confusion", M.confusion(predicted, "is_fraud", "rf_prob"))
    labelled.unpersist()


@job
def fraud_label_reports(run: Run) -> None:
    alerts = run.table("fraud_alerts").persist()
    labelled = fraud.with_alerts(run.table("transactions"), alerts).persist()
    run.save("fraud_by_location", fraud.fraud_by(labelled, "location"))
    run.save("fraud_by_merchant", fraud.fraud_by(labelled, "merchant"))
    run.save("fraud_by_date", fraud.fraud_by_date(alerts))
    run.save("fraud_totals", fraud.fraud_kpis(labelled))


@job
def generate(run: Run) -> None:
    """Write all eight tables as CSV; the input folder is not read."""
    from bankspark.generate.bank import BankGenerator

    g = BankGenerator(run.spark)
    customers = g.customers(g.ids(1000, "customer_id"))
    accounts = g.accounts(customers)
    tx = g.transactions(accounts)
    campaigns = g.campaigns(g.ids(10, "campaign_id"))
    made = {
        "customers": customers, "accounts": accounts, "transactions": tx, "loans": g.loans(customers),
        "credit_scores": g.credit_scores(customers), "campaigns": campaigns,
        "campaign_responses": g.campaign_responses(campaigns, customers), "fraud_alerts": g.fraud_alerts(tx),
    }
    for name, df in made.items():
        run.save(f"{name}.csv", df)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("--input", default="")
    parser.add_argument("--output", required=True)
    parser.add_argument("--as-of", default="2025-04-25")
    args = parser.parse_args()
    spark = SparkSession.builder.appName(f"bankspark-{args.job}").config("spark.ui.enabled", "false").getOrCreate()
    JOBS[args.job](Run(spark, args.input, args.output, args.as_of))


if __name__ == "__main__":
    main()
