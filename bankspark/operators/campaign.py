"""Campaign response, revenue and ROI."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankspark import fixed_values as V
from bankspark.functions.numbers import as_money, cents_sum, dummies, percent, ratio
from bankspark.functions.text import percent_label, yes_flag
from bankspark.operators.joins import lookup_join, repeated_by
from bankspark.operators.profile import stack_rows
from bankspark.operators.sampling import ab_group


def responded_flag(responses: DataFrame) -> Column:
    """1 for a positive answer, else 0, whether the answer is a boolean or a spelled word."""
    if dict(responses.dtypes)["responded"] == "boolean":
        return F.coalesce(F.col("responded"), F.lit(False)).cast("int")
    return yes_flag(F.col("responded"))


def answers_per_customer(responses: DataFrame) -> DataFrame:
    """Numbers of yes and no answers of each customer; the rows of a busy customer combine early."""
    flag = responded_flag(responses)
    return responses.groupBy("customer_id").agg(
        F.sum(flag).alias("_yes"), F.sum(1 - flag).alias("_no")
    )


def merged_counts(customers: DataFrame, responses: DataFrame) -> DataFrame:
    """Customers with their answers; one without any response counts as a single no."""
    answers = answers_per_customer(responses)
    return customers.join(answers, "customer_id", "left").withColumns(
        {"_yes": F.coalesce("_yes", F.lit(0)), "_no": F.coalesce("_no", F.lit(1))}
    )


def overall_split(customers: DataFrame, responses: DataFrame) -> DataFrame:
    """Rows and percentage of Responded and No Response over the customer-response left join."""
    totals = merged_counts(customers, responses).agg(F.sum("_no").alias("no"), F.sum("_yes").alias("yes"))
    whole = F.col("no") + F.col("yes")
    rows = [
        [F.lit(V.RESPONSE_LABELS[0]), F.col("no"), F.col("no").cast("double") / whole * 100],
        [F.lit(V.RESPONSE_LABELS[1]), F.col("yes"), F.col("yes").cast("double") / whole * 100],
    ]
    report = stack_rows(totals, rows, ["responded_status", "count", "percentage"])
    return report.filter(F.col("count") > 0)


def _rates(grouped: DataFrame) -> DataFrame:
    total = F.col("no_response") + F.col("responded")
    return grouped.withColumn("total", total).withColumn(
        "response_rate_pct", ratio(F.col("responded"), F.col("total")) * 100
    )


def response_rate_by(customers: DataFrame, responses: DataFrame, dimension: Column, name: str) -> DataFrame:
    """No Response, Responded, Total and rate per value of one customer attribute."""
    merged = merged_counts(customers, responses).withColumn(name, dimension)
    return _rates(
        merged.filter(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.sum("_no").alias("no_response"), F.sum("_yes").alias("responded"))
    )


def response_rate_by_bands(
    customers: DataFrame, responses: DataFrame, band: Column, labels: Sequence[str], name: str
) -> DataFrame:
    """As :func:`response_rate_by`, with a row for every label: empty bands have no rate."""
    merged = merged_counts(customers, responses).withColumn(name, band)
    sums = merged.agg(
        *[F.sum(F.when(F.col(name) == x, F.col("_no"))).alias(f"_no{i}") for i, x in enumerate(labels)],
        *[F.sum(F.when(F.col(name) == x, F.col("_yes"))).alias(f"_yes{i}") for i, x in enumerate(labels)],
    )
    rows = [
        [F.lit(x), F.coalesce(F.col(f"_no{i}"), F.lit(0)), F.coalesce(F.col(f"_yes{i}"), F.lit(0))]
        for i, x in enumerate(labels)
    ]
    return _rates(stack_rows(sums, rows, [name, "no_response", "responded"]))


def response_history(responses: DataFrame) -> DataFrame:
    """Responses, campaigns and response rate per customer."""
    flag = responded_flag(responses)
    return responses.groupBy("customer_id").agg(
        F.sum(flag).alias("total_responses"), F.count(F.lit(1)).alias("total_campaigns")
    ).withColumn("response_rate", ratio(F.col("total_responses"), F.col("total_campaigns")))


def column_name(channel: str) -> str:
    """Column of a campaign channel; the prefix keeps it apart from the customer's e-mail and phone."""
    return "channel_" + channel.lower().replace(" ", "_")


def channel_counts(responses: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Contacts per customer and campaign channel, one column per channel.

    Grouped by customer and campaign before the campaign table is joined.
    """
    contacts = responses.groupBy("customer_id", "campaign_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = lookup_join(contacts, campaigns.select("campaign_id", "channel"), "campaign_id")
    return joined.groupBy("customer_id").agg(
        *[
            F.sum(F.when(F.col("channel") == ch, F.col("_n")).otherwise(0)).alias(column_name(ch))
            for ch in V.CAMPAIGN_CHANNELS
        ]
    )


def rate_by_band_and_channel(
    responses: DataFrame, campaigns: DataFrame, customers: DataFrame, band: Column, name: str
) -> DataFrame:
    """Mean response per age band (rows) and channel (columns); missing pairs are 0."""
    flag = responded_flag(responses)
    small = responses.groupBy("customer_id", "campaign_id").agg(
        F.sum(flag).alias("_yes"), F.count(F.lit(1)).alias("_n")
    )
    joined = (
        lookup_join(small, campaigns.select("campaign_id", "channel"), "campaign_id")
        .join(customers, "customer_id", "left")
        .withColumn(name, band)
    )
    rates = []
    for ch in V.CAMPAIGN_CHANNELS:
        here = F.col("channel") == ch
        rate = ratio(F.sum(F.when(here, F.col("_yes"))), F.sum(F.when(here, F.col("_n"))))
        rates.append(F.coalesce(rate, F.lit(0.0)).alias(column_name(ch)))
    return joined.groupBy(name).agg(*rates)


def last_campaign_contacts(responses: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Contacts per customer in the campaign that ended last (the lowest id on a tie)."""
    last = campaigns.orderBy(F.desc("end_date"), "campaign_id").select("campaign_id").limit(1)
    return (
        responses.join(F.broadcast(last), "campaign_id", "left_semi")  # one row
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("last_campaign_contacts"))
    )


def funnel(customers: DataFrame, responses: DataFrame) -> DataFrame:
    """Reached (all customers), Opened (customers with a response row), Converted (at least one yes)."""
    answers = answers_per_customer(responses.filter(F.col("customer_id").isNotNull()))
    known = customers.select("customer_id", F.lit(1).alias("_known"))
    counted = known.join(answers, "customer_id", "full").agg(
        F.count("_known").alias("reached"), F.count("_yes").alias("opened"),
        F.count_if(F.col("_known").isNotNull() & (F.col("_yes") > 0)).alias("converted"),
    )
    stages = [("Reached", "reached"), ("Opened", "opened"), ("Converted", "converted")]
    rows = []
    for title, c in stages:
        share = F.round(percent(F.col(c), F.col("reached")), 1)
        rows.append([F.lit(title), F.col(c), share, percent_label(F.lit(title), F.col(c), share)])
    return stack_rows(counted, rows, ["stage", "count", "percent", "label"])


def transactions_of_responders(
    transactions: DataFrame, accounts: DataFrame, responses: DataFrame
) -> DataFrame:
    """Positive responses x transactions by customer, each transaction with its number of copies."""
    owned = transactions.join(accounts.select("account_id", "customer_id"), "account_id").select(
        "account_id", "customer_id", "transaction_date", "amount", "channel", "location"
    )
    return repeated_by(owned, responses.filter("responded"), "customer_id", "response_count")


def _spent(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Spending per customer from spending per account, so accounts join as single rows."""
    per_account = transactions.groupBy("account_id").agg(cents_sum(F.col("amount")).alias("_s"))
    return (
        per_account.join(accounts.select("account_id", "customer_id"), "account_id")
        .groupBy("customer_id")
        .agg(F.sum("_s").alias("_s"))
    )


def revenue_stats(transactions: DataFrame, accounts: DataFrame, responses: DataFrame) -> DataFrame:
    """Mean over responders of amount x number of positive responses.

    Every positive response repeats all transactions of its customer; the repetition is a
    multiplication here.
    """
    yes = responses.filter("responded").groupBy("customer_id").agg(F.count(F.lit(1)).alias("_yes"))
    spent = _spent(transactions, accounts).join(yes, "customer_id")
    total = as_money(F.col("_s") * F.col("_yes"))
    return spent.agg(F.round(F.avg(total), 4).alias("average_revenue_per_response"))


def campaign_roi(responses: DataFrame, costs: DataFrame, revenue_per_response: float) -> DataFrame:
    """Responders, revenue and (revenue - cost) / cost per campaign."""
    responders = responses.filter("responded").groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("responders")
    )
    revenue = F.col("responders") * F.lit(revenue_per_response)
    return responders.join(costs, "campaign_id").withColumns(
        {
            "total_revenue": revenue.cast("double"),
            "roi": ratio(revenue - F.col("cost_mmk"), F.col("cost_mmk")),
        }
    )


def offer_summary(transactions: DataFrame, accounts: DataFrame, responses: DataFrame) -> DataFrame:
    """Spending, transactions and last location per responding customer and channel.

    Amounts and counts carry the repetition by positive responses; the last location is that of
    the latest transaction (ties by the highest account, then amount, then location).
    """
    order = F.struct("transaction_date", "account_id", "amount", "location")
    per_account = transactions.groupBy("account_id", "channel").agg(
        cents_sum(F.col("amount")).alias("_s"), F.count(F.lit(1)).alias("_n"), F.max(order).alias("_last")
    )
    per_customer = (
        per_account.join(accounts.select("account_id", "customer_id"), "account_id")
        .groupBy("customer_id", "channel")
        .agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.max("_last").alias("_last"))
    )
    yes = responses.filter("responded").groupBy("customer_id").agg(F.count(F.lit(1)).alias("_yes"))
    return per_customer.join(yes, "customer_id").select(
        "customer_id", "channel",
        as_money(F.col("_s") * F.col("_yes")).alias("total_spent"),
        (F.col("_n") * F.col("_yes")).alias("transactions"),
        F.col("_last.location").alias("last_location"),
    )


def ab_statistics(responses: DataFrame, seed: int) -> DataFrame:
    """Total, responded and rate of both test groups."""
    flag = responded_flag(responses)
    return (
        responses.withColumn("group", ab_group(F.col("response_id"), seed))
        .groupBy("group")
        .agg(F.count(F.lit(1)).alias("total"), F.sum(flag).alias("responded"))
        .withColumn("response_rate", ratio(F.col("responded"), F.col("total")))
    )


def campaign_features(customers: DataFrame, responses: DataFrame, campaigns: DataFrame) -> DataFrame:
    """One row per customer: attributes, response history, channel counts, last contacts, label."""
    from bankspark.operators.columns import fill_numeric

    joined = (
        customers.join(response_history(responses), "customer_id", "left")
        .join(channel_counts(responses, campaigns), "customer_id", "left")
        .join(last_campaign_contacts(responses, campaigns), "customer_id", "left")
    )
    return fill_numeric(joined).withColumn(
        "responded", F.when(F.col("total_responses") > 0, 1).otherwise(0)
    )


FIXED_LEVELS = {"gender": V.GENDERS, "marital_status": V.MARITAL_STATUSES, "education_level": V.EDUCATION_LEVELS}
OPEN_LEVELS = ["occupation", "region"]
CUSTOMER_LABELS = [*FIXED_LEVELS, *OPEN_LEVELS]
MOST_LEVELS = 1000


def levels_of(rows: DataFrame, column: str, most: int = MOST_LEVELS) -> list:
    """The values of a column that holds a few labels; more than ``most`` are an error, never cut off."""
    found = rows.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values and is no label")
    return sorted(r[0] for r in found)


def encode_customers(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows with a 0/1 column per level of every categorical customer column, and the names of these.

    Columns without a fixed list of levels have those that ``rows`` hold; a null is 0 in all levels.
    """
    names: list[str] = []
    for column, levels in (FIXED_LEVELS | {c: levels_of(rows, c) for c in OPEN_LEVELS}).items():
        columns = dummies(F.col(column), levels, column)
        rows = rows.withColumns(columns)
        names += list(columns)
    return rows, names


def mean_by_bracket(df: DataFrame, bracket: Column, value: str, name: str) -> DataFrame:
    return df.groupBy(bracket.alias("income_bracket")).agg(F.round(F.avg(value), 9).alias(name))
