"""Synthetic bank tables of any size.

All draws are hashes of the row's own key, so tables can be made by any number of tasks, come out
the same every time, and refer to each other correctly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bankspark import fixed_values as V
from bankspark.functions.dates import loan_end
from bankspark.functions.numbers import clip, risk_tier
from bankspark.operators.joins import pair_all

_STEPS = 1 << 40


def uniform(seed: int, purpose: str, *keys: str) -> Column:
    """A repeatable draw from [0, 1) for each row key and purpose."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), *keys), F.lit(_STEPS)) / float(_STEPS)


def choice(draw: Column, values: list) -> Column:
    """A uniform pick."""
    return F.array(*map(F.lit, values))[F.floor(draw * len(values)).cast("int")]


def weighted(draw: Column, values: list[str], weights: list[float]) -> Column:
    """A pick by weights."""
    out, upto = None, 0.0
    for value, weight in zip(values[:-1], weights):
        upto += weight
        out = F.when(draw < upto, value) if out is None else out.when(draw < upto, value)
    return out.otherwise(values[-1])


def poisson(draw: Column, mean: float, most: int) -> Column:
    """A Poisson count from one uniform draw, by the cumulative probabilities up to ``most``."""
    p = math.exp(-mean)
    upto, steps = p, []
    for k in range(most):
        steps.append(F.when(draw >= upto, 1).otherwise(0))
        p *= mean / (k + 1)
        upto += p
    out = steps[0]
    for step in steps[1:]:
        out = out + step
    return out


def money(draw: Column, low: float, high: float) -> Column:
    return F.round(F.lit(low) + draw * (high - low), 2)


def day_between(draw: Column, first: Column, last: Column) -> Column:
    """A day from ``first`` to ``last``, both possible."""
    span = F.greatest(F.datediff(last, first), F.lit(0)) + 1
    return F.date_add(first, F.floor(draw * span).cast("int"))


class BankGenerator:
    """Builds the eight tables for ``today`` and a seed."""

    def __init__(self, spark: SparkSession, seed: int = 42, today: str = "2025-04-25"):
        self.spark, self.seed = spark, seed
        self.today = F.lit(today).cast("date")

    def _u(self, purpose: str, *keys: str) -> Column:
        return uniform(self.seed, purpose, *keys)

    def ids(self, n: int, name: str) -> DataFrame:
        """Ids 1 .. n."""
        return self.spark.range(1, n + 1).withColumnRenamed("id", name)

    def customers(self, ids: DataFrame) -> DataFrame:
        """Uniform attributes for each customer id; the age follows from the year of birth."""
        key = "customer_id"
        gender = choice(self._u("gender", key), V.GENDERS)
        born = day_between(self._u("born", key), F.add_months(self.today, -81 * 12), F.add_months(self.today, -18 * 12))
        number = F.lpad(F.floor(self._u("phone", key) * 100_000_000).cast("string"), 8, "0")
        return ids.select(
            key,
            F.concat(F.lit("Customer "), F.col(key).cast("string")).alias("name"),
            gender.alias("gender"),
            born.alias("date_of_birth"),
            (F.year(self.today) - F.year(born)).alias("age"),
            choice(self._u("marital", key), V.MARITAL_STATUSES).alias("marital_status"),
            choice(self._u("education", key), V.EDUCATION_LEVELS).alias("education_level"),
            F.concat(F.lit("Occupation "), F.floor(self._u("occupation", key) * 12 + 1).cast("string")).alias("occupation"),
            money(self._u("income", key), 300_000, 5_000_000).alias("income"),
            choice(self._u("region", key), V.LOCATIONS).alias("region"),
            day_between(self._u("join", key), F.add_months(self.today, -120), self.today).alias("join_date"),
            F.concat(F.lit("customer"), F.col(key).cast("string"), F.lit("@example.com")).alias("email"),
            F.concat(F.lit("09"), number).alias("phone"),
        )

    def accounts(self, customers: DataFrame, average: float = 1.5) -> DataFrame:
        """One account plus a Poisson number of further ones, opened after joining."""
        count = poisson(self._u("accounts", "customer_id"), average - 1, 12) + 1
        rows = customers.select("customer_id", "join_date", F.explode(F.sequence(F.lit(1), count)).alias("_k"))
        key = ["customer_id", "_k"]
        return rows.select(
            (F.col("customer_id") * 16 + F.col("_k")).alias("account_id"),
            "customer_id",
            choice(self._u("account type", *key), V.ACCOUNT_TYPES).alias("account_type"),
            day_between(self._u("open", *key), F.col("join_date"), self.today).alias("open_date"),
            weighted(self._u("status", *key), V.ACCOUNT_STATUSES, [0.85, 0.10, 0.05]).alias("status"),
            money(self._u("balance", *key), 10_000, 50_000_000).alias("balance"),
        )

    def transactions(self, accounts: DataFrame, average: float = 20) -> DataFrame:
        """A Poisson number of transactions for active accounts only; merchants on debits only."""
        most = int(average + 8 * math.sqrt(average)) + 8
        count = poisson(self._u("transactions", "account_id"), average, most)
        active = accounts.filter(F.col("status") == "Active").withColumn("_n", count).filter(F.col("_n") > 0)
        rows = active.select("account_id", "open_date", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k"))
        key = ["account_id", "_k"]
        opened = F.unix_seconds(F.col("open_date").cast("timestamp"))
        until = F.unix_seconds(self.today.cast("timestamp"))
        moment = opened + F.floor(self._u("moment", *key) * F.greatest(until - opened, F.lit(1)))
        kind = weighted(self._u("type", *key), V.TRANSACTION_TYPES, [0.6, 0.4])
        return rows.select(
            (F.col("account_id") * 1024 + F.col("_k")).alias("transaction_id"),
            "account_id",
            F.timestamp_seconds(moment).cast("timestamp_ntz").alias("transaction_date"),
            money(self._u("amount", *key), 1_000, 5_000_000).alias("amount"),
            kind.alias("type"),
            choice(self._u("channel", *key), V.TRANSACTION_CHANNELS).alias("channel"),
            F.when(kind == "Debit", choice(self._u("merchant", *key), list(V.MERCHANT_LOCATIONS))).otherwise(
                ""
            ).alias("merchant"),
            choice(self._u("location", *key), V.LOCATIONS).alias("location"),
        )

    def loans(self, customers: DataFrame, share: float = 0.3) -> DataFrame:
        """A loan for the given share of customers; a month of its term counts 30 days."""
        key = "customer_id"
        rows = customers.filter(self._u("has loan", key) < share)
        start = day_between(self._u("loan start", key), F.col("join_date"), self.today)
        term = choice(self._u("term", key), V.LOAN_TERMS)
        return rows.select(
            F.col(key).alias("loan_id"),
            key,
            choice(self._u("loan type", key), V.LOAN_TYPES).alias("loan_type"),
            money(self._u("loan amount", key), 1_000_000, 100_000_000).alias("loan_amount"),
            money(self._u("rate", key), 8.0, 15.0).alias("interest_rate"),
            term.alias("term_months"),
            start.alias("start_date"),
            loan_end(start, term).alias("end_date"),
            weighted(self._u("loan status", key), V.LOAN_STATUSES, [0.6, 0.1, 0.25, 0.05]).alias("status"),
        )

    def credit_scores(self, customers: DataFrame) -> DataFrame:
        """One to five scores per customer around a base that rises with income and age."""
        key = "customer_id"
        drawn = F.lit(300) + F.floor(self._u("base score", key) * 551)
        base = clip(drawn + F.col("income") / 1_000_000 * 10 + (F.col("age") - 30) * 0.5, 300.0, 850.0)
        count = (F.floor(self._u("scores", key) * 5) + 1).cast("int")
        rows = customers.select(key, "join_date", base.alias("_base"), F.explode(F.sequence(F.lit(1), count)).alias("_k"))
        both = [key, "_k"]
        # a normal draw from two uniform ones
        noise = F.sqrt(-2 * F.log(1 - self._u("noise a", *both))) * F.cos(2 * math.pi * self._u("noise b", *both)) * 20
        score = clip((F.col("_base") + noise).cast("int"), 300, 850)
        return rows.select(
            (F.col(key) * 8 + F.col("_k")).alias("score_id"),
            key,
            score.alias("score"),
            day_between(self._u("score day", *both), F.col("join_date"), self.today).alias("date_recorded"),
            risk_tier(score).alias("risk_level"),
        )

    def campaigns(self, ids: DataFrame) -> DataFrame:
        """For each campaign id a campaign of 7 to 60 days that began in the last two years."""
        key = "campaign_id"
        start = day_between(self._u("campaign start", key), F.add_months(self.today, -24), self.today)
        days = (F.lit(7) + F.floor(self._u("campaign days", key) * 54)).cast("int")
        return ids.select(
            key,
            F.concat(F.lit("Campaign_"), F.col(key).cast("string"), F.lit("_"), F.year(start).cast("string")).alias(
                "campaign_name"
            ),
            start.alias("start_date"),
            F.date_add(start, days).alias("end_date"),
            choice(self._u("campaign channel", key), V.CAMPAIGN_CHANNELS).alias("channel"),
        )

    def campaign_responses(self, campaigns: DataFrame, customers: DataFrame) -> DataFrame:
        """Every customer answers every campaign, on a day of the campaign, by a coin flip."""
        both = ["campaign_id", "customer_id"]
        pairs = pair_all(
            customers.select("customer_id"), campaigns.select("campaign_id", "start_date", "end_date"), "customer_id"
        )
        return pairs.select(
            (F.col("customer_id") * 100_000 + F.col("campaign_id")).alias("response_id"),
            *both,
            day_between(self._u("answer day", *both), F.col("start_date"), F.col("end_date")).alias("response_date"),
            (self._u("answer", *both) < 0.5).alias("responded"),
        )

    def fraud_alerts(self, transactions: DataFrame) -> DataFrame:
        """One alert per transaction, on its day or later, true by a coin flip."""
        key = "transaction_id"
        return transactions.select(
            F.col(key).alias("fraud_id"),
            key,
            day_between(self._u("alert day", key), F.col("transaction_date").cast("date"), self.today).alias("fraud_date"),
            (self._u("fraud", key) < 0.5).alias("is_fraud"),
        )
