"""The logical bank tables, as views over the star-schema Parquet files.

Each view is one SELECT whose expressions mean the same in Spark SQL and in DuckDB, so the
check SQL of a query can repeat the view as a CTE.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from bankspark import fixed_values as V


@dataclass(frozen=True)
class View:
    """One adapter view; braces in ``source`` mark the tables or views it reads."""

    source: str
    columns: dict[str, str]

    @property
    def reads(self) -> list[str]:
        return sorted(set(re.findall(r"\{(\w+)\}", self.source)))

    def select(self) -> str:
        cols = ",\n  ".join(f"{expr} AS {name}" for name, expr in self.columns.items())
        return f"SELECT {cols}\nFROM {self.source}"


def _cases(expr: str, labels: list[str]) -> str:
    """CASE that maps 0, 1, 2 ... to the labels, the last label standing for the rest."""
    whens = " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(labels[:-1]))
    return f"CASE {expr} {whens} ELSE '{labels[-1]}' END"


_DEBIT = "event_type IN ('purchase','error','view')"
# The number inside ``props`` is extracted once per row, however many columns use it.
_EVENTS = "(SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS prop FROM {events}) AS e"
_SCORE = "CAST(300 + (event_id * 37 + user_id * 11) % 551 AS INT)"
_MERCHANTS = list(V.MERCHANT_LOCATIONS)

VECTOR_SIZE = 64  # entries of an embedding

VIEWS: dict[str, View] = {
    "customers": View(
        "{customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey",
        {
            "customer_id": "c_custkey",
            "name": "c_name",
            "gender": _cases("c_custkey % 3", ["Male", "Female", "Other"]),
            "age": "CAST(18 + (c_custkey * 11) % 63 AS INT)",
            "marital_status": _cases("c_custkey % 4", ["Single", "Married", "Divorced", "Widowed"]),
            "education_level": _cases("c_custkey % 7", V.EDUCATION_LEVELS),
            "occupation": "c_mktsegment",
            "income": "c_acctbal + 1000.0",
            "region": "r_name",
            "nation": "n_name",
            "join_date": "DATE '1990-01-01' + CAST((c_custkey * 13) % 1800 AS INT)",
        },
    ),
    "accounts": View(
        "{orders}",
        {
            "account_id": "o_orderkey",
            "customer_id": "o_custkey",
            "account_type": _cases("o_orderkey % 4", ["Savings", "Current", "Credit", "Loan"]),
            "open_date": "CAST(o_orderdate AS DATE)",
            "status": "CASE WHEN o_custkey % 5 = 0 OR o_orderstatus = 'F' THEN 'Closed' "
            "WHEN o_orderstatus = 'P' THEN 'Frozen' ELSE 'Active' END",
            "balance": "o_totalprice * 100",
        },
    ),
    "transactions": View(
        "{lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey",
        {
            "account_id": "l_orderkey",
            "transaction_date": "l_shipdate",
            "amount": "l_extendedprice",
            "type": "CASE WHEN l_returnflag = 'R' THEN 'Credit' ELSE 'Debit' END",
            "channel": _cases("l_linenumber % 4", ["ATM", "POS", "Online", "Branch"]),
            "merchant": "CASE WHEN l_returnflag = 'R' THEN NULL ELSE s_name END",
            "location": "n_name",
        },
    ),
    "transactions_ev": View(
        _EVENTS,
        {
            "transaction_id": "event_id",
            "account_id": "user_id",
            "transaction_date": "ts",
            "amount": "value",
            "type": f"CASE WHEN {_DEBIT} THEN 'Debit' ELSE 'Credit' END",
            "channel": _cases("prop % 4", ["ATM", "POS", "Online", "Branch"]),
            "merchant": f"CASE WHEN {_DEBIT} THEN {_cases('event_id % 10', _MERCHANTS)} ELSE NULL END",
            "location": _cases("prop % 10", V.LOCATIONS),
        },
    ),
    "transactions_raw": View(
        "{transactions_ev}",
        {
            "transaction_id": "transaction_id",
            "account_id": "account_id",
            "transaction_date": "transaction_date",
            "amount": "amount",
            "type": "type",
            "channel": "channel",
            "merchant": "CASE transaction_id % 3 WHEN 0 THEN lower(merchant) "
            "WHEN 1 THEN '  ' || merchant || ' ' ELSE merchant END",
            "location": "CASE WHEN transaction_id % 97 = 0 THEN NULL "
            "WHEN transaction_id % 2 = 0 THEN ' ' || upper(location) ELSE lower(location) || '  ' END",
        },
    ),
    "loans": View(
        "{orders}",
        {
            "loan_id": "o_orderkey",
            "customer_id": "o_custkey",
            "loan_type": _cases("o_orderkey % 5", ["Personal", "Home", "Car", "Education", "Business"]),
            "loan_amount": "o_totalprice * 200",
            "interest_rate": "8.0E0 + (o_orderkey % 701) / 100.0E0",
            "term_months": "CAST(CASE o_orderkey % 5 WHEN 0 THEN 12 WHEN 1 THEN 24 WHEN 2 THEN 36 "
            "WHEN 3 THEN 60 ELSE 120 END AS INT)",
            "start_date": "CAST(o_orderdate AS DATE)",
            "status": "CASE o_orderkey % 20 WHEN 3 THEN 'Defaulted' WHEN 7 THEN 'Rejected' "
            "WHEN 11 THEN 'Paid' ELSE 'Approved' END",
        },
    ),
    "credit_scores": View(
        "{events}",
        {
            "score_id": "event_id",
            "customer_id": "user_id",
            "score": _SCORE,
            "date_recorded": "CAST(ts AS DATE)",
            "risk_level": f"CASE WHEN {_SCORE} > 700 THEN 'Low' WHEN {_SCORE} > 600 THEN 'Medium' ELSE 'High' END",
        },
    ),
    "campaigns": View(
        "{part}",
        {
            "campaign_id": "p_partkey + 1",
            "campaign_name": "'Campaign_' || CAST(p_partkey + 1 AS VARCHAR(10)) || '_2024'",
            "start_date": "DATE '2024-01-01' + CAST(p_partkey % 10 * 3 AS INT)",
            "end_date": "DATE '2024-01-08' + CAST(p_partkey % 10 * 3 + (p_partkey % 10 * 17) % 54 AS INT)",
            "channel": _cases("p_partkey % 4", ["Email", "SMS", "Phone", "App Notification"]),
            "cost_mmk": "CAST(p_retailprice * 100 AS BIGINT)",
        },
    ),
    "campaign_responses": View(
        _EVENTS,
        {
            "response_id": "event_id",
            "campaign_id": "CAST(prop % 10 + 1 AS BIGINT)",
            "customer_id": "user_id",
            "response_date": "CAST(ts AS DATE)",
            "responded": "value > 50",
        },
    ),
    "fraud_alerts": View(
        "{events}",
        {
            "fraud_id": "event_id + 1",
            "transaction_id": "event_id",
            "fraud_date": "CAST(ts AS DATE) + CAST(event_id % 5 AS INT)",
            "is_fraud": "event_type = 'error'",
        },
    ),
    "scored": View(
        "{documents} d JOIN {labels} b ON d.doc_id = b.doc_id",
        {"row_id": "d.doc_id", "label": "b.quality", "prob": "(n_chars % 100) / 100.0E0"},
    ),
    "vectors": View(
        "{embeddings}",
        {
            "vec_id": "vec_id",
            "label": "label",
            **{f"v{i}": f"CAST(element_at(embedding, {i}) AS DOUBLE)" for i in range(1, VECTOR_SIZE + 1)},
        },
    ),
}


# Schemas of the files, stated so that reading starts without a job that infers them.
RAW_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}


class Bank:
    """The logical tables of one data folder, each built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._built:
            if name in VIEWS:
                view = VIEWS[name]
                self._built[name] = self.spark.sql(view.select(), **{t: self.table(t) for t in view.reads})
            else:
                self._built[name] = self.spark.read.schema(RAW_SCHEMAS[name]).parquet(
                    f"{self.folder}/{name}.parquet"
                )
        return self._built[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)


def check_sql(views: str, body: str) -> str:
    """``body`` with the named views (and the views they read) in front as CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for needed in VIEWS[name].reads:
                add(needed)
            ordered.append(name)

    for name in views.split():
        add(name)
    ctes = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n].select())})" for n in ordered]
    ctes = [c.replace("element_at(", "list_extract(") for c in ctes]  # the one function spelled differently
    body = body.strip()
    if body.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body if ctes else body
