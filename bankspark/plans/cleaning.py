"""Clean-up and data quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bankspark import fixed_values as V
from bankspark.functions import numbers as N
from bankspark.functions import text as X
from bankspark.operators import cleaning as C
from bankspark.operators import columns as L
from bankspark.operators import quality as Q
from bankspark.plans.registry import query
from bankspark.sources.tables import VECTOR_SIZE
from bankspark.schema import DOMAINS

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _title(expr: str) -> str:
    return f"upper(substr({expr}, 1, 1)) || lower(substr({expr}, 2))"


_MERCHANT = _STRIP.format("merchant")
_LOCATION = _title(_STRIP.format("location"))
_RULES = (
    "rules AS (SELECT * FROM (VALUES "
    + ", ".join(
        f"('{m}', [{', '.join(repr(p) for p in places)}])" for m, places in V.MERCHANT_LOCATIONS.items()
    )
    + ") AS t(name, allowed))"
)
CLEANED = f"""WITH {_RULES},
tidy AS (SELECT * REPLACE (COALESCE(r.name, t.merchant) AS merchant) FROM (
  SELECT * REPLACE (COALESCE({_MERCHANT}, 'Unknown') AS merchant, {_LOCATION} AS location) FROM transactions_raw) t
  LEFT JOIN (SELECT name FROM rules) r ON lower(t.merchant) = lower(r.name)),
cleaned AS (SELECT transaction_id, account_id, transaction_date, amount, type, channel, merchant,
  CASE WHEN allowed IS NOT NULL AND NOT COALESCE(list_contains(allowed, location), FALSE)
    THEN allowed[1] ELSE location END AS location
  FROM (SELECT tidy.* EXCLUDE (name), rules.allowed FROM tidy LEFT JOIN rules ON tidy.merchant = rules.name))
"""


@query("dq1_clean_transactions", "transactions_raw", CLEANED + "SELECT * FROM cleaned")
def _(b):
    return C.clean_transactions(b.transactions_raw)


@query("sc1_trim", "transactions_raw", f"SELECT transaction_id, {_MERCHANT} AS merchant FROM transactions_raw")
def _(b):
    return b.transactions_raw.select("transaction_id", X.strip(F.col("merchant")).alias("merchant"))


@query("sc2_title_case", "transactions_raw", f"SELECT transaction_id, {_LOCATION} AS location FROM transactions_raw")
def _(b):
    return b.transactions_raw.select("transaction_id", X.title_case(X.strip(F.col("location"))).alias("location"))


@query(
    "sc3_fill_text_default",
    "transactions_raw",
    "SELECT transaction_id, COALESCE(merchant, 'Unknown') AS merchant, COALESCE(location, 'Unknown') AS location "
    "FROM transactions_raw",
)
def _(b):
    return b.transactions_raw.select(
        "transaction_id",
        X.or_default(F.col("merchant")).alias("merchant"),
        X.or_default(F.col("location")).alias("location"),
    )


@query(
    "sc20_canonicalise_by_lookup",
    "transactions_raw",
    f"""WITH {_RULES} SELECT transaction_id, COALESCE(name, m) AS merchant FROM
  (SELECT transaction_id, {_MERCHANT} AS m FROM transactions_raw) LEFT JOIN rules ON lower(m) = lower(name)""",
)
def _(b):
    merchants = b.spark.createDataFrame([(m,) for m in V.MERCHANT_LOCATIONS], "name STRING")
    tidy = b.transactions_raw.select("transaction_id", X.strip(F.col("merchant")).alias("merchant"))
    return C.canonicalise_by_lookup(tidy, "merchant", merchants, "name")


@query(
    "sc21_repair_by_rule_table",
    "transactions_ev",
    f"""WITH {_RULES} SELECT transaction_id, merchant, CASE WHEN allowed IS NOT NULL
  AND NOT COALESCE(list_contains(allowed, location), FALSE) THEN allowed[1] ELSE location END AS location
FROM transactions_ev LEFT JOIN rules ON merchant = name""",
)
def _(b):
    return b.transactions_ev.select(
        "transaction_id", "merchant",
        C.allowed_location(F.col("merchant"), F.col("location")).alias("location"),
    )


_KEYS = {
    "customers": "customer_id", "accounts": "account_id", "loans": "loan_id", "credit_scores": "score_id",
    "campaigns": "campaign_id", "campaign_responses": "response_id", "transactions_ev": "transaction_id",
    "fraud_alerts": "fraud_id",
}
_REFERENCES = [
    ("accounts", "customer_id", "customers"), ("transactions_ev", "account_id", "accounts"),
    ("loans", "customer_id", "customers"), ("credit_scores", "customer_id", "customers"),
    ("campaign_responses", "campaign_id", "campaigns"), ("campaign_responses", "customer_id", "customers"),
    ("fraud_alerts", "transaction_id", "transactions_ev"),
]
_UNIQUE_SQL = """SELECT '{t}.{k} unique' AS "check", COUNT(*) AS bad_keys, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS bad_rows
FROM (SELECT {k}, COUNT(*) AS n FROM {t} GROUP BY {k} HAVING COUNT(*) > 1)"""
_ORPHAN_SQL = """SELECT '{c}.{k} in {p}', COUNT(DISTINCT {k}), COUNT(*) FROM {c}
WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {k} FROM {p})"""


@query(
    "dq3_key_and_foreign_key_check",
    " ".join(_KEYS),
    " UNION ALL ".join(
        [_UNIQUE_SQL.format(t=t, k=k) for t, k in _KEYS.items()]
        + [_ORPHAN_SQL.format(c=c, k=k, p=p) for c, k, p in _REFERENCES]
    ),
)
def _(b):
    return Q.key_report({t: (b.table(t), k) for t, k in _KEYS.items()}, _REFERENCES)


def _domain_sql(table: str, view: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", "
        f"COUNT(*) FILTER ({c} NOT IN ({', '.join(repr(v) for v in allowed)})) AS outside FROM {view}"
        for c, allowed in DOMAINS[table].items()
    )


_DOMAIN_VIEWS = {t: ("transactions_ev" if t == "transactions" else t) for t in DOMAINS}


@query(
    "dq4_domain_check",
    " ".join(_DOMAIN_VIEWS.values()),
    " UNION ALL ".join(_domain_sql(t, v) for t, v in _DOMAIN_VIEWS.items()),
)
def _(b):
    out = None
    for table, view in _DOMAIN_VIEWS.items():
        part = Q.domain_report(b.table(view), table, DOMAINS[table])
        out = part if out is None else out.unionByName(part)
    return out


_VECTOR = [f"v{i}" for i in range(1, VECTOR_SIZE + 1)]


@query(
    "dq5_feature_health",
    "vectors",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(*) FILTER ({c} IS NULL) AS nulls, "
        f"COUNT(*) FILTER (isnan({c})) AS nans, COUNT(*) FILTER (isinf({c})) AS infs FROM vectors"
        for c in _VECTOR
    ),
)
def _(b):
    return Q.feature_health(L.standardise(b.vectors, _VECTOR), _VECTOR)


@query(
    "dq6_drop_constant_columns",
    "vectors",
    "SELECT vec_id, " + ", ".join(_VECTOR) + " FROM vectors",
)
def _(b):
    widened = b.vectors.select("vec_id", *_VECTOR, F.lit(1.0).alias("always_one"))
    return Q.drop_constant(widened, [*_VECTOR, "always_one"])


@query(
    "ml1_standardise",
    "vectors",
    "SELECT vec_id, "
    + ", ".join(f"round(({c} - AVG({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}" for c in _VECTOR)
    + " FROM vectors",
)
def _(b):
    scaled = L.standardise(b.vectors.select("vec_id", *_VECTOR), _VECTOR)
    return scaled.select("vec_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in _VECTOR])


@query(
    "sc5_replace_non_finite",
    "vectors",
    "SELECT vec_id, CASE WHEN v1 > 0 THEN v1 END AS x, CASE WHEN vec_id % 3 <> 0 THEN v2 END AS y FROM vectors",
)
def _(b):
    # plant infinities and NaN, then clean them away
    planted = b.vectors.select(
        "vec_id",
        F.when(F.col("v1") > 0, F.col("v1")).otherwise(F.lit(float("-inf"))).alias("x"),
        F.when(F.col("vec_id") % 3 != 0, F.col("v2")).otherwise(F.lit(float("nan"))).alias("y"),
    )
    return L.only_finite(planted, ["x", "y"])


@query(
    "sc24_ordinal_encode_dummy_encode",
    "credit_scores",
    """SELECT score_id, CAST(CASE risk_level WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 END AS INTEGER)
  AS risk_ordinal, CAST(risk_level = 'Low' AS INTEGER) AS risk_level_low,
  CAST(risk_level = 'Medium' AS INTEGER) AS risk_level_medium, CAST(risk_level = 'High' AS INTEGER) AS risk_level_high
FROM credit_scores""",
)
def _(b):
    level = F.col("risk_level")
    return b.credit_scores.select(
        "score_id",
        N.ordinal(level, V.RISK_LEVELS).alias("risk_ordinal"),
        *[c.alias(n) for n, c in N.dummies(level, V.RISK_LEVELS, "risk_level").items()],
    )
