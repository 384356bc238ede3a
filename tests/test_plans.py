"""Physical plans: no Python on rows and no nested-loop join in the SQL-expressible queries."""

import pytest

from bankspark.plans import all_queries

QUERIES = all_queries()
MODELS = ("ml2", "ml4", "ml15", "ml17", "ml18")  # facts about models, which score in Python
PLAIN = [n for n, q in QUERIES.items() if q.sql is not None and not n.startswith(("st1", "io", "jb3", *MODELS))]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_python_and_no_pairing(spark, folder, name):
    plan = plan_of(QUERIES[name](spark, folder))
    for bad in ("PythonUDF", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_filters_and_columns_reach_the_scan(spark, folder):
    plan = plan_of(QUERIES["wn1_peak_least_month"](spark, folder))
    scan = next(line for line in plan.splitlines() if "lineitem.parquet" in line)
    assert "l_tax" not in scan and "l_extendedprice" in scan


def test_hot_keys_are_combined_before_joins(spark, folder):
    plan = plan_of(QUERIES["ag3_count_and_sum_by_two_keys"](spark, folder))
    lines = plan.splitlines()
    # region/nation joins aside, the account rows are grouped below the join with customers
    grouped = next(i for i, line in enumerate(lines) if "partial_count" in line and "keys=[customer_id" in line)
    joined = next(i for i, line in enumerate(lines) if "Join [customer_id" in line)
    assert joined < grouped


def test_key_checks_read_each_table_once(spark, folder, bank):
    from bankspark.plans.cleaning import _KEYS

    scans = lambda df: plan_of(df).count("FileScan parquet")
    report = QUERIES["dq3_key_and_foreign_key_check"](spark, folder)
    assert scans(report) == sum(scans(bank.table(t)) for t in _KEYS)


def test_key_report_of_odd_keys(spark):
    from bankspark.operators.quality import key_report

    parent = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "p BIGINT")
    child = spark.createDataFrame([(10, 1), (11, 3), (12, 3), (13, None), (13, 2)], "c BIGINT, p BIGINT")
    got = [tuple(r) for r in key_report({"parent": (parent, "p"), "child": (child, "c")}, [("child", "p", "parent")]).collect()]
    assert got == [("parent.p unique", 2, 4), ("child.c unique", 1, 2), ("child.p in parent", 1, 2)]
    empty = key_report({"parent": (parent.limit(0), "p"), "child": (child.limit(0), "c")}, [("child", "p", "parent")])
    assert [tuple(r)[1:] for r in empty.collect()] == [(0, 0)] * 3
