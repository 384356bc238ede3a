"""Queries with an SQL twin agree with DuckDB; every query gives a row per document, page or message."""

import re

import pytest

import __spark_entry__
from bankspark.llm import llm_oracle_sql, llm_queries
from tests.check_queries import compare, compare_types, duck, rows_of


@pytest.mark.parametrize("name", sorted(llm_oracle_sql()))
def test_matches_sql(spark, folder, name):
    df = llm_queries()[name](spark, folder)
    con = duck(folder)
    cur = con.execute(llm_oracle_sql()[name])
    names, want = [d[0] for d in cur.description], cur.fetchall()
    assert compare(rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, want)) == ""
    assert not compare_types(df, cur.description)


def test_names():
    found = __spark_entry__.queries()
    assert "pipeline" in found
    for n in range(1, 14):
        assert sum(bool(re.match(rf"op{n}_", name)) for name in found) == 1


def test_whole_tables(spark, folder):
    tables = {"op3": "conversations", "op9": "pages"}
    for name, build in llm_queries().items():
        if name.startswith("op4_"):
            continue
        table = tables.get(name.split("_")[0], "documents")
        assert build(spark, folder).count() == spark.read.parquet(f"{folder}/{table}.parquet").count()
