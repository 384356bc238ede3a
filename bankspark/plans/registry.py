"""One place where a query gets its name, its Spark side and its check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from bankspark.session import configure, ship_package
from bankspark.sources.tables import Bank, check_sql


@dataclass(frozen=True)
class Query:
    """A registered query; ``sql`` is None where no exact SQL twin exists."""

    name: str
    build: Callable[[Bank], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return self.build(Bank(configure(spark), folder))


QUERIES: dict[str, Query] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register the decorated ``Bank -> DataFrame`` function under ``name``."""

    def register(build: Callable[[Bank], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, check_sql(views, sql) if sql else None)
        return build

    return register
