"""Operators for preparing training text at scale; nothing outside this folder imports them."""

from bankspark.llm.queries import llm_oracle_sql, llm_queries

__all__ = ["llm_oracle_sql", "llm_queries"]
