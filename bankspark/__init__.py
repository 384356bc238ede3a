"""Retail-bank analytics written for Spark: DataFrame operators, models and jobs."""
