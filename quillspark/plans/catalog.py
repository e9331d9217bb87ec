"""All queries of the library by name, with their DuckDB equivalents."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("operators.adapters", "operators.filters", "operators.corpus", "operators.stores", "operators.joins", "operators.records", "operators.arrays", "operators.features", "operators.timeseries", "operators.expressions", "operators.relational", "operators.pages", "operators.intake")

QUERIES, SQL = {}, {}
for _name in MODULES:
    _module = import_module(f"quillspark.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_token_supply"](spark, sf_dir)
