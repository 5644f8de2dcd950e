"""Queries by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.inputs import oracle_text, spark_sql, spark_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Derived tables of one session and data folder, by attribute; sql() for texts over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        return spark_table(self.spark, self._dir, name, self._made)

    def sql(self, text: str) -> DataFrame:
        return spark_sql(self.spark, self._dir, text, self._made)


def query(oracle: str | None = None):
    """Registers a function of Inputs under its name; oracle: DuckDB SQL over the same inputs in braces."""

    def register(build: Callable[[Inputs], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if oracle:
            ORACLES[build.__name__] = oracle_text(oracle)
        return build

    return register
