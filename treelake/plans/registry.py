"""Registration of queries over the model tables, with the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treelake.plans.derive import checking_sql, model


class Tables:
    """Model tables by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return model(self.spark, self.sf_dir, name)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, function: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        """Register a query over Tables; sql may name model tables in braces."""
        self.queries[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql:
            self.sql[name] = checking_sql(sql)
