"""Register a query next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from answerlens.catalog import fixtures as FX

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Attribute access to tables and views: ``i.facts``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return FX.load(self.spark, self.sf_dir, name)


def query(name: str, views: list[str] | None = None, sql: str | None = None):
    """Decorator: ``fn(inputs) -> DataFrame`` becomes the query ``name``."""

    def add(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql:
            ORACLES[name] = FX.with_views(views or [], sql)
        return fn

    return add
