"""Table access shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of one folder as DataFrames: ``Tables(spark, d).files``."""

    def __init__(self, spark: SparkSession, d: str):
        self._spark, self._d = spark, d

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._d}/{name}.parquet")


def query(registry: dict):
    """Register a function of ``Tables`` as a query of (spark, folder)."""

    def register(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(Tables(spark, d))

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        registry[f.__name__] = run
        return f

    return register
