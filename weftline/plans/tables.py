"""Reading the test tables and binding functions to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def on(*names: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """Decorator: a query over whole tables; the function gets one DataFrame for each name."""

    def bind(function: Callable[..., DataFrame]) -> Query:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(*(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names))

        query.__name__, query.__doc__ = function.__name__, function.__doc__
        return query

    return bind
