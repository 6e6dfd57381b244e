"""The registry of queries: a name, a function of (spark, sf_dir), and SQL over the same tables if there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of one data folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


class Registry:
    def __init__(self) -> None:
        self.functions: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable:
        """Register a function of ``Tables`` under its own name."""

        def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            key = name or f.__name__
            self.functions[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.sql[key] = sql
            return f

        return put


def seconds(ts: str = "ts") -> Column:
    """Seconds since 1970 of a timestamp with or without a zone, as a double."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz)) / 1000000.0").cast("double")


def millis(ts: str = "ts") -> Column:
    """Whole milliseconds since 1970."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz)) div 1000")


def confidence(value: str = "value") -> Column:
    """Stand-in for a confidence: a positive measure squeezed into 0 to 1."""
    return F.col(value) / (F.col(value) + 30.0)


#: The same two in DuckDB.
SECONDS = "epoch_us(ts) / 1000000.0::double"
CONF = "value / (value + 30.0::double)"
