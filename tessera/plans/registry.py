"""Registration of named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The clocks of the order tables and of events.
ORDER_CLOCK, EVENT_CLOCK = "1998-09-01 00:00:00", "2024-01-20 00:00:00"


class Tables:
    """The driver's tables of one folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def clock(text: str):
    return F.lit(text).cast("timestamp_ntz")


def query(name: str, sql: str | None = None):
    """Registers f(tables) -> DataFrame under a name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register
