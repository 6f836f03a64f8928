"""Data-quality issues in one pass: each entity's conditions become an array, and the array explodes to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(df: DataFrame, checks: list[tuple[str, str, str, Column]], *keys: Column) -> DataFrame:
    """(keys, code, severity, message) for each check (code, severity, message, condition) that holds.

    A null condition counts as not holding. The input is scanned once however many checks there are.
    """
    found = [F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))) for code, severity, message, c in checks]
    return df.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("issue")).select(*[F.col(k) for k in _names(df, keys)], "issue.*")


def _names(df: DataFrame, keys: tuple[Column, ...]) -> list[str]:
    return df.select(*keys).columns


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))
