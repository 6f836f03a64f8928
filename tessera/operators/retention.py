"""Retention and erasure as filters; a null date keeps a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import without_where


def purge(df: DataFrame, expired: Column) -> DataFrame:
    return without_where(df, expired)


def purge_with_children(parents: DataFrame, child_tables: dict[str, DataFrame], key: str, expired: Column) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents without the expired ones, and each child table without rows of an expired parent."""
    gone = parents.filter(F.coalesce(expired, F.lit(False))).select(key)
    return purge(parents, expired), {name: df.join(gone, key, "left_anti") for name, df in child_tables.items()}


def purge_unused(df: DataFrame, uses: DataFrame, key: str, old: Column) -> DataFrame:
    """Old rows go unless `uses` names them; null names use nothing."""
    used = uses.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("_used", F.lit(True))
    joined = df.join(used, key, "left")
    return joined.filter(~(F.coalesce(old, F.lit(False)) & F.col("_used").isNull())).drop("_used")


def counts(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(table, expired) for each table and its expiry condition."""
    parts = [df.agg(F.count_if(F.coalesce(c, F.lit(False))).alias("expired")).select(F.lit(name).alias("table"), "expired") for name, (df, c) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
