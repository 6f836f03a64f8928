"""Deletes over a declared graph of foreign keys: CASCADE and SET NULL, in topological order, to a fixpoint for self references."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CASCADE, SET_NULL = "cascade", "set null"


@dataclass(frozen=True)
class ForeignKey:
    """child.column refers to parent.key."""

    child: str
    column: str
    parent: str
    key: str
    action: str = CASCADE


def _held(keys: DataFrame, name: str) -> DataFrame:
    """Distinct keys that are not null, as one column."""
    return keys.select(F.col(keys.columns[0]).alias(name)).filter(F.col(name).isNotNull()).distinct()


def _marked(df: DataFrame, column: str, gone: DataFrame, flag: str) -> DataFrame:
    """df with a flag: whether `column` is among the keys that are gone."""
    return df.join(_held(gone, "_key").withColumn(flag, F.lit(True)), F.col(column) == F.col("_key"), "left").drop("_key").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _descendants(df: DataFrame, edge: ForeignKey) -> DataFrame:
    """df with `_gone` spread along a self reference, until a round finds no more; depth many rounds, each cut by a checkpoint."""
    links = df.select(F.col(edge.key).alias("_id"), F.col(edge.column).alias("_parent"), "_gone").checkpoint()
    gone = links.filter("_gone").select("_id").distinct()
    newest = gone
    while True:
        newest = links.join(newest.select(F.col("_id").alias("_parent")), "_parent", "left_semi").select("_id").distinct().join(gone, "_id", "left_anti").checkpoint()
        if newest.isEmpty():
            break
        gone = gone.unionByName(newest).checkpoint()
    return _marked(df, edge.key, gone, "_below").withColumn("_gone", F.col("_gone") | F.col("_below")).drop("_below")


def order_of(tables: list[str], edges: list[ForeignKey]) -> list[str]:
    """Parents before children; raises on a cycle of several tables."""
    graph = TopologicalSorter({t: set() for t in tables})
    for e in edges:
        if e.child != e.parent:
            graph.add(e.child, e.parent)
    return list(graph.static_order())


def deleted(tables: dict[str, DataFrame], edges: list[ForeignKey], roots: dict[str, Column]) -> dict[str, DataFrame]:
    """The tables after DELETE of the rows that `roots` names by condition, and of all that follows from them.

    A row goes if its condition holds (null does not) or a CASCADE key of its refers to a row that goes. A SET NULL key
    of a row that stays becomes null where it refers to one that goes. Null keys refer to nothing. Each table is read
    once for each of its parents, by joins on the keys that are gone, never by a list of them. Self references need a
    checkpoint folder.
    """
    marked: dict[str, DataFrame] = {}
    for name in order_of(list(tables), edges):
        df = tables[name].withColumn("_gone", F.coalesce(roots.get(name, F.lit(False)), F.lit(False)))
        own = [e for e in edges if e.child == name and e.parent != name]
        flags = []
        for i, e in enumerate(own):
            gone = marked[e.parent].filter("_gone").select(e.key)
            df = _marked(df, e.column, gone, f"_f{i}")
            flags.append(F.col(f"_f{i}"))
        cascading = [f for f, e in zip(flags, own, strict=True) if e.action == CASCADE]
        df = df.withColumn("_gone", reduce(lambda a, b: a | b, cascading, F.col("_gone")))
        for e in (e for e in edges if e.child == e.parent == name and e.action == CASCADE):
            df = _descendants(df, e)
        nulls = {e.column: F.when(~f, F.col(e.column)) for f, e in zip(flags, own, strict=True) if e.action == SET_NULL}
        for e in (e for e in edges if e.child == e.parent == name and e.action == SET_NULL):
            df = _marked(df, e.column, df.filter("_gone").select(e.key), "_self")
            nulls[e.column] = F.when(~F.col("_self"), F.col(e.column))
        marked[name] = df.withColumns(nulls) if nulls else df
    return {name: df.filter("NOT _gone").select(*tables[name].columns) for name, df in marked.items()}
