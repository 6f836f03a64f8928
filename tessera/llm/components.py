"""Connected components of an edge table, by repeated stars in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Large stars and small stars alternate until the edges are stars, which takes about as many rounds as the logarithm
    of the longest path. A node's neighbours only meet in a minimum, never in a list, and the edges of a hub are not
    shuffled to one task. Null nodes have no edges; an empty table gives no rows.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = written(pairs, "edges")
    for _ in range(rounds + 1):
        n_pairs, unsettled = _state(pairs)
        if not unsettled:
            break
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = spread_join(both, least, "a", "n", 2 * n_pairs).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small_in = written(large.filter("a <> b").distinct(), "edges")
        lowest = small_in.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = spread_join(small_in, lowest, "a", "n", n_pairs)  # as many edges as pairs, or fewer
        small = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        pairs = written(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges", instead_of=pairs)
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _state(pairs: DataFrame) -> tuple[int, int]:
    """The number of pairs (a, b), a > b, and of nodes that keep them from being stars: those with two smaller
    neighbours, or with a smaller and a larger one. Without such a node each a hangs on the smallest of its component,
    so no further round, which would change nothing, is needed to see that."""
    ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(pairs.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return tuple(nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up + down > 1 AND up > 0"))).first())
