"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and `limit`. Among all rates that meet each source's token target, the ones
nearest to 1 in (bounded) entropy solve a convex dual with one variable a source: the odds of a document's rate are
tilted by exp(dual * x). A document's entropy is weighed by the mean of its size and its source's mean size, which
bounds x = 2 size / (size + mean size) by 2, so no long text is all or nothing. Newton steps, kept within a shrinking
bracket, solve the duals; each sums gradient and curvature over a histogram of (source, size) in Spark. Rates are
then rounded to whole copies, largest sizes first, each size carrying on the tokens that the larger ones left over.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import packed, table, unpacked, words, written

WEIGHTS = (5, 2, 1)
#: Parts of a (source, size) class, so that a class with a large share of all rows is ranked by many tasks.
SALTS = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = 3) -> DataFrame:
    """(source, source_size, target, capped) from one row a source (source, source_size).

    Sources in code point order, null last, take the weights in turn. Targets share all tokens by weight; one above
    `limit` times its source's size stops there, and the excess is shared again by weight until none is above.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    weighed = sizes.withColumn("weight", weight)
    most = F.lit(limit) * F.col("source_size")
    ahead = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total, all_weight = F.sum("source_size").over(Window.partitionBy()), F.sum("weight").over(Window.partitionBy())
    levels = (
        weighed.withColumn("ratio", most / F.col("weight"))
        .withColumn("level", (total - F.coalesce(F.sum(most).over(ahead), F.lit(0))) / (all_weight - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0))))
        .filter("ratio >= level")
    )
    level = levels.agg(F.min_by("level", F.struct("ratio", F.col("source").isNull(), "source"))).first()[0]
    share = F.lit(float(level) if level is not None else math.inf) * F.col("weight")
    return weighed.select("source", "source_size", F.least(most.cast("double"), share).alias("target"), (share >= most).alias("capped"))


def _rate(dual, x, limit: int):
    return F.lit(float(limit)) / (1 + F.lit(limit - 1.0) * F.exp(-dual * x))


def solve_duals(histogram: DataFrame, targets: DataFrame, limit: int = 3, steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """(source, dual) for uncapped sources with tokens; histogram has (source, size, n), sizes above 0."""
    free = targets.filter("NOT capped AND source_size > 0")
    means = histogram.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    start = {"dual": F.lit(0.0), "low": F.lit(-64.0), "high": F.lit(64.0), "miss": F.lit(1.0)}
    state = free.alias("f").join(means.alias("m"), F.expr("f.source <=> m.source")).select("f.source", "target", "mean").withColumns(start)
    state = written(state, "duals")
    for _ in range(steps):
        h = histogram.select(F.col("source").alias("of"), "size", "n")
        joined = h.join(state, F.col("of").eqNullSafe(F.col("source")))
        x = 2 * F.col("size") / (F.col("size") + F.col("mean"))
        rate = _rate(F.col("dual"), x, limit)
        tokens = F.col("n") * F.col("size")
        sums = joined.groupBy("source", "target", "mean", "dual", "low", "high").agg(
            (F.sum(tokens * rate) - F.first("target")).alias("gap"), F.sum(tokens * x * rate * (1 - rate / limit)).alias("slope")
        )
        low = F.when(F.col("gap") < 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(F.col("gap") > 0, F.col("dual")).otherwise(F.col("high"))
        bracket = sums.withColumns({"low": low, "high": high, "next": F.col("dual") - F.try_divide("gap", "slope")})
        dual = F.when((F.col("next") > F.col("low")) & (F.col("next") < F.col("high")), F.col("next")).otherwise((F.col("low") + F.col("high")) / 2)
        miss = F.abs(F.col("gap")) / F.col("target")
        state = written(bracket.select("source", "target", "mean", F.when(miss < tolerance, F.col("dual")).otherwise(dual).alias("dual"), "low", "high", miss.alias("miss")), "duals")
        miss_left = state.agg(F.max("miss")).first()[0] or 0.0
        if miss_left < tolerance:
            break
    else:
        raise RuntimeError(f"the duals did not settle within {steps} steps: a source still misses its target by {miss_left:.3g} of it")
    return state.select("source", "mean", "dual")


def _whole_copies(key: tuple, classes: pa.Table) -> pa.Table:
    """Copies of each size class of one source, largest sizes first; what a class misses goes to the next."""
    classes = classes.sort_by([("size", "descending")])
    left, totals = 0.0, []
    limit = classes["most"][0].as_py()
    for size, n, rate in zip(classes["size"].to_pylist(), classes["n"].to_pylist(), classes["rate"].to_pylist(), strict=True):
        left += n * rate * size
        copies = min(max(round(left / size), 0), limit * n)
        left -= copies * size
        totals.append(copies)
    return classes.select(["source", "size", "n"]).append_column("total", pa.array(np.array(totals, dtype=np.int64)))


def mix_sources(
    df: DataFrame, carry: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, limit: int = 3, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The columns `carry` of df (all by default) with size, source_size, target, rate and copies (0 to limit).

    Size counts words; null and blank texts have none and get no copies. A null source is a source. The classes of
    one size in a source share a rate; which of their documents take the last copy goes by a seeded hash of id and
    text, so reruns agree; repeated rows are ranked one by one. An empty table gives no rows. Input columns named
    like an added one are replaced.
    """
    added = ["size", "source_size", "target", "rate", "copies"]
    rows = packed(df).select(
        F.col("record").getField(source_col).alias("source"),
        F.size(words(F.col("record").getField(text_col))).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col("record").getField(id_col), F.col("record").getField(text_col)).alias("draw"),
        F.struct(*[F.col("record").getField(c).alias(c) for c in (carry if carry is not None else df.columns)]).alias("record"),
    )
    rows = rows.withColumn("salt", F.pmod("draw", F.lit(SALTS)))
    cells = written(rows.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("rows")), "mix-cells")
    histogram = written(cells.filter("size > 0").groupBy("source", "size").agg(F.sum("rows").alias("n")), "mix-histogram")
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = written(source_targets(written(sizes, "mix-sources"), weights, limit), "mix-targets")
    duals = solve_duals(histogram, targets, limit)
    h, t, d = histogram.alias("h"), targets.alias("t"), duals.alias("d")
    x = 2 * F.col("h.size") / (F.col("h.size") + F.col("d.mean"))
    rate = F.when(F.col("t.capped"), F.lit(float(limit))).otherwise(_rate(F.col("d.dual"), x, limit))
    rated = h.join(t, F.expr("h.source <=> t.source")).join(d, F.expr("h.source <=> d.source"), "left")
    rated = written(rated.select("h.source", "h.size", "h.n", rate.alias("rate"), F.lit(limit).cast("long").alias("most")), "mix-rates")
    whole = written(rated.groupBy("source").applyInArrow(_whole_copies, "source string, size long, n long, total long"), "mix-copies")
    # Each part of a class starts where the ranks of the parts before it end.
    ahead = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("first", F.coalesce(F.sum("rows").over(ahead), F.lit(0))).alias("c")
    w, r = whole.alias("w"), rated.alias("r")
    same = lambda a, b: F.expr(f"{a}.source <=> {b}.source AND {a}.size = {b}.size")
    plan = offsets.join(w, same("c", "w"), "left").join(r, same("c", "r"), "left").join(t, F.expr("c.source <=> t.source"))
    plan = plan.select(
        F.col("c.source").alias("of"), F.col("c.size").alias("of_size"), F.col("c.salt").alias("of_salt"), "first", "source_size", "target",
        F.coalesce("r.rate", F.lit(0.0)).alias("rate"), F.coalesce("w.n", F.lit(1)).alias("n"), F.coalesce("w.total", F.lit(0)).alias("total"),
    )
    joined = rows.join(plan, F.expr("source <=> of AND size = of_size AND salt = of_salt"))
    rank = F.row_number().over(Window.partitionBy("of", "of_size", "of_salt").orderBy("draw")) - 1 + F.col("first")
    copies = F.floor(F.col("total") / F.col("n")) + (rank < F.col("total") % F.col("n")).cast("long")
    return unpacked(joined.withColumn("copies", copies), added)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


QUERIES = {"op9_mixing": op9_mixing}
ORACLE_SQL: dict[str, str] = {}
